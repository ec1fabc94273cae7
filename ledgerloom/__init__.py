"""Evidence, entity and lead analytics as Spark DataFrame plans."""
