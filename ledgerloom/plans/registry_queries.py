"""Queries on the register of sources, documents and their processing, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import registry
from ledgerloom.session import table

AT = "2025-01-01 00:00:00"
VERSION, CONFIG = "text/2", "a"


def _at():
    return F.to_timestamp(F.lit(AT + "+00:00"))


def domain_rules(spark: SparkSession, d: str) -> DataFrame:
    """Websites under any of three domain rules."""
    host = text.bare_host(F.col("object_value"))
    seen = table(spark, d, "observation").where("predicate = 'website_domain'").select(host.alias("host")).distinct()
    rules = spark.createDataFrame([("co.example",), ("example",), ("org.example",)], "rule string")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(F.split("host", r"\."))), lambda i: F.array_join(F.slice(F.split("host", r"\."), i, 99), "."))
    return seen.withColumn("rule", F.explode(suffixes)).join(F.broadcast(rules), "rule").where(registry.domain_matches(F.col("host"), F.col("rule"))).select("host", "rule")  # three rows


def source_schedule(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_definition").select("source_id", registry.initial_interval(F.col("expected_update_frequency")).alias("interval_seconds"))


def _scheduled(spark: SparkSession, d: str) -> DataFrame:
    src = table(spark, d, "source_definition")
    every = registry.initial_interval(F.col("expected_update_frequency")).cast("long")
    return src.withColumn("access_method", F.when(F.col("source_category") == "bulk_dataset", "manual").otherwise("fetch")).withColumn(
        "next_collect_at", F.timestamp_micros(F.unix_micros("updated_at") + every * 1_000_000 * 30)).withColumn(
        "retry_after_until", F.when(F.col("lifecycle_status") == "degraded", F.timestamp_micros(F.unix_micros("updated_at") + 86_400_000_000 * 900)))


def due_sources(spark: SparkSession, d: str) -> DataFrame:
    """The first twenty sources to collect at a date: a top-k report."""
    return registry.due(_scheduled(spark, d), _at(), 20).select("source_id", "name", "authority_tier")


def source_list(spark: SparkSession, d: str) -> DataFrame:
    return registry.listed(table(spark, d, "source_definition"), "active", "directory").select("source_id", "name", "authority_tier")


def sources_without_documents(spark: SparkSession, d: str) -> DataFrame:
    key = F.regexp_replace(F.lower(F.trim("source")), r"[\s\-]+", "_")
    have = table(spark, d, "documents").select(key.alias("name")).distinct()
    src = table(spark, d, "source_definition")
    return registry.unpaired(src, src.join(have, "name").select("source_id")).select("source_id", "name")


def activation_gate(spark: SparkSession, d: str) -> DataFrame:
    """Why each source may not be collected; terms and robots stand in the lifecycle and category columns here."""
    src = table(spark, d, "source_definition")
    terms = F.when(F.col("lifecycle_status") == "disabled", "prohibited").otherwise("approved")
    robots = F.when(F.col("source_category") == "directory", "disallowed").when(F.col("source_category") == "news", "unknown").otherwise("allowed")
    method = F.when(F.col("source_category") == "bulk_dataset", "manual").otherwise("fetch")
    enforced = registry.robots_enforced(F.when(F.col("authority_tier") == 1, False), "enforce")
    return src.select("source_id", F.array_join(registry.activation_blockers(terms, robots, method, enforced), "; ").alias("blockers"), enforced.alias("robots_enforced"))


def document_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Documents as fetches of their source: collected, or duplicate of a text the source gave before, by source and outcome."""
    key = F.regexp_replace(F.lower(F.trim("source")), r"[\s\-]+", "_")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("fetch_id"), key.alias("source_id"), F.lit("/").alias("url"), F.col("retrieved_at").alias("at"), F.lit(True).alias("active"),
                                               F.array().cast("array<string>").alias("blockers"), F.lit(200).alias("status"), F.sha2("text", 256).alias("content_hash"))
    none = spark.createDataFrame([], "source_id string, url string, content_hash string")
    return registry.collection_outcomes(docs, none).groupBy("source_id", "outcome").agg(F.count("*").alias("documents"))


def latest_documents(spark: SparkSession, d: str) -> DataFrame:
    """The latest document of each source and title."""
    key = F.regexp_replace(F.lower(F.trim("source")), r"[\s\-]+", "_")
    docs = table(spark, d, "documents").select(key.alias("source"), F.coalesce("title", F.lit("")).alias("title"), "doc_id", "retrieved_at")
    return registry.latest(docs, ["source", "title"], "retrieved_at", "doc_id").select("source", "title", "doc_id")


def processing_backlog(spark: SparkSession, d: str) -> DataFrame:
    """Documents without a current run: those retrieved before a date were run, in English with the current version."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "retrieved_at", F.lower(F.trim("lang")).alias("lang"))
    early = docs.where(F.col("retrieved_at") < _at())
    runs = early.select("document_id", F.when(F.col("lang") == "en", VERSION).otherwise("text/1").alias("pipeline_version"), F.lit(CONFIG).alias("config_hash"))
    return registry.backlog(docs, runs, early.where("lang = 'de'"), VERSION, CONFIG).select("document_id")


def polite_delays(spark: SparkSession, d: str) -> DataFrame:
    """Seconds to wait before each fetch if the documents of a day were fetched in order."""
    key = F.regexp_replace(F.lower(F.trim("source")), r"[\s\-]+", "_")
    rows = table(spark, d, "documents").select(F.date_format("retrieved_at", "yyyy-MM-dd").alias("batch"), F.struct("retrieved_at", "doc_id").alias("ordinal"), key.alias("host"), "doc_id")
    return registry.delays(rows).select("doc_id", "delay")


def observation_targets(spark: SparkSession, d: str) -> DataFrame:
    """Place targets of sources from the regions they observed, normalised, with what is wrong with each."""
    rows = table(spark, d, "observation").where("predicate = 'location'").select(
        "source_id", F.lit("Geo").alias("dimension"), F.concat(F.lit("au-"), F.coalesce(F.get_json_object("object_value", "$.region"), F.lit("?"))).alias("target_key"),
        F.when(F.col("normalisation_status") == "rejected", "exclude").otherwise("include").alias("polarity"), F.lit(None).cast("string").alias("match_mode")).distinct()
    return registry.normal_targets(rows, ["source_id"]).select("source_id", "dimension", "target_key", "polarity", "match_mode", "problem")


def source_footprints(spark: SparkSession, d: str) -> DataFrame:
    """Whether the places a source observed are in a scope: Australia but for Tasmania and Victoria."""
    region = F.get_json_object("object_value", "$.region")
    code = F.when(F.length(region).between(2, 3), F.concat(F.when(region == "WGN", "NZ-").otherwise("AU-"), F.upper(region)))
    rows = table(spark, d, "observation").where("predicate = 'location'").groupBy("source_id").agg(F.array_sort(F.collect_set(code)).alias("codes"))
    return rows.select("source_id", F.size("codes").alias("places"), registry.in_scope(F.col("codes"), ["AU"], ["AU-TAS", "AU-VIC"], False).alias("in_scope"))


def source_sync(spark: SparkSession, d: str) -> DataFrame:
    """Sources before a date against all of them but the disabled: created, updated, unchanged, disabled."""
    src = table(spark, d, "source_definition").select("source_id", "name", "authority_tier", "language", "created_at", "updated_at", "lifecycle_status")
    cut = F.to_timestamp(F.lit("2019-07-01 00:00:00+00:00"))
    old = src.where(F.col("created_at") < cut).withColumn("authority_tier", F.when(F.col("updated_at") >= cut, F.lit(0)).otherwise(F.col("authority_tier")))
    return registry.synced(old, src.where("lifecycle_status <> 'disabled'"), ["source_id"], ["name", "authority_tier", "language"])


def source_identities(spark: SparkSession, d: str) -> DataFrame:
    """Names of observed sources as identities to attach to the registered ones: attached, there, or in conflict."""
    src = table(spark, d, "source_definition")
    known = src.where("authority_tier <= 4").select(F.explode(registry.identities(F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("name"), F.lit(None).cast("string"))).alias("i"), "source_id").select(
        "i.*", "source_id", F.lit(True).alias("is_primary"))
    wanted = src.select(F.explode(registry.identities(F.lit("Base"), F.col("source_category"), F.col("name"), F.lit(None).cast("string"))).alias("i"), "source_id").select("i.*", "source_id")
    return registry.attached(known, wanted)


def observation_contexts(spark: SparkSession, d: str) -> DataFrame:
    """The sources and predicates each document was seen under, as merged snapshots."""
    rows = table(spark, d, "observation").where("document_id is not null").select("document_id", F.col("source_id").alias("coverage_id"), F.col("predicate").alias("scope_id"))
    out = registry.merged_snapshots(rows, ["document_id"])
    return out.select("document_id", F.array_join("coverage_ids", ",").alias("coverage_ids"), F.array_join("scope_ids", ",").alias("scope_ids"), "mode")


QUERIES = {f.__name__: f for f in (domain_rules, source_schedule, due_sources, source_list, sources_without_documents, activation_gate, document_outcomes, latest_documents, processing_backlog, polite_delays,
                                   observation_targets, source_footprints, source_sync, source_identities, observation_contexts)}

_KEY = r"regexp_replace(lower(trim(source)), '[\s\-]+', '_', 'g')"
_HOST = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(object_value)), '^[a-z][a-z0-9+.\-]*://|^//', ''), '[/?#].*$', ''), '^.*@|:\d*$', '', 'g'), '^www\.', '')"
_EVERY = "CASE lower(trim(expected_update_frequency)) WHEN 'hourly' THEN 3600.0 WHEN 'daily' THEN 86400.0 WHEN 'weekly' THEN 604800.0 WHEN 'monthly' THEN 2592000.0 WHEN 'quarterly' THEN 7776000.0 ELSE 86400.0 END"
SQL = {
    "domain_rules": f"""WITH h AS (SELECT DISTINCT {_HOST} AS host FROM observation WHERE predicate = 'website_domain')
SELECT host, rule FROM h, (VALUES ('co.example'), ('example'), ('org.example')) v(rule) WHERE host = rule OR ends_with(host, '.' || rule)""",
    "source_schedule": f"SELECT source_id, CAST({_EVERY} AS DOUBLE) AS interval_seconds FROM source_definition",
    "due_sources": f"""SELECT source_id, name, authority_tier FROM source_definition WHERE lifecycle_status IN ('active', 'degraded') AND source_category <> 'bulk_dataset'
AND updated_at + to_seconds(CAST({_EVERY} AS BIGINT) * 30) <= TIMESTAMPTZ '{AT}+00:00' AND (lifecycle_status <> 'degraded' OR updated_at + to_seconds(86400 * 900) <= TIMESTAMPTZ '{AT}+00:00')
ORDER BY authority_tier, name, source_id LIMIT 20""",
    "source_list": "SELECT source_id, name, authority_tier FROM source_definition WHERE lifecycle_status = 'active' AND source_category = 'directory'",
    "sources_without_documents": f"SELECT source_id, name FROM source_definition WHERE name NOT IN (SELECT {_KEY} FROM documents WHERE source IS NOT NULL)",
    "activation_gate": """SELECT source_id, concat_ws('; ', CASE WHEN lifecycle_status = 'disabled' THEN 'terms prohibit access' END,
CASE WHEN authority_tier <> 1 AND source_category = 'directory' THEN 'robots disallow access' END, CASE WHEN authority_tier <> 1 AND source_category = 'news' THEN 'robots not verified' END) AS blockers,
authority_tier <> 1 AS robots_enforced FROM source_definition""",
    "document_outcomes": f"""WITH r AS (SELECT {_KEY} AS source_id, row_number() OVER (PARTITION BY {_KEY}, sha256(text) ORDER BY retrieved_at, doc_id) AS k FROM documents)
SELECT source_id, CASE WHEN k = 1 THEN 'collected' ELSE 'duplicate' END AS outcome, count(*) AS documents FROM r GROUP BY 1, 2""",
    "latest_documents": f"""SELECT {_KEY} AS source, coalesce(title, '') AS title, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY {_KEY}, coalesce(title, '') ORDER BY retrieved_at DESC, doc_id DESC) = 1""",
    "processing_backlog": f"SELECT doc_id AS document_id FROM documents WHERE NOT (retrieved_at < TIMESTAMPTZ '{AT}+00:00' AND coalesce(lower(trim(lang)) IN ('en', 'de'), false))",
    "polite_delays": f"""WITH r AS (SELECT doc_id, {_KEY} AS host, lag({_KEY}) OVER (PARTITION BY strftime(retrieved_at AT TIME ZONE 'UTC', '%Y-%m-%d') ORDER BY retrieved_at, doc_id) AS before FROM documents)
SELECT doc_id, CASE WHEN before IS NULL THEN 0.0 WHEN before = host THEN 4.0 ELSE 2.0 END::DOUBLE AS delay FROM r""",
    "observation_targets": r"""WITH r AS (SELECT DISTINCT source_id, upper(replace(trim('au-' || coalesce(json_extract_string(object_value, '$.region'), '?')), ' ', '_')) AS code, 'au-' || coalesce(json_extract_string(object_value, '$.region'), '?') AS raw,
  CASE WHEN normalisation_status = 'rejected' THEN 'exclude' ELSE 'include' END AS polarity FROM observation WHERE predicate = 'location'),
n AS (SELECT source_id, regexp_full_match(code, '[A-Z]{2}(-[A-Z0-9][A-Z0-9_]{0,49})+') AS ok, CASE WHEN ok THEN code ELSE raw END AS target_key, polarity FROM r)
SELECT source_id, 'region' AS dimension, target_key, min(polarity) AS polarity, 'hierarchical' AS match_mode, CASE WHEN NOT bool_and(ok) THEN 'invalid target' WHEN count(DISTINCT polarity) > 1 THEN 'included and excluded' END AS problem
FROM n GROUP BY source_id, target_key""",
    "source_footprints": """WITH r AS (SELECT source_id, json_extract_string(object_value, '$.region') AS g FROM observation WHERE predicate = 'location'),
c AS (SELECT source_id, CASE WHEN length(g) BETWEEN 2 AND 3 THEN CASE WHEN g = 'WGN' THEN 'NZ-' ELSE 'AU-' END || upper(g) END AS code FROM r)
SELECT source_id, CAST(count(DISTINCT code) AS INTEGER) AS places, coalesce(bool_or(starts_with(code, 'AU')), false) AND NOT coalesce(bool_and(code IN ('AU-TAS', 'AU-VIC')), false) AS in_scope FROM c GROUP BY source_id""",
    "source_sync": """WITH o AS (SELECT source_id, name, CASE WHEN updated_at >= TIMESTAMPTZ '2019-07-01 00:00:00+00:00' THEN 0 ELSE authority_tier END AS tier, language FROM source_definition WHERE created_at < TIMESTAMPTZ '2019-07-01 00:00:00+00:00'),
n AS (SELECT source_id, name, authority_tier AS tier, language FROM source_definition WHERE lifecycle_status <> 'disabled')
SELECT source_id, CASE WHEN o.name IS NULL THEN 'created' WHEN n.name IS NULL THEN 'disabled' WHEN o.name = n.name AND o.tier = n.tier AND o.language IS NOT DISTINCT FROM n.language THEN 'unchanged' ELSE 'updated' END AS change
FROM o FULL JOIN n USING (source_id)""",
    "source_identities": """WITH k AS (SELECT 'source_key' AS kind, lower(trim(name)) AS value, source_id FROM source_definition WHERE authority_tier <= 4),
w AS (SELECT DISTINCT * FROM (SELECT 'source_key' AS kind, lower(trim(name)) AS value, source_id FROM source_definition UNION ALL SELECT 'pack_seed', lower('Base:' || trim(source_category)), source_id FROM source_definition)),
n AS (SELECT kind, value, count(DISTINCT source_id) AS owners FROM (SELECT * FROM k UNION ALL SELECT * FROM w) GROUP BY 1, 2),
r AS (SELECT w.*, CASE WHEN owners > 1 THEN 'conflict' WHEN EXISTS (SELECT 1 FROM k WHERE k.kind = w.kind AND k.value = w.value AND k.source_id = w.source_id) THEN 'already there' ELSE 'attached' END AS outcome FROM w JOIN n USING (kind, value))
SELECT kind, value, source_id, outcome = 'attached' AND source_id NOT IN (SELECT source_id FROM k) AND row_number() OVER (PARTITION BY source_id ORDER BY outcome = 'attached' DESC, kind, value) = 1 AS is_primary, outcome FROM r""",
    "observation_contexts": """SELECT document_id, string_agg(DISTINCT source_id, ',' ORDER BY source_id) AS coverage_ids, string_agg(DISTINCT predicate, ',' ORDER BY predicate) AS scope_ids, 'explicit_coverage' AS mode
FROM observation WHERE document_id IS NOT NULL GROUP BY 1""",
}
