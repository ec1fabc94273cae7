"""Queries on page signals over texts made from the tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import pages, text
from ledgerloom.session import table


def _address_text():
    return F.concat(F.lit("Head office: "), F.array_join("address_lines", ", "), F.lit(", "), F.coalesce("locality", F.lit("")), F.lit(" "), F.coalesce("region", F.lit("")), F.lit(" "), F.coalesce("postal_code", F.lit("")))


def written_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Addresses found in the locations written as a line of text."""
    rows = table(spark, d, "org_location").select("location_id", _address_text().alias("line")).distinct()
    return rows.select("location_id", F.explode(pages.addresses_in(F.col("line"))).alias("a")).select("location_id", F.lower("a.street").alias("street"), F.lower("a.locality").alias("locality"), "a.state", "a.postcode").distinct()


def written_identifiers(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers found where every sighting of an organisation is written as text: only those with the digits of their scheme."""
    said = table(spark, d, "organisation_identifier").where("scheme <> 'company_number'").select("org_id", F.concat(F.upper("scheme"), F.lit(": "), "value", F.lit(".")).alias("s")).distinct()
    rows = said.groupBy("org_id").agg(F.array_join(F.array_sort(F.collect_list("s")), " ; ").alias("line"))
    return rows.select("org_id", F.explode(pages.identifiers_in(F.col("line"))).alias("i")).select("org_id", "i.*")


def legal_names(spark: SparkSession, d: str) -> DataFrame:
    """Canonical names that stand with a legal suffix among an organisation's other names."""
    rows = table(spark, d, "organisation").select("org_id", "canonical_name", F.concat_ws(" | ", "legal_name", F.array_join("trading_names", " | ")).alias("line")).distinct()
    return rows.select("org_id", pages.legal_name_on(F.col("line"), F.col("canonical_name")).alias("legal_name")).where("legal_name is not null").distinct()


def name_spellings(spark: SparkSession, d: str) -> DataFrame:
    """Names of each organisation without those that differ in case only, in their order."""
    names = F.array_compact(F.concat(F.array("canonical_name", "legal_name"), F.coalesce("trading_names", F.array().cast("array<string>"))))
    return table(spark, d, "organisation").dropDuplicates(["org_id"]).select("org_id", F.array_join(pages.first_spellings(names), " | ").alias("names"))


def document_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Street addresses in document texts, without their town: house number and street of one word."""
    found = F.regexp_extract_all("text", F.lit(r"(\b\d{1,4} [A-Z][a-z]+ (?:Street|Road|Avenue|Drive|Court|Place|Parade|Terrace|Lane)\b)"), 1)
    return table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(found)).alias("address"))


def website_hosts(spark: SparkSession, d: str) -> DataFrame:
    """Hosts of observed websites and how many organisations give them."""
    seen = table(spark, d, "observation").where("predicate = 'website_domain' and normalisation_status <> 'rejected'")
    return seen.groupBy(text.bare_host(F.col("object_value")).alias("host")).agg(F.countDistinct("org_id").alias("organisations"))


QUERIES = {f.__name__: f for f in (written_addresses, written_identifiers, legal_names, name_spellings, document_addresses, website_hosts)}

_LINE = "'Head office: ' || array_to_string(address_lines, ', ') || ', ' || coalesce(locality, '') || ' ' || coalesce(region, '') || ' ' || coalesce(postal_code, '')"
_ADDRESS = pages.ADDRESS.replace("'", "''")
_HOST = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(object_value)), '^[a-z][a-z0-9+.\-]*://|^//', ''), '[/?#].*$', ''), '^.*@|:\d*$', '', 'g'), '^www\.', '')"
SQL = {
    "written_addresses": f"""WITH l AS (SELECT DISTINCT location_id, {_LINE} AS line FROM org_location),
g AS (SELECT location_id, {', '.join(f"unnest(regexp_extract_all(line, '{_ADDRESS}', {i})) AS g{i}" for i in (1, 2, 3, 4))} FROM l)
SELECT DISTINCT location_id, lower(trim(g1)) AS street, lower(trim(g2)) AS locality, upper(g3) AS state, g4 AS postcode FROM g""",
    "written_identifiers": rf"""WITH s AS (SELECT DISTINCT org_id, upper(scheme) || ': ' || value || '.' AS s FROM organisation_identifier WHERE scheme <> 'company_number'),
l AS (SELECT org_id, string_agg(s, ' ; ' ORDER BY s) AS line FROM s GROUP BY 1), x AS (SELECT org_id, unnest(regexp_extract_all(line, '{pages.IDENTIFIER}', 1)) AS x FROM l),
p AS (SELECT DISTINCT org_id, lower(regexp_extract(x, '^([A-Za-z]+)', 1)) AS scheme, regexp_replace(x, '\D', '', 'g') AS value FROM x)
SELECT * FROM p WHERE length(value) = CASE scheme WHEN 'abn' THEN 11 WHEN 'acn' THEN 9 ELSE 13 END""",
    "name_spellings": """WITH o AS (SELECT org_id, list_filter([canonical_name, legal_name] || coalesce(trading_names, []), lambda x: x IS NOT NULL) AS n FROM (SELECT DISTINCT * FROM organisation)),
l AS (SELECT org_id, n, list_transform(n, lambda x: lower(x)) AS low FROM o) SELECT org_id, array_to_string(list_filter(n, lambda v, i: list_position(low, lower(v)) = i), ' | ') AS names FROM l""",
    "document_addresses": r"""SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '(\b\d{1,4} [A-Z][a-z]+ (?:Street|Road|Avenue|Drive|Court|Place|Parade|Terrace|Lane)\b)', 1)) AS address FROM documents""",
    "website_hosts": f"SELECT {_HOST} AS host, count(DISTINCT org_id) AS organisations FROM observation WHERE predicate = 'website_domain' AND normalisation_status <> 'rejected' GROUP BY 1",
}
