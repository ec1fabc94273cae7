"""Queries on imports, versions, identities and profiles, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import geography as geo
from ledgerloom.functions import text
from ledgerloom.operators import records
from ledgerloom.operators.bad_rows import parse_records
from ledgerloom.plans.data_problems import _P6_PARSE
from ledgerloom.session import table

KINDS = ("phone", "email", "website_domain", "registration_status", "employee_count_band", "trading_name")


def import_counters(spark: SparkSession, d: str) -> DataFrame:
    """Rows, loaded and rejected rows per run, and how far the recorded row count is off (null for a run that is not in the
    table); runs without records count none."""
    rows = parse_records(table(spark, d, "import_record"), table(spark, d, "bulk_import_run"))
    counts = rows.groupBy("run_id").agg(F.count("*").alias("rows"), F.count_if(F.col("reason").isNull()).alias("loaded"), F.count_if(F.col("reason").isNotNull()).alias("rejected"))
    runs = table(spark, d, "bulk_import_run").groupBy("run_id").agg(F.max("row_count").alias("said"))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return runs.join(counts, "run_id", "full").select("run_id", none("rows"), none("loaded"), none("rejected"), (F.col("said") - F.coalesce("rows", F.lit(0))).alias("off"))


def import_observations(spark: SparkSession, d: str) -> DataFrame:
    """Typed observations of the import rows; cells that are not valid stay, marked rejected with no confidence."""
    rows = parse_records(table(spark, d, "import_record"), table(spark, d, "bulk_import_run")).where("reason is null or reason in ('invalid_email', 'invalid_phone')")
    cell = lambda p, c, bad: F.struct(F.lit(p).alias("predicate"), F.trim(F.col(c)).alias("value"), F.coalesce(F.col("reason") == bad, F.lit(False)).alias("bad"))
    cells = rows.select("run_id", "line_no", F.explode(F.array(cell("canonical_name", "name", ""), cell("email", "email", "invalid_email"), cell("phone", "phone", "invalid_phone"))).alias("c"))
    return cells.where("c.value <> ''").select("run_id", "line_no", "c.predicate", "c.value", F.when(F.col("c.bad"), "rejected").otherwise("raw").alias("normalisation_status"),
                                               F.when(F.col("c.bad"), 0.0).otherwise(0.9).alias("confidence"))


def identity_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers and how many organisations claim them; the owner only where it is one."""
    ids = table(spark, d, "organisation_identifier").select("org_id", "scheme", text.identifier_key(F.col("value")).alias("value_key"))
    return records.resolve_identities(ids.select("scheme", "value_key").distinct(), ids, ["scheme", "value_key"], "org_id")


def status_as_of(spark: SparkSession, d: str) -> DataFrame:
    """For each phone observation the registration status that held for its organisation at that time."""
    obs = table(spark, d, "observation").where("normalisation_status <> 'rejected'")
    phones = obs.where("predicate = 'phone'").select("observation_id", "org_id", "observed_at").distinct()
    status = obs.where("predicate = 'registration_status' and valid_from is not null").select("org_id", "valid_from", text.value_key(F.col("object_value")).alias("status"))
    return records.as_of_join(phones, status, "org_id", "observed_at", "valid_from", ["status"]).select("observation_id", "status")


def places_under(spark: SparkSession, d: str) -> DataFrame:
    """Locations by place code related to wanted codes, ancestors and descendants alike; without a country they count as Australian."""
    country = F.when(F.upper("country").isin("NZ", "NEW ZEALAND") | (F.upper("region") == "WGN"), "NZ").otherwise("AU")
    code = F.concat_ws("-", geo.row_code(country, F.col("region")), F.upper(F.replace(F.nullif(F.trim("locality"), F.lit("")), F.lit(" "), F.lit("_"))))
    loc = table(spark, d, "org_location").select("location_id", F.when(geo.row_code(country, F.col("region")).isNotNull(), code).alias("code")).distinct()
    wanted = spark.createDataFrame([("AU-QLD",), ("NZ",), ("AU-VIC-NOWHERE-ELSE",)], "wanted string")
    return records.related_places(loc, wanted, "code", "wanted").select("location_id", "code", "wanted")


def document_novelty(spark: SparkSession, d: str) -> DataFrame:
    """Whether each document's text was new in its source when it was retrieved."""
    docs = table(spark, d, "documents").select("doc_id", F.lower(F.trim("source")).alias("source"), "text", "retrieved_at")
    return records.first_seen(docs, ["source"], "text", "retrieved_at", "doc_id").select("doc_id", "source", "novel")


def fact_changes(spark: SparkSession, d: str) -> DataFrame:
    """Facts against the latest observation of the same organisation and predicate: created, updated, unchanged, removed."""
    facts = table(spark, d, "fact_assertion").where("status <> 'disproven' and value is not null").groupBy("org_id", "predicate").agg(
        F.max_by(text.value_key(F.col("value")), F.struct("final_confidence", "assertion_id")).alias("value"))
    seen = table(spark, d, "observation").where("normalisation_status <> 'rejected'").groupBy("org_id", "predicate").agg(
        F.max_by(text.value_key(F.col("object_value")), F.struct("observed_at", "observation_id")).alias("value"))
    return records.table_diff(facts, seen, ["org_id", "predicate"], ["value"])


def organisation_profiles(spark: SparkSession, d: str) -> DataFrame:
    """One row per organisation: latest value of six predicates, counts of identifiers, locations and facts."""
    obs = table(spark, d, "observation").where("normalisation_status <> 'rejected'")
    last = obs.groupBy("org_id").agg(*[F.max_by("object_value", F.when(F.col("predicate") == k, F.struct("observed_at", "observation_id"))).alias(k) for k in KINDS])
    count = lambda t, c, n: table(spark, d, t).groupBy("org_id").agg(F.countDistinct(c).alias(n))
    out = table(spark, d, "organisation").select("org_id").distinct().join(last, "org_id", "left")
    for t, c, n in (("organisation_identifier", "identifier_id", "identifiers"), ("org_location", "location_id", "locations"), ("fact_assertion", "assertion_id", "facts")):
        out = out.join(count(t, c, n), "org_id", "left")
    return out.select("org_id", *KINDS, *[F.coalesce(n, F.lit(0)).alias(n) for n in ("identifiers", "locations", "facts")])


def document_identifiers(spark: SparkSession, d: str) -> DataFrame:
    """Runs of eleven digits, grouped or not, in document texts."""
    found = F.regexp_extract_all("text", F.lit(r"(\b\d{2}[ .\-]?\d{3}[ .\-]?\d{3}[ .\-]?\d{3}\b)"), 1)
    return table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, "[^0-9]", "")))).alias("identifier"))


QUERIES = {f.__name__: f for f in (import_counters, import_observations, identity_conflicts, status_as_of, places_under, document_novelty, fact_changes, organisation_profiles, document_identifiers)}

_LAST = ", ".join(f"arg_max(object_value, struct_pack(a := observed_at, b := observation_id)) FILTER (predicate = '{k}') AS {k}" for k in KINDS)
SQL = {
    "import_counters": f"""WITH {_P6_PARSE}, runs2 AS (SELECT run_id, max(row_count) AS said FROM bulk_import_run GROUP BY 1),
every AS (SELECT run_id, reason FROM reasons UNION ALL SELECT DISTINCT run_id, 'unknown_format' FROM (SELECT DISTINCT * FROM import_record) WHERE run_id NOT IN (SELECT run_id FROM runs2)),
counts AS (SELECT run_id, count(*) AS rows, count(*) FILTER (reason IS NULL) AS loaded, count(*) FILTER (reason IS NOT NULL) AS rejected FROM every GROUP BY 1)
SELECT run_id, coalesce(rows, 0) AS rows, coalesce(loaded, 0) AS loaded, coalesce(rejected, 0) AS rejected, CAST(said - coalesce(rows, 0) AS BIGINT) AS off FROM counts FULL JOIN runs2 USING (run_id)""",
    "import_observations": f"""WITH {_P6_PARSE}, good AS (SELECT * FROM reasons WHERE reason IS NULL OR reason IN ('invalid_email', 'invalid_phone')),
cells AS (SELECT run_id, line_no, 'canonical_name' AS predicate, trim(name) AS value, false AS bad FROM good
  UNION ALL SELECT run_id, line_no, 'email', trim(email), coalesce(reason = 'invalid_email', false) FROM good
  UNION ALL SELECT run_id, line_no, 'phone', trim(phone), coalesce(reason = 'invalid_phone', false) FROM good)
SELECT run_id, line_no, predicate, value, CASE WHEN bad THEN 'rejected' ELSE 'raw' END AS normalisation_status, CAST(CASE WHEN bad THEN 0.0 ELSE 0.9 END AS DOUBLE) AS confidence FROM cells WHERE value <> ''""",
    "identity_conflicts": r"""SELECT scheme, upper(regexp_replace(value, '[\s\-./]', '', 'g')) AS value_key, CASE WHEN count(DISTINCT org_id) = 1 THEN min(org_id) END AS org_id,
count(DISTINCT org_id) AS owners FROM organisation_identifier GROUP BY 1, 2""",
    "status_as_of": """WITH o AS (SELECT DISTINCT observation_id, org_id, observed_at FROM observation WHERE normalisation_status <> 'rejected' AND predicate = 'phone'),
s AS (SELECT org_id, valid_from, max(lower(trim(object_value))) AS status FROM observation WHERE normalisation_status <> 'rejected' AND predicate = 'registration_status' AND valid_from IS NOT NULL GROUP BY 1, 2)
SELECT o.observation_id, s.status FROM o ASOF LEFT JOIN s ON o.org_id = s.org_id AND o.observed_at >= s.valid_from""",
    "places_under": """WITH l AS (SELECT location_id, trim(locality) AS town, CASE WHEN upper(country) IN ('NZ', 'NEW ZEALAND') OR upper(region) = 'WGN' THEN 'NZ' ELSE 'AU' END AS c, upper(trim(coalesce(region, ''))) AS r FROM org_location),
s AS (SELECT *, CASE r WHEN 'AUSTRALIAN CAPITAL TERRITORY' THEN 'ACT' WHEN 'NEW SOUTH WALES' THEN 'NSW' WHEN 'NORTHERN TERRITORY' THEN 'NT' WHEN 'QUEENSLAND' THEN 'QLD' WHEN 'SOUTH AUSTRALIA' THEN 'SA' WHEN 'TASMANIA' THEN 'TAS'
  WHEN 'VICTORIA' THEN 'VIC' WHEN 'WESTERN AUSTRALIA' THEN 'WA' ELSE r END AS short FROM l),
p AS (SELECT DISTINCT location_id, concat_ws('-', CASE WHEN r = '' THEN c WHEN c = 'AU' AND short IN ('ACT', 'NSW', 'NT', 'QLD', 'SA', 'TAS', 'VIC', 'WA') THEN 'AU-' || short
  WHEN c = 'NZ' AND r IN ('AUK', 'BOP', 'CAN', 'GIS', 'HKB', 'MBH', 'MWT', 'NSN', 'NTL', 'OTA', 'STL', 'TAS', 'TKI', 'WGN', 'WKO', 'WTC') THEN 'NZ-' || r END, upper(replace(nullif(town, ''), ' ', '_'))) AS code,
  r = '' OR (c = 'AU' AND short IN ('ACT', 'NSW', 'NT', 'QLD', 'SA', 'TAS', 'VIC', 'WA')) OR (c = 'NZ' AND r IN ('AUK', 'BOP', 'CAN', 'GIS', 'HKB', 'MBH', 'MWT', 'NSN', 'NTL', 'OTA', 'STL', 'TAS', 'TKI', 'WGN', 'WKO', 'WTC')) AS ok FROM s)
SELECT location_id, code, wanted FROM p, (VALUES ('AU-QLD'), ('NZ'), ('AU-VIC-NOWHERE-ELSE')) v(wanted)
WHERE ok AND (code = wanted OR starts_with(code, wanted || '-') OR starts_with(wanted, code || '-'))""",
    "document_novelty": """SELECT doc_id, lower(trim(source)) AS source, row_number() OVER (PARTITION BY lower(trim(source)), sha256(text) ORDER BY retrieved_at, doc_id) = 1 AS novel FROM documents""",
    "fact_changes": """WITH f AS (SELECT org_id, predicate, arg_max(lower(trim(value)), struct_pack(a := final_confidence, b := assertion_id)) AS v FROM fact_assertion
  WHERE status <> 'disproven' AND value IS NOT NULL GROUP BY 1, 2),
o AS (SELECT org_id, predicate, arg_max(lower(trim(object_value)), struct_pack(a := observed_at, b := observation_id)) AS v FROM observation WHERE normalisation_status <> 'rejected' GROUP BY 1, 2)
SELECT org_id, predicate, CASE WHEN f.v IS NULL THEN 'created' WHEN o.v IS NULL THEN 'removed' WHEN f.v = o.v THEN 'unchanged' ELSE 'updated' END AS change
FROM f FULL JOIN o USING (org_id, predicate)""",
    "organisation_profiles": f"""WITH l AS (SELECT org_id, {_LAST} FROM observation WHERE normalisation_status <> 'rejected' GROUP BY org_id)
SELECT o.org_id, {', '.join(KINDS)}, coalesce(i.n, 0) AS identifiers, coalesce(p.n, 0) AS locations, coalesce(f.n, 0) AS facts FROM (SELECT DISTINCT org_id FROM organisation) o LEFT JOIN l USING (org_id)
LEFT JOIN (SELECT org_id, count(DISTINCT identifier_id) AS n FROM organisation_identifier GROUP BY 1) i USING (org_id)
LEFT JOIN (SELECT org_id, count(DISTINCT location_id) AS n FROM org_location GROUP BY 1) p USING (org_id)
LEFT JOIN (SELECT org_id, count(DISTINCT assertion_id) AS n FROM fact_assertion GROUP BY 1) f USING (org_id)""",
    "document_identifiers": r"""SELECT DISTINCT doc_id, regexp_replace(unnest(regexp_extract_all(text, '\b\d{2}[ .\-]?\d{3}[ .\-]?\d{3}[ .\-]?\d{3}\b')), '[^0-9]', '', 'g') AS identifier FROM documents""",
}
