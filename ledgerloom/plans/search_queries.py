"""Queries that search, verify and list, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import verification
from ledgerloom.session import table


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Observed websites with a page made of what else is observed: names, phones, emails and places of the organisation."""
    obs = table(spark, d, "observation").where("normalisation_status <> 'rejected'")
    hosts = obs.where("predicate = 'website_domain'").select("org_id", text.bare_host(F.col("object_value")).alias("host")).distinct()
    body = obs.where("predicate in ('trading_name', 'phone', 'email', 'location')").select("org_id", "object_value").distinct().groupBy("org_id").agg(
        F.array_join(F.array_sort(F.collect_list("object_value")), " | ").alias("text"))
    return hosts.join(body, "org_id")


def website_checks(spark: SparkSession, d: str) -> DataFrame:
    """How far each observed website shows the identity of its organisation."""
    org = table(spark, d, "organisation").dropDuplicates(["org_id"]).select("org_id", F.coalesce("legal_name", "canonical_name").alias("name"), F.array_compact(F.array("canonical_name", "legal_name")).alias("names"))
    ids = table(spark, d, "organisation_identifier").groupBy("org_id").agg(F.collect_set("value").alias("identifiers"))
    loc = table(spark, d, "org_location").groupBy("org_id").agg(F.array_compact(F.array_distinct(F.flatten(F.collect_list(F.array("locality", "region", "postal_code"))))).alias("places"))
    out = verification.verified(_pages(spark, d), org.join(ids, "org_id", "left").join(loc, "org_id", "left"))
    return out.select("org_id", "host", "score", F.array_join("signs", ",").alias("signs"), "accepted")


def entities_named(spark: SparkSession, d: str) -> DataFrame:
    """All live organisations that 'crane' stands in: names, identifiers or websites."""
    domains = table(spark, d, "observation").where("predicate = 'website_domain'").select("org_id", text.bare_host(F.col("object_value")).alias("domain")).distinct()
    return verification.entity_search(table(spark, d, "organisation"), table(spark, d, "organisation_identifier"), domains, "crane")


def newest_documents(spark: SparkSession, d: str) -> DataFrame:
    """The hundred newest documents with the category of their source: a top-k report."""
    key = F.regexp_replace(F.lower(F.trim("source")), r"[\s\-]+", "_")
    src = table(spark, d, "source_definition").groupBy("name").agg(F.min("source_category").alias("category"))
    rows = table(spark, d, "documents").select("doc_id", key.alias("name"), "retrieved_at").join(F.broadcast(src), "name", "left")  # 64 sources, fixed
    return verification.newest(rows, "retrieved_at", "doc_id", 100).select("doc_id", "name", "category")


def newest_runs(spark: SparkSession, d: str) -> DataFrame:
    """The newest import runs: a top-k report."""
    return verification.newest(table(spark, d, "bulk_import_run"), "created_at", "run_id", 50).select("run_id", "dataset_name", "status")


def observation_steps(spark: SparkSession, d: str) -> DataFrame:
    """How many observations are raw, normalised, rejected, verified and late: one pass."""
    rows = table(spark, d, "observation").distinct()
    late = F.unix_micros("received_at") - F.unix_micros("observed_at") > 180 * 86_400_000_000
    return verification.state_counts(rows, {**{s: F.col("normalisation_status") == s for s in ("raw", "normalised", "rejected")}, "verified": F.col("human_verified"), "late": late})


QUERIES = {f.__name__: f for f in (website_checks, entities_named, newest_documents, newest_runs, observation_steps)}

_HOST = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(object_value)), '^[a-z][a-z0-9+.\-]*://|^//', ''), '[/?#].*$', ''), '^.*@|:\d*$', '', 'g'), '^www\.', '')"
_NAME = r"regexp_replace(trim(regexp_replace(replace(lower(regexp_replace(strip_accents({0}), '[^\x00-\x7F]', '', 'g')), '&', ' and '), '[^a-z0-9]+', ' ', 'g')), '([a-z0-9])( (?:pty|ltd|limited|inc|incorporated|llc|plc|corp|corporation|gmbh|bv|nv))+$', '\1')"
_TIDY = r"regexp_replace(lower(trim({0})), '\s+', ' ', 'g')"
_IDENT = r"upper(regexp_replace({0}, '[\s\-./]', '', 'g'))"
_KEY = r"regexp_replace(lower(trim(source)), '[\s\-]+', '_', 'g')"
SQL = {
    "website_checks": rf"""WITH obs AS (SELECT * FROM observation WHERE normalisation_status <> 'rejected'),
h AS (SELECT DISTINCT org_id, {_HOST} AS host FROM obs WHERE predicate = 'website_domain'),
b AS (SELECT org_id, string_agg(object_value, ' | ' ORDER BY object_value) AS text FROM (SELECT DISTINCT org_id, object_value FROM obs WHERE predicate IN ('trading_name', 'phone', 'email', 'location')) GROUP BY 1),
o AS (SELECT org_id, coalesce(legal_name, canonical_name) AS name, canonical_name AS n1, legal_name AS n2 FROM (SELECT DISTINCT * FROM organisation)),
p AS (SELECT h.*, b.text, o.name, n1, n2, {_NAME.format('text')} AS page, {_TIDY.format('text')} AS folded, {_IDENT.format('text')} AS compact FROM h JOIN b USING (org_id) JOIN o USING (org_id)),
s AS (SELECT p.org_id, host, {_NAME.format('name')} <> '' AND contains(page, {_NAME.format('name')}) AS a,
  coalesce((SELECT bool_or(contains(p.compact, {_IDENT.format('i.value')})) FROM organisation_identifier i WHERE i.org_id = p.org_id), false) AS b,
  coalesce(trim(n1) <> '' AND contains(folded, {_TIDY.format('n1')}), false) OR coalesce(trim(n2) <> '' AND contains(folded, {_TIDY.format('n2')}), false) AS c,
  coalesce((SELECT bool_or((length(locality) >= 3 AND contains(p.folded, lower(locality))) OR (length(region) >= 3 AND contains(p.folded, lower(region))) OR (length(postal_code) >= 3 AND contains(p.folded, lower(postal_code))))
            FROM org_location l WHERE l.org_id = p.org_id), false) AS d,
  coalesce(list_bool_or(list_transform(regexp_extract_all(text, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{{2,}}'), lambda e: regexp_replace(lower(regexp_extract(e, '@(.*)$', 1)), '^www\.', '') = host)), false) AS e FROM p),
t AS (SELECT *, round(least(1.0, CASE WHEN a THEN 0.55 ELSE 0 END + CASE WHEN b THEN 0.5 ELSE 0 END + CASE WHEN c THEN 0.2 ELSE 0 END + CASE WHEN d THEN 0.15 ELSE 0 END + CASE WHEN e THEN 0.15 ELSE 0 END)::DOUBLE, 3) AS score FROM s)
SELECT org_id, host, score, concat_ws(',', CASE WHEN a THEN 'name' END, CASE WHEN b THEN 'identifier' END, CASE WHEN c THEN 'exact_name' END, CASE WHEN d THEN 'geography' END, CASE WHEN e THEN 'email' END) AS signs,
score >= 0.7 AND (b OR c OR d) AS accepted FROM t""",
    "entities_named": rf"""SELECT DISTINCT org_id, canonical_name FROM organisation WHERE (merged_into_id IS NULL OR trim(merged_into_id) = '') AND (canonical_name ILIKE '%crane%' OR coalesce(legal_name ILIKE '%crane%', false)
OR org_id IN (SELECT org_id FROM organisation_identifier WHERE {_IDENT.format('value')} ILIKE '%crane%') OR org_id IN (SELECT org_id FROM observation WHERE predicate = 'website_domain' AND {_HOST} ILIKE '%crane%'))""",
    "newest_documents": f"""WITH s AS (SELECT name, min(source_category) AS category FROM source_definition GROUP BY 1)
SELECT doc_id, {_KEY} AS name, category FROM documents LEFT JOIN s ON s.name = {_KEY} ORDER BY retrieved_at DESC, doc_id LIMIT 100""",
    "newest_runs": "SELECT run_id, dataset_name, status FROM bulk_import_run ORDER BY created_at DESC, run_id LIMIT 50",
    "observation_steps": """WITH o AS (SELECT DISTINCT * FROM observation)
SELECT unnest(['raw', 'normalised', 'rejected', 'verified', 'late']) AS step, unnest([count(*) FILTER (normalisation_status = 'raw'), count(*) FILTER (normalisation_status = 'normalised'), count(*) FILTER (normalisation_status = 'rejected'),
count(*) FILTER (human_verified), count(*) FILTER (epoch_us(received_at) - epoch_us(observed_at) > 180 * 86400000000)]) AS n FROM o""",
}
