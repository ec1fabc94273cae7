"""Queries on bulk imports as a whole, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import geography as geo
from ledgerloom.operators import imports
from ledgerloom.operators.bad_rows import parse_records
from ledgerloom.plans.data_problems import _P6_PARSE
from ledgerloom.session import Stash, table

FIELDS = ("name", "legal_name", "identifier", "registration_status", "domain", "street_address", "locality", "region", "postcode", "country", "email", "phone", "employees_band", "pack_id", "service_claim")
VERSION = "import/1"


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Rows of all runs in a scope: Australia without Victoria, rows without a place kept."""
    runs = table(spark, d, "bulk_import_run")
    parsed = Stash(spark).put(parse_records(table(spark, d, "import_record"), runs))
    matched = imports.match_imports(parsed, runs, table(spark, d, "organisation"), table(spark, d, "organisation_identifier"), table(spark, d, "org_location")).where("org_id is not null")
    rows = imports.with_fields(parsed, runs, FIELDS)
    place = geo.row_code(F.coalesce("f_country", F.when(F.col("f_region") == "WGN", "NZ").otherwise("AU")), F.col("f_region"))
    facets = {"service": F.split("f_service_claim", r"[|;,]")}
    scope = imports.scope_outcome(place, F.col("f_pack_id"), facets, ["AU"], ["AU-VIC"], [], {"service": {"exclude": ["unrelated"]}}, True)
    return imports.import_outcomes(rows, matched, scope)


def import_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return _outcomes(spark, d).select("run_id", "line_no", "outcome", F.when(F.col("outcome") == "matched", F.col("org_id")).alias("matched_id"))


def import_report(spark: SparkSession, d: str) -> DataFrame:
    out = imports.import_report(_outcomes(spark, d))
    return out.withColumn("samples", F.array_join(F.transform("samples", lambda s: F.concat_ws(":", s["line_no"].cast("string"), s["reason"])), ","))


def import_statements(spark: SparkSession, d: str) -> DataFrame:
    """How many observations of each kind every run brings, valid and rejected, and of how many organisations."""
    return imports.import_statements(_outcomes(spark, d)).groupBy("run_id", "predicate", "normalisation_status").agg(F.count("*").alias("statements"), F.min("confidence").alias("confidence"))


def import_run_checks(spark: SparkSession, d: str) -> DataFrame:
    """Runs whose mapping cannot be used, and runs that repeat an earlier one."""
    runs = table(spark, d, "bulk_import_run")
    bad = F.udf(lambda m: "; ".join(imports.mapping_problems(m)), "string")  # one call per run, a few dozen
    again = imports.repeated_runs(runs, table(spark, d, "import_record"), VERSION)
    return runs.select("run_id", bad(F.coalesce("mapping", F.lit(""))).alias("problems")).distinct().join(again, "run_id", "left")


def import_row_places(spark: SparkSession, d: str) -> DataFrame:
    """The most specific place code of each location by its own country and region, and how many have it."""
    code = geo.row_code(F.when(F.upper("country").isin("AU", "AUSTRALIA"), "AU").when(F.upper("country").isin("NZ", "NEW ZEALAND"), "NZ").otherwise(F.upper("country")), F.col("region"))
    return table(spark, d, "org_location").select("location_id", code.alias("code")).distinct().groupBy("code").agg(F.count("*").alias("locations"))


QUERIES = {f.__name__: f for f in (import_outcomes, import_report, import_statements, import_run_checks, import_row_places)}

_NAME = r"""regexp_replace(trim(regexp_replace(replace(lower(regexp_replace(strip_accents({0}), '[^\x00-\x7F]', '', 'g')), '&', ' and '), '[^a-z0-9]+', ' ', 'g')), '([a-z0-9])( (?:pty|ltd|limited|inc|incorporated|llc|plc|corp|corporation|gmbh|bv|nv))+$', '\1')"""
_IDENT = r"nullif(upper(regexp_replace({0}, '[\s\-./]', '', 'g')), '')"


def _cell(c: str) -> str:
    return f"nullif(trim(s.f[list_position(s.header, json_extract_string(s.mapping, '$.columns.{c}'))]), '')"


_STATES = {"AUSTRALIAN CAPITAL TERRITORY": "ACT", "NEW SOUTH WALES": "NSW", "NORTHERN TERRITORY": "NT", "QUEENSLAND": "QLD", "SOUTH AUSTRALIA": "SA", "TASMANIA": "TAS", "VICTORIA": "VIC", "WESTERN AUSTRALIA": "WA"}
_SHORT = "CASE upper(region) " + " ".join(f"WHEN '{n}' THEN '{c}'" for n, c in _STATES.items()) + " ELSE upper(region) END"
_AU = "('ACT', 'NSW', 'NT', 'QLD', 'SA', 'TAS', 'VIC', 'WA')"
_OUT = f"""{_P6_PARSE}, cells AS (SELECT r.run_id, r.line_no, r.reason, {', '.join(f'{_cell(c)} AS {c}' for c in ('name', 'identifier', 'domain', 'locality', 'region', 'postcode', 'email', 'phone', 'employees_band'))}
  FROM reasons r JOIN split s USING (run_id, line_no)),
placed AS (SELECT *, {_NAME.format('name')} AS name_key, {_IDENT.format('identifier')} AS ident, lower(locality) AS town,
  CASE WHEN region IS NULL THEN 'AU' WHEN region = 'WGN' THEN 'NZ-WGN' WHEN {_SHORT} IN {_AU} THEN 'AU-' || {_SHORT} END AS code FROM cells),
ids AS (SELECT {_IDENT.format('value')} AS ident, min(org_id) AS by_id FROM organisation_identifier WHERE scheme = 'abn' GROUP BY 1 HAVING count(DISTINCT org_id) = 1),
places AS (SELECT {_NAME.format('canonical_name')} AS name_key, lower(trim(locality)) AS town, min(o.org_id) AS by_place FROM organisation o JOIN org_location l USING (org_id) WHERE locality IS NOT NULL GROUP BY 1, 2
  HAVING count(DISTINCT o.org_id) = 1),
outs AS (SELECT p.*, CASE WHEN reason IN ('broken_quoting', 'column_count', 'missing_name') OR name IS NULL THEN 'rejected'
  WHEN NOT (code IS NULL OR (starts_with(code, 'AU') AND code NOT IN ('AU-VIC', 'AU'))) THEN 'out_of_scope'
  WHEN reason IS NULL AND coalesce(by_id, by_place) IS NOT NULL THEN 'matched' ELSE 'imported' END AS outcome, CASE WHEN reason IS NULL THEN coalesce(by_id, by_place) END AS known
  FROM placed p LEFT JOIN ids ON p.ident = ids.ident LEFT JOIN places ON p.name_key = places.name_key AND p.town = places.town)"""
_HOST = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(domain)), '^[a-z][a-z0-9+.\-]*://|^//', ''), '[/?#].*$', ''), '^.*@|:\d*$', '', 'g'), '^www\.', '')"
_KINDS = (("canonical_name", "name", "true", 0.9), ("registration_identifier", "identifier", "true", 0.9), ("website_domain", "domain", rf"regexp_full_match({_HOST}, '[^\s.]+(\.[^\s.]+)+')", 0.9),
          ("email", "email", r"regexp_full_match(lower(email), '[^@\s]+@[^@\s.]+(\.[^@\s.]+)+')", 0.85), ("phone", "phone", "length(regexp_replace(phone, '[^0-9]', '', 'g')) >= 8", 0.85),
          ("employee_count_band", "employees_band", "employees_band IN ('1-4', '5-19', '20-49', '50-199', '200+')", 0.85), ("location", "coalesce(locality, region, postcode)", "true", 0.85))
SQL = {
    "import_outcomes": f"WITH {_OUT} SELECT run_id, line_no, outcome, CASE WHEN outcome = 'matched' THEN known END AS matched_id FROM outs",
    "import_report": f"""WITH {_OUT}, s AS (SELECT run_id, line_no, coalesce(reason, 'missing_name') AS reason FROM outs WHERE outcome = 'rejected' QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY line_no) <= 20),
t AS (SELECT run_id, string_agg(line_no || ':' || reason, ',' ORDER BY line_no) AS samples FROM s GROUP BY 1)
SELECT run_id, count(*) AS rows, count(*) FILTER (outcome = 'imported') AS imported, count(*) FILTER (outcome = 'matched') AS matched, count(*) FILTER (outcome = 'out_of_scope') AS out_of_scope,
count(*) FILTER (outcome = 'rejected') AS rejected, any_value(samples) AS samples FROM outs LEFT JOIN t USING (run_id) GROUP BY run_id""",
    "import_statements": f"""WITH {_OUT}, st AS ({' UNION ALL '.join(f"SELECT run_id, '{p}' AS predicate, coalesce({ok}, false) AS ok, {c} AS confidence FROM outs WHERE outcome IN ('matched', 'imported') AND {v} IS NOT NULL" for p, v, ok, c in _KINDS)})
SELECT run_id, predicate, CASE WHEN ok THEN 'normalised' ELSE 'rejected' END AS normalisation_status, count(*) AS statements, CAST(min(CASE WHEN ok THEN confidence ELSE 0 END) AS DOUBLE) AS confidence FROM st GROUP BY 1, 2, 3""",
    "import_run_checks": """WITH c AS (SELECT run_id, string_agg(line_no || chr(1) || coalesce(raw_record, chr(2)), chr(3) ORDER BY line_no, raw_record) AS body FROM (SELECT DISTINCT run_id, line_no, raw_record FROM import_record) GROUP BY 1),
k AS (SELECT r.run_id, mapping, created_at, body FROM (SELECT run_id, any_value(mapping) AS mapping, any_value(created_at) AS created_at FROM bulk_import_run GROUP BY 1) r JOIN c USING (run_id)),
f AS (SELECT run_id, first_value(run_id) OVER (PARTITION BY mapping, body ORDER BY created_at, run_id) AS first_run_id FROM k)
SELECT DISTINCT r.run_id, CASE WHEN json_extract_string(r.mapping, '$.columns.name') IS NULL THEN 'name is not bound to a column' ELSE '' END AS problems, CASE WHEN f.first_run_id <> r.run_id THEN f.first_run_id END AS first_run_id
FROM bulk_import_run r LEFT JOIN f USING (run_id)""",
    "import_row_places": f"""WITH l AS (SELECT location_id, CASE WHEN upper(country) IN ('AU', 'AUSTRALIA') THEN 'AU' WHEN upper(country) IN ('NZ', 'NEW ZEALAND') THEN 'NZ' ELSE upper(country) END AS c, trim(region) AS region FROM org_location),
k AS (SELECT DISTINCT location_id, CASE WHEN coalesce(region, '') <> '' AND c = 'AU' THEN CASE WHEN {_SHORT} IN {_AU} THEN 'AU-' || {_SHORT} END
  WHEN coalesce(region, '') <> '' AND c = 'NZ' THEN CASE WHEN upper(region) IN ('AUK', 'BOP', 'CAN', 'GIS', 'HKB', 'MBH', 'MWT', 'NSN', 'NTL', 'OTA', 'STL', 'TAS', 'TKI', 'WGN', 'WKO', 'WTC') THEN 'NZ-' || upper(region) END
  WHEN coalesce(region, '') = '' THEN c END AS code FROM l) SELECT code, count(*) AS locations FROM k GROUP BY 1""",
}
