"""Queries of the general data problems: hierarchies, rows that fail to parse, history of attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.bad_rows import parse_records
from ledgerloom.operators.hierarchy import descendant_pairs, hierarchy
from ledgerloom.operators.history import HistoryStore, fold_identifier, fold_value
from ledgerloom.session import scratch_folder, table

LINKS = {"parent": "parent_organisation_id", "merge": "merged_into_id"}
LATE = "180 days"


def _linked(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return hierarchy(table(spark, d, "organisation").select("org_id", LINKS[kind]), "org_id", LINKS[kind])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Both hierarchies in one run: ids are marked with the kind of link, so the two stay apart."""
    org = table(spark, d, "organisation").where("org_id is not null")
    marked = lambda kind, c: F.when(F.length(F.trim(c)) > 0, F.concat(F.lit(kind + ":"), c))
    nodes = [org.select(F.concat(F.lit(kind + ":"), "org_id").alias("id"), marked(kind, c).alias("up")) for kind, c in LINKS.items()]
    found = hierarchy(nodes[0].unionByName(nodes[1]), "id", "up", paths=False).where("parent is not null")
    bare = lambda c: F.regexp_replace(c, "^[a-z]+:", "")
    return found.select(F.substring_index("id", ":", 1).alias("hierarchy"), bare("id").alias("org_id"), bare("root").alias("root_org_id"), "depth")


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Ancestor and descendant with their distance, in the parent hierarchy, without the node itself."""
    return descendant_pairs(_linked(spark, d, "parent")).where("distance > 0")


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return parse_records(table(spark, d, "import_record"), table(spark, d, "bulk_import_run"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).where("reason is not null and reason <> 'unknown_format'").select("run_id", "line_no", "reason")


def p6_loaded(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).where("reason is null").select("run_id", "line_no", "name", "email", "phone")


def p6_unknown(spark: SparkSession, d: str) -> DataFrame:
    """Records that no format is known for: their run is not in the table or has no separator or header."""
    return _parsed(spark, d).where("reason = 'unknown_format'").select("run_id", "line_no")


def statements(spark: SparkSession, d: str) -> DataFrame:
    """Sightings of identifiers and dated, not rejected observations as statements; exact duplicates fold away."""
    sightings = table(spark, d, "organisation_identifier").where("first_observed_at is not null").select(
        F.col("org_id").alias("entity_id"), F.col("scheme").alias("attribute"), "value", fold_identifier(F.col("value")).alias("folded"),
        F.col("first_observed_at").alias("start"), F.col("last_observed_at").alias("observed_at"), F.col("identifier_id").alias("tie"),
        F.col("first_observed_at").alias("received_at"))
    said = table(spark, d, "observation").where("valid_from is not null and normalisation_status <> 'rejected'").select(
        F.col("org_id").alias("entity_id"), F.col("predicate").alias("attribute"), F.col("object_value").alias("value"),
        fold_value(F.col("object_value")).alias("folded"), F.col("valid_from").alias("start"), "observed_at",
        F.col("observation_id").alias("tie"), "received_at")
    return sightings.unionByName(said)


def histories(spark: SparkSession, d: str) -> DataFrame:
    """All chains: a first load of what was received until 180 days before the last receipt, then the late rest as an
    update that rebuilds only the chains it touches."""
    rows = statements(spark, d)
    cut = rows.agg((F.max("received_at") - F.expr(f"interval {LATE}")).alias("cut")).first()["cut"]
    store = HistoryStore(spark, scratch_folder(spark, "history"))
    late = F.coalesce(F.col("received_at") > F.lit(cut), F.lit(True)) if cut else F.lit(True)
    store.append(rows.where(~late))
    store.append(rows.where(late))
    return store.history()


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    found = histories(spark, d)
    several = found.where("version_no > 1").select("entity_id", "attribute").distinct()
    return found.join(several, ["entity_id", "attribute"], "left_semi").select(
        F.col("entity_id").alias("org_id"), "attribute", "version_no",
        F.date_format("valid_from", "yyyy-MM-dd HH:mm:ss").alias("valid_from"))


QUERIES = {f.__name__: f for f in (p5_found, p5_descendants, p6_found, p6_loaded, p6_unknown, p7_found)}

_UP = """
links AS (SELECT org_id, min(CASE WHEN trim({col}) <> '' THEN {col} END) AS parent FROM organisation
          WHERE org_id IS NOT NULL GROUP BY org_id),
known AS (SELECT l.org_id, p.org_id AS up FROM links l LEFT JOIN links p ON l.parent = p.org_id),
climb AS (SELECT org_id, org_id AS here, 0 AS depth, [org_id] AS seen, false AS looped FROM known
          UNION ALL
          SELECT c.org_id, k.up, c.depth + 1, list_append(c.seen, k.up), list_contains(c.seen, k.up)
          FROM climb c JOIN known k ON c.here = k.org_id WHERE k.up IS NOT NULL AND NOT c.looped)"""

_P5 = """WITH RECURSIVE {up},
tops AS (SELECT org_id, arg_max(here, depth) AS here, max(depth) AS depth, bool_or(looped) AS looped, arg_max(seen, depth) AS seen
         FROM climb GROUP BY org_id)
SELECT '{kind}' AS hierarchy, t.org_id,
       CASE WHEN looped THEN list_min(list_slice(seen, list_position(seen, here), len(seen))) ELSE here END AS root_org_id,
       CAST(CASE WHEN looped THEN -1 ELSE depth END AS INTEGER) AS depth
FROM tops t JOIN links l USING (org_id) WHERE l.parent IS NOT NULL"""

_P6_PARSE = r"""
runs AS (SELECT run_id, field_sep, any_value(header_line) AS header_line, any_value(mapping) AS mapping
         FROM bulk_import_run GROUP BY run_id, field_sep),
rec AS (SELECT DISTINCT i.run_id, i.line_no, i.raw_record AS raw, r.field_sep AS sep,
               CASE WHEN r.field_sep IN ('|', '^', '\') THEN '\' || r.field_sep ELSE r.field_sep END AS s,
               string_split(r.header_line, r.field_sep) AS header, r.mapping
        FROM import_record i JOIN runs r USING (run_id)),
judged AS (SELECT *, regexp_full_match(raw, '(?s)(?:"(?:[^"]|"")*"|[^"' || s || ']*)(?:' || s || '(?:"(?:[^"]|"")*"|[^"' || s || ']*))*') AS quoted
           FROM rec),
split AS (SELECT *, CASE WHEN quoted THEN list_transform(
             regexp_extract_all(sep || raw, '(?s)' || s || '("(?:[^"]|"")*"|[^"' || s || ']*)', 1),
             lambda f: CASE WHEN f[1] = '"' THEN replace(f[2:-2], '""', '"') ELSE f END) END AS f FROM judged),
val AS (SELECT *, f[list_position(header, json_extract_string(mapping, '$.columns.name'))] AS name,
               f[list_position(header, json_extract_string(mapping, '$.columns.email'))] AS email,
               f[list_position(header, json_extract_string(mapping, '$.columns.phone'))] AS phone FROM split),
trimmed AS (SELECT *, regexp_replace(email, '^\s+|\s+$', '', 'g') AS e, regexp_replace(phone, '^\s+|\s+$', '', 'g') AS p FROM val),
cut AS (SELECT *, regexp_replace(p, '(?i)[\s,;]*(ext|x)\.?:?\s*\d+$', '') AS main FROM trimmed),
reasons AS (SELECT run_id, line_no, name, email, phone, CASE
    WHEN NOT quoted THEN 'broken_quoting'
    WHEN len(f) <> len(header) THEN 'column_count'
    WHEN name IS NULL OR NOT regexp_matches(name, '\p{L}') THEN 'missing_name'
    WHEN e <> '' AND NOT regexp_full_match(e, '[^@\s]+@[^@\s.]+(\.[^@\s.]+)+') THEN 'invalid_email'
    WHEN p <> '' AND NOT (regexp_full_match(main, '[0-9+().\-/\s]*')
         AND length(regexp_replace(main, '[^0-9]', '', 'g')) BETWEEN 8 AND 15) THEN 'invalid_phone' END AS reason FROM cut)
"""

_P7 = r"""WITH said AS (
  SELECT org_id, scheme AS attribute, regexp_replace(upper(value), '[^A-Z0-9]', '', 'g') AS folded, first_observed_at AS start,
         last_observed_at AS observed_at, identifier_id AS tie FROM organisation_identifier WHERE first_observed_at IS NOT NULL
  UNION ALL
  SELECT org_id, predicate, regexp_replace(regexp_replace(lower(trim(object_value)), '\s+', ' ', 'g'), '(\d)\s*(?:–|—|-|to)\s*(\d)', '\1-\2', 'g'),
         valid_from, observed_at, observation_id FROM observation WHERE valid_from IS NOT NULL AND normalisation_status <> 'rejected'),
one AS (SELECT org_id, attribute, start, folded FROM said
        QUALIFY row_number() OVER (PARTITION BY org_id, attribute, start ORDER BY observed_at DESC, tie DESC) = 1),
fresh AS (SELECT * FROM one QUALIFY lag(folded) OVER (PARTITION BY org_id, attribute ORDER BY start) IS DISTINCT FROM folded),
numbered AS (SELECT org_id, attribute, CAST(row_number() OVER (PARTITION BY org_id, attribute ORDER BY start) AS INTEGER) AS version_no,
             strftime(start AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS valid_from, count(*) OVER (PARTITION BY org_id, attribute) AS n FROM fresh)
SELECT org_id, attribute, version_no, valid_from FROM numbered WHERE n > 1"""

SQL = {
    "p5_found": f"SELECT * FROM ({_P5.format(up=_UP.format(col='parent_organisation_id'), kind='parent')}) "
                f"UNION ALL SELECT * FROM ({_P5.format(up=_UP.format(col='merged_into_id'), kind='merge')})",
    "p5_descendants": f"""WITH RECURSIVE {_UP.format(col='parent_organisation_id')},
bad AS (SELECT DISTINCT org_id FROM climb WHERE looped)
SELECT c.here AS ancestor, c.org_id AS descendant, CAST(c.depth AS INTEGER) AS distance FROM climb c
WHERE c.depth > 0 AND c.org_id NOT IN (SELECT org_id FROM bad)""",
    "p6_found": f"WITH {_P6_PARSE} SELECT run_id, line_no, reason FROM reasons WHERE reason IS NOT NULL",
    "p6_loaded": f"WITH {_P6_PARSE} SELECT run_id, line_no, name, email, phone FROM reasons WHERE reason IS NULL",
    "p6_unknown": """SELECT DISTINCT run_id, line_no FROM (SELECT DISTINCT run_id, line_no, raw_record FROM import_record) i
WHERE NOT EXISTS (SELECT 1 FROM bulk_import_run r WHERE r.run_id = i.run_id AND field_sep <> '' AND header_line IS NOT NULL)""",
    "p7_found": _P7,
}
