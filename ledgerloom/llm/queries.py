"""Queries of the problems on entities and text, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm.addresses import place_members, same_places
from ledgerloom.llm.entity_match import match
from ledgerloom.llm.groups import GOLDEN_FIELDS, PLACEHOLDERS, golden_records, groups, merge_sets, surviving_facts
from ledgerloom.llm.leakage import leaked_items
from ledgerloom.llm.mixing import mix_report, mixed_documents
from ledgerloom.llm.mojibake import repaired
from ledgerloom.session import table


def p1_matches(spark: SparkSession, d: str) -> DataFrame:
    """Pairs with the strongest rule they meet and its confidence."""
    return match(*(table(spark, d, t) for t in ("directory_listing", "organisation", "organisation_identifier", "org_location", "observation")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_matches(spark, d).select("org_id", "listing_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return groups(table(spark, d, "entity_match_candidate"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return surviving_facts(table(spark, d, "fact_assertion"), merge_sets(table(spark, d, "organisation")))


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    """One surviving organisation record per set of merged organisations."""
    organisations = table(spark, d, "organisation")
    return golden_records(organisations, merge_sets(organisations))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return same_places(table(spark, d, "org_location"))


def p4_places(spark: SparkSession, d: str) -> DataFrame:
    """Place of each location: one row per location and kind of place."""
    return place_members(table(spark, d, "org_location"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_passages(spark, d).select("doc_id", "item_id")


def p8_passages(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items with the share found and where the passage stands in the original text."""
    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p9_documents(spark: SparkSession, d: str) -> DataFrame:
    """The mix: every document used and how often."""
    return mixed_documents(table(spark, d, "documents"), table(spark, d, "mix_target"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix_report(p9_documents(spark, d), table(spark, d, "mix_target"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return repaired(table(spark, d, "documents")).where("garbled").select("doc_id").distinct()


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    """The affected documents with their text as far as it can be restored and the number of garbled spans."""
    return repaired(table(spark, d, "documents")).where("garbled").selectExpr("doc_id", "text", "size(spans) as n_spans")


QUERIES = {f.__name__: f for f in (p1_found, p1_matches, p2_found, p3_found, p3_records, p4_found, p4_places, p8_found, p8_passages, p9_documents, p9_shares, p10_found, p10_restored)}

_PLACEHOLDERS = ", ".join(f"'{x}'" for x in PLACEHOLDERS)

SQL: dict[str, str] = {
    "p2_found": r"""WITH RECURSIVE rows AS (
  SELECT least(organisation_a_id, organisation_b_id) AS a, greatest(organisation_a_id, organisation_b_id) AS b,
         regexp_replace(lower(trim(match_state)), '[\s_\-]+', '_', 'g') AS state, updated_at, candidate_id
  FROM entity_match_candidate WHERE trim(organisation_a_id) <> '' AND trim(organisation_b_id) <> '' AND organisation_a_id <> organisation_b_id),
last AS (SELECT a, b, state FROM rows QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY updated_at DESC NULLS LAST, candidate_id DESC) = 1),
links AS (SELECT a, b FROM last WHERE state IN ('exact', 'high_confidence_probable')),
arcs AS (SELECT a AS u, b AS v FROM links UNION SELECT b, a FROM links),
reach AS (SELECT u AS id, u AS seen FROM arcs UNION SELECT r.id, a.v FROM reach r JOIN arcs a ON r.seen = a.u)
SELECT id AS org_id, min(seen) AS group_id FROM reach GROUP BY id""",
    "p3_found": rf"""WITH RECURSIVE links AS (
  SELECT org_id, min(CASE WHEN trim(merged_into_id) <> '' THEN merged_into_id END) AS parent FROM organisation GROUP BY org_id),
known AS (SELECT l.org_id, p.org_id AS up FROM links l LEFT JOIN links p ON l.parent = p.org_id),
climb AS (SELECT org_id, org_id AS here, [org_id] AS seen, false AS looped FROM known
          UNION ALL SELECT c.org_id, k.up, list_append(c.seen, k.up), list_contains(c.seen, k.up)
          FROM climb c JOIN known k ON c.here = k.org_id WHERE k.up IS NOT NULL AND NOT c.looped),
tops AS (SELECT org_id, arg_max(here, len(seen)) AS root_org_id, bool_or(looped) AS looped FROM climb GROUP BY org_id),
members AS (SELECT org_id, root_org_id FROM tops WHERE NOT looped QUALIFY count(*) OVER (PARTITION BY root_org_id) > 1),
good AS (SELECT m.root_org_id, f.* FROM fact_assertion f JOIN members m USING (org_id)
         WHERE lower(trim(f.status)) IS DISTINCT FROM 'disproven' AND trim(f.value) <> ''
         AND regexp_replace(lower(trim(f.value)), '\s+', ' ', 'g') NOT IN ({_PLACEHOLDERS}) AND NOT regexp_full_match(f.value, '[0\W_]+'))
SELECT root_org_id, predicate, assertion_id FROM good QUALIFY row_number() OVER (PARTITION BY root_org_id, predicate
  ORDER BY authority_score DESC NULLS LAST, last_observed_at DESC NULLS LAST, assertion_id) = 1""",
}

_FIELDS = GOLDEN_FIELDS
_USABLE = (r"CASE WHEN length(regexp_replace(lower(trim({0})), '\s+', ' ', 'g')) > 0 AND regexp_replace(lower(trim({0})), '\s+', ' ', 'g') NOT IN (" + _PLACEHOLDERS +
           r") AND NOT regexp_full_match(regexp_replace(lower(trim({0})), '\s+', ' ', 'g'), '[0\W_]+') THEN {0} END AS {0}")
SQL["p3_records"] = SQL["p3_found"].split("good AS")[0] + f"""one AS (SELECT org_id, any_value(merged_into_id) AS x, {', '.join(f'any_value({f}) AS {f}' for f in (*_FIELDS, 'last_observed_at', 'entity_confidence'))} FROM organisation GROUP BY org_id),
u AS (SELECT root_org_id, org_id, {', '.join(_USABLE.format(f) for f in _FIELDS)}, coalesce(epoch_us(last_observed_at), -9e18) AS seen, coalesce(entity_confidence, -9e18) AS trust FROM one JOIN members USING (org_id)),
r AS (SELECT *, {' + '.join(f'({f} IS NOT NULL)::INT' for f in _FIELDS)} AS complete FROM u),
dom AS (SELECT a.org_id AS above, b.root_org_id, b.org_id FROM r a JOIN r b ON a.root_org_id = b.root_org_id AND a.complete >= b.complete AND a.seen >= b.seen AND a.trust >= b.trust
        AND (a.complete > b.complete OR a.seen > b.seen OR a.trust > b.trust)),
walk AS (SELECT root_org_id, org_id, 1 AS n FROM r UNION SELECT d.root_org_id, d.org_id, w.n + 1 FROM walk w JOIN dom d ON d.above = w.org_id),
placed AS (SELECT r.*, struct_pack(a := n, b := -complete, c := -seen, d := -trust, e := org_id) AS o, n FROM r JOIN (SELECT org_id, max(n) AS n FROM walk GROUP BY 1) USING (org_id))
SELECT root_org_id, arg_min(org_id, o) AS survivor_id, CAST(greatest(1, {', '.join(f'coalesce(min(n) FILTER ({f} IS NOT NULL), 1)' for f in _FIELDS)}) AS INTEGER) AS layers,
{', '.join(f'arg_min({f}, o) FILTER ({f} IS NOT NULL) AS {f}' for f in _FIELDS)} FROM placed GROUP BY root_org_id"""
