"""Queries on classifications, sizes, open questions, completion and group views, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import facts, research
from ledgerloom.operators.hierarchy import hierarchy
from ledgerloom.plans.data_problems import _UP
from ledgerloom.session import table

OPEN_STATES = ("possible_review", "unresolved")
EARLIER = "2024-07-01 00:00:00"


def _canonical(spark: SparkSession, d: str) -> DataFrame:
    return facts.canonical_map(table(spark, d, "organisation")).select("org_id", "root_id")


def source_assignments(spark: SparkSession, d: str) -> DataFrame:
    """What each source lets a claim be, and how sure."""
    src = table(spark, d, "source_definition")
    return src.select("source_id", research.assignment_of(F.col("source_category"), F.col("authority_tier")).alias("a")).select("source_id", "a.*")


def claimed_bands(spark: SparkSession, d: str) -> DataFrame:
    """Employee bands as claims within a vocabulary: the strongest assignment of each organisation and band, with its evidence."""
    src = F.broadcast(table(spark, d, "source_definition").select("source_id", "source_category", "authority_tier"))  # 64 rows, fixed
    claims = table(spark, d, "observation").where("predicate = 'employee_count_band' and normalisation_status <> 'rejected'").select(
        F.col("org_id").alias("entity_id"), F.lit("service_claim").alias("predicate"), F.trim("object_value").alias("value"), "observation_id", "source_id").distinct().join(src, "source_id")
    vocabulary = spark.createDataFrame([("service_claim", b, f"band {b}") for b in research.BANDS], "predicate string, category_id string, category_label string")
    return research.classified(claims, vocabulary).select("entity_id", "category_id", "assignment_type", "confidence", F.size("evidence_ids").alias("evidence"))


def _group_flags(spark: SparkSession, d: str, before: str | None = None) -> DataFrame:
    """Per merge group what is there, from all member records; ``before`` takes only observations received by then."""
    canonical = _canonical(spark, d)
    org = table(spark, d, "organisation").groupBy("org_id").agg(F.max(F.length(F.trim("legal_name")) > 0).alias("named"))
    ident = table(spark, d, "organisation_identifier").select("org_id", F.lit(True).alias("identifier")).distinct()
    loc = table(spark, d, "org_location").groupBy("org_id").agg(
        F.lit(True).alias("location"), F.max(F.col("country").isNotNull() & (F.col("region").isNotNull() | F.col("locality").isNotNull())).alias("specific"))
    said = table(spark, d, "observation").where("normalisation_status <> 'rejected'")
    said = said.where(F.col("received_at") < F.to_timestamp(F.lit(before + "+00:00"))) if before else said
    seen = said.groupBy("org_id").agg(
        F.max(F.col("predicate") == "website_domain").alias("domain"), F.max(F.col("predicate").isin("phone", "email")).alias("contact"), F.max(F.col("predicate") == "employee_count_band").alias("band"))
    fact = table(spark, d, "fact_assertion").groupBy("org_id").agg(F.max((F.col("predicate") == "description") & (F.length(F.trim("value")) > 0)).alias("described"))
    every = canonical
    for part in (org, ident, loc, seen, fact):
        every = every.join(part, "org_id", "left")
    names = ("named", "identifier", "location", "specific", "domain", "contact", "band", "described")
    return every.groupBy(F.col("root_id").alias("entity_id")).agg(*[F.max(F.coalesce(n, F.lit(False))).alias(n) for n in names])


def completion(spark: SparkSession, d: str) -> DataFrame:
    """How complete each merge group's profile is and what it lacks."""
    flags = _group_flags(spark, d).select("entity_id", (F.col("named") | F.col("identifier")).alias("stable_identity"), F.col("domain").alias("official_domain"), F.col("specific").alias("specific_location"),
                                          F.col("contact").alias("public_contact_route"), F.col("described").alias("business_description"), F.col("band").alias("evidenced_relevance"))
    return research.completion(flags).select("entity_id", "complete", "score", F.array_join("missing", ",").alias("missing"), "signature")


def _needed(spark: SparkSession, d: str, before: str | None = None) -> DataFrame:
    flags = _group_flags(spark, d, before).withColumn("capability", F.col("band"))
    rows = table(spark, d, "fact_assertion").select("assertion_id", "org_id", "predicate", "status").distinct().join(_canonical(spark, d), "org_id")
    return research.needed_questions(flags, rows.select(F.col("root_id").alias("entity_id"), "predicate", "status"),
                                     spark.createDataFrame([], "entity_id string, capability_id string, status string"))


def gap_questions(spark: SparkSession, d: str) -> DataFrame:
    return _needed(spark, d)


def gap_changes(spark: SparkSession, d: str) -> DataFrame:
    """Questions asked by what was received before a date, against those needed now: asked, resolved, kept."""
    was = _needed(spark, d, EARLIER).withColumn("generated_by", F.lit("system"))
    return research.question_changes(was, _needed(spark, d))


def question_queue(spark: SparkSession, d: str) -> DataFrame:
    """The most urgent open questions, oldest entities first: a top-k report."""
    since = table(spark, d, "organisation").join(_canonical(spark, d), "org_id").groupBy(F.col("root_id").alias("entity_id")).agg(F.min("first_observed_at").alias("created_at"))
    asked = _needed(spark, d).join(since, "entity_id").withColumn("status", F.lit("open"))
    return research.question_queue(asked, 200).select("entity_id", "question_type", "priority")


def size_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Size concepts of each merge group: employee fact, locations as units, subsidiaries by parent, domains and phones as what is shown."""
    canonical = _canonical(spark, d)
    band = table(spark, d, "fact_assertion").where("predicate = 'employee_count_band' and status not in ('disproven', 'unknown') and value is not null").join(canonical, "org_id").groupBy("root_id").agg(
        F.max_by(F.struct(F.trim("value").alias("v"), "final_confidence"), F.struct("final_confidence", "assertion_id")).alias("b"))
    units = table(spark, d, "org_location").join(canonical, "org_id").groupBy("root_id").agg(F.countDistinct("location_id").alias("units"))
    below = table(spark, d, "organisation").where("trim(parent_organisation_id) <> ''").select("org_id", "parent_organisation_id").distinct().join(
        canonical.withColumnRenamed("org_id", "parent_organisation_id"), "parent_organisation_id").groupBy("root_id").agg(F.countDistinct("org_id").alias("subsidiaries"))
    shown = table(spark, d, "fact_assertion").where("predicate in ('website_domain', 'phone', 'email')").join(canonical, "org_id").groupBy("root_id").agg(
        F.countDistinct(F.when(F.col("status") == "confirmed", F.col("predicate"))).alias("shown"), F.countDistinct(F.when(F.col("status") == "possible", F.col("predicate"))).alias("claimed"))
    every = canonical.select("root_id").distinct()
    for part in (band, units, below, shown):
        every = every.join(part, "root_id", "left")
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return research.sizes(every.select(F.col("root_id").alias("entity_id"), F.col("b.v").alias("band"), F.col("b.final_confidence").alias("band_confidence"), *[none(c) for c in ("units", "subsidiaries", "shown", "claimed")]))


def group_children(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers, locations and facts of merged records under the canonical one, with the record they came from."""
    canonical = _canonical(spark, d)
    parts = [table(spark, d, t).select("org_id", F.lit(t).alias("kind"), F.col(k).alias("child_id")).distinct() for t, k in (
        ("organisation_identifier", "identifier_id"), ("org_location", "location_id"), ("fact_assertion", "assertion_id"))]
    rows = research.attributed(parts[0].unionByName(parts[1]).unionByName(parts[2]), canonical)
    return rows.groupBy("root_id", "origin_id", "kind").agg(F.count("*").alias("children"))


def open_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Open match candidates of each merge group."""
    state = F.regexp_replace(F.lower(F.trim("match_state")), r"[\s\-]+", "_")
    rows = table(spark, d, "entity_match_candidate").select("candidate_id", F.col("organisation_a_id").alias("a"), F.col("organisation_b_id").alias("b"), state.alias("state"))
    return research.duplicate_warnings(rows.where("b is not null"), _canonical(spark, d), OPEN_STATES)


def ancestors(spark: SparkSession, d: str) -> DataFrame:
    """Number and list of the organisations above each one over the parent links; those on or below a loop have none defined."""
    found = hierarchy(table(spark, d, "organisation").select("org_id", "parent_organisation_id"), "org_id", "parent_organisation_id").where("depth > 0")
    return found.select(F.col("id").alias("org_id"), F.array_join(F.slice("path", 1, F.size("path") - 1), ">").alias("above"), "depth")


def predicate_sets(spark: SparkSession, d: str) -> DataFrame:
    """The distinct predicates on record for each merge group."""
    return table(spark, d, "observation").where("normalisation_status <> 'rejected'").select("org_id", "predicate").distinct().join(_canonical(spark, d), "org_id").groupBy("root_id").agg(
        F.array_join(F.array_sort(F.collect_set("predicate")), ",").alias("predicates"))


def identifier_upserts(spark: SparkSession, d: str) -> DataFrame:
    """One row per organisation, scheme and normalised identifier: first and last sighting, current if any says so."""
    rows = table(spark, d, "organisation_identifier").dropDuplicates(["identifier_id"]).withColumn("value_key", text.identifier_key(F.col("value")))
    out = research.upserted(rows, ["org_id", "scheme", "value_key"], ["is_current"], "first_observed_at", "last_observed_at")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("org_id", "scheme", "value_key", "is_current", stamp("first_observed_at"), stamp("last_observed_at"), "sightings")


def facts_up_to_date(spark: SparkSession, d: str) -> DataFrame:
    """Whether what was received before a date is still all the evidence of each organisation."""
    rows = table(spark, d, "observation").where("normalisation_status <> 'rejected'").select(F.col("org_id").alias("entity_id"), "predicate", "observation_id", "received_at")
    return research.facts_current(rows.where(F.col("received_at") < F.to_timestamp(F.lit(EARLIER + "+00:00"))), rows)


def research_plan(spark: SparkSession, d: str) -> DataFrame:
    """Search queries of each organisation by what its profile lacks."""
    org = table(spark, d, "organisation").groupBy("org_id").agg(F.min(F.coalesce("legal_name", "canonical_name")).alias("name"))
    ids = table(spark, d, "organisation_identifier").groupBy("org_id").agg(F.array_sort(F.collect_set(text.identifier_key(F.col("value")))).alias("identifiers"))
    loc = table(spark, d, "org_location").where("locality is not null").groupBy("org_id").agg(F.min(F.struct("location_id", "locality", "region")).alias("l"))
    seen = table(spark, d, "observation").where("normalisation_status <> 'rejected'").groupBy("org_id").agg(F.max(F.col("predicate").isin("phone", "email")).alias("contact"))
    rows = org.join(ids, "org_id", "left").join(loc, "org_id", "left").join(seen, "org_id", "left").select(
        F.col("org_id").alias("entity_id"), "name", "identifiers", F.col("l.locality").alias("locality"), F.col("l.region").alias("region"),
        F.when(F.coalesce("contact", F.lit(False)), F.array().cast("array<string>")).otherwise(F.array(F.lit("public_contact_route"))).alias("missing"))
    return research.research_queries(rows).select("entity_id", F.array_join("queries", " | ").alias("queries"))


QUERIES = {f.__name__: f for f in (source_assignments, claimed_bands, completion, gap_questions, gap_changes, question_queue, size_estimates, group_children, open_duplicates, ancestors, predicate_sets,
                                   identifier_upserts, facts_up_to_date, research_plan)}

_CANON = f"""{_UP.format(col='merged_into_id')},
ends AS (SELECT org_id, arg_max(here, depth) AS here, bool_or(looped) AS looped, arg_max(seen, depth) AS seen FROM climb GROUP BY org_id),
canon AS (SELECT org_id, CASE WHEN looped THEN list_min(list_slice(seen, list_position(seen, here), len(seen))) ELSE here END AS root_id FROM ends)"""
_KIND = """CASE source_category WHEN 'government_registry' THEN 'registered' WHEN 'regulator' THEN 'registered' WHEN 'company_website' THEN 'self_described' ELSE 'observed' END"""
_BASE = """CASE source_category WHEN 'government_registry' THEN 0.9 WHEN 'regulator' THEN 0.9 WHEN 'bulk_dataset' THEN 0.6 WHEN 'company_website' THEN 0.7 WHEN 'industry_association' THEN 0.6
WHEN 'directory' THEN 0.4 ELSE 0.5 END"""
_SURE = f"round(CAST({_BASE} AS DOUBLE) * greatest(0.45, 1.0 - 0.08 * (least(greatest(authority_tier, 1), 7) - 1)), 3)"


def _flags(name: str, before: str | None = None) -> str:
    when = f" AND received_at < TIMESTAMPTZ '{before}+00:00'" if before else ""
    return f"""{name} AS (SELECT root_id AS entity_id, coalesce(bool_or(named), false) AS named, coalesce(bool_or(identifier), false) AS identifier, coalesce(bool_or(location), false) AS location, coalesce(bool_or(specific), false) AS specific,
  coalesce(bool_or(domain), false) AS domain, coalesce(bool_or(contact), false) AS contact, coalesce(bool_or(band), false) AS band, coalesce(bool_or(described), false) AS described FROM canon
  LEFT JOIN (SELECT org_id, bool_or(trim(legal_name) <> '') AS named FROM organisation GROUP BY 1) o USING (org_id)
  LEFT JOIN (SELECT DISTINCT org_id, true AS identifier FROM organisation_identifier) i USING (org_id)
  LEFT JOIN (SELECT org_id, true AS location, bool_or(country IS NOT NULL AND (region IS NOT NULL OR locality IS NOT NULL)) AS specific FROM org_location GROUP BY 1) l USING (org_id)
  LEFT JOIN (SELECT org_id, bool_or(predicate = 'website_domain') AS domain, bool_or(predicate IN ('phone', 'email')) AS contact, bool_or(predicate = 'employee_count_band') AS band
             FROM observation WHERE normalisation_status <> 'rejected'{when} GROUP BY 1) s USING (org_id)
  LEFT JOIN (SELECT org_id, bool_or(predicate = 'description' AND coalesce(trim(value), '') <> '') AS described FROM fact_assertion GROUP BY 1) f USING (org_id) GROUP BY root_id)"""


def _asks(name: str, flags: str) -> str:
    kinds = (("identifier", "missing_identifier", 0.8), ("domain", "missing_domain", 0.7), ("location", "missing_location", 0.6), ("contact", "missing_contact", 0.5), ("band", "no_capability_evidence", 0.6))
    lacks = " UNION ALL ".join(f"SELECT entity_id, '{q}' AS question_type, CAST({p} AS DOUBLE) AS priority FROM {flags} WHERE NOT {c}" for c, q, p in kinds)
    return f"""{name} AS ({lacks} UNION ALL SELECT DISTINCT root_id, CASE status WHEN 'conflicted' THEN 'conflicted_fact:' ELSE 'stale_fact:' END || predicate,
  CAST(CASE status WHEN 'conflicted' THEN 0.8 ELSE 0.55 END AS DOUBLE) FROM fact_assertion JOIN canon USING (org_id) WHERE status IN ('conflicted', 'stale'))"""


_NEEDS = (("stable_identity", "(named OR identifier)"), ("official_domain", "domain"), ("specific_location", "specific"), ("public_contact_route", "contact"), ("business_description", "described"), ("evidenced_relevance", "band"))
_HAVE = "[" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _NEEDS) + "]"
_LACK = "[" + ", ".join(f"CASE WHEN NOT {c} THEN '{n}' END" for n, c in _NEEDS) + "]"
_JSON = "'[' || array_to_string(list_transform({0}, lambda x: '\"' || x || '\"'), ',') || ']'"
SQL = {
    "source_assignments": f"SELECT source_id, {_KIND} AS assignment_type, {_SURE} AS confidence FROM source_definition",
    "claimed_bands": f"""WITH c AS (SELECT DISTINCT org_id, trim(object_value) AS category_id, observation_id, {_KIND} AS kind, {_SURE} AS sure FROM observation JOIN source_definition USING (source_id)
  WHERE predicate = 'employee_count_band' AND normalisation_status <> 'rejected' AND trim(object_value) IN ('1-4', '5-19', '20-49', '50-199', '200+'))
SELECT org_id AS entity_id, category_id, CASE max(CASE kind WHEN 'registered' THEN 1 WHEN 'self_described' THEN 2 ELSE 3 END) WHEN 1 THEN 'registered' WHEN 2 THEN 'self_described' ELSE 'observed' END AS assignment_type,
max(sure) AS confidence, CAST(count(DISTINCT observation_id) AS INTEGER) AS evidence FROM c GROUP BY 1, 2""",
    "completion": f"""WITH RECURSIVE {_CANON}, {_flags('fl')}, p AS (SELECT entity_id, list_filter({_HAVE}, lambda x: x IS NOT NULL) AS h, list_filter({_LACK}, lambda x: x IS NOT NULL) AS m FROM fl)
SELECT entity_id, len(m) = 0 AS complete, round(len(h) / 6, 3) AS score, array_to_string(m, ',') AS missing,
substr(sha256('{{"entity_id":"' || entity_id || '","missing":' || {_JSON.format('m')} || ',"present":' || {_JSON.format('h')} || '}}'), 1, 20) AS signature FROM p""",
    "gap_questions": f"WITH RECURSIVE {_CANON}, {_flags('fl')}, {_asks('q', 'fl')} SELECT entity_id, question_type, priority FROM q",
    "gap_changes": f"""WITH RECURSIVE {_CANON}, {_flags('fl')}, {_flags('fe', EARLIER)}, {_asks('q', 'fl')}, {_asks('e', 'fe')}
SELECT entity_id, question_type, CASE WHEN e.priority IS NULL THEN 'asked' WHEN q.priority IS NULL THEN 'resolved' ELSE 'kept' END AS change FROM e FULL JOIN q USING (entity_id, question_type)""",
    "question_queue": f"""WITH RECURSIVE {_CANON}, {_flags('fl')}, {_asks('q', 'fl')}, since AS (SELECT root_id AS entity_id, min(first_observed_at) AS created_at FROM organisation JOIN canon USING (org_id) GROUP BY 1)
SELECT entity_id, question_type, priority FROM q JOIN since USING (entity_id) ORDER BY priority DESC, created_at, entity_id, question_type LIMIT 200""",
    "size_estimates": f"""WITH RECURSIVE {_CANON},
b AS (SELECT root_id, arg_max(struct_pack(v := trim(value), c := final_confidence), struct_pack(a := final_confidence, b := assertion_id)) AS b FROM fact_assertion JOIN canon USING (org_id)
  WHERE predicate = 'employee_count_band' AND status NOT IN ('disproven', 'unknown') AND value IS NOT NULL GROUP BY 1),
u AS (SELECT root_id, count(DISTINCT location_id) AS units FROM org_location JOIN canon USING (org_id) GROUP BY 1),
s AS (SELECT c.root_id, count(DISTINCT o.org_id) AS subs FROM organisation o JOIN canon c ON o.parent_organisation_id = c.org_id GROUP BY 1),
k AS (SELECT root_id, count(DISTINCT predicate) FILTER (status = 'confirmed') AS shown, count(DISTINCT predicate) FILTER (status = 'possible') AS claimed FROM fact_assertion JOIN canon USING (org_id)
  WHERE predicate IN ('website_domain', 'phone', 'email') GROUP BY 1),
e AS (SELECT DISTINCT root_id AS entity_id, b.v AS band, b.c AS conf, coalesce(units, 0) AS units, coalesce(subs, 0) AS subs, coalesce(shown, 0) AS shown, coalesce(claimed, 0) AS claimed
  FROM canon LEFT JOIN b USING (root_id) LEFT JOIN u USING (root_id) LEFT JOIN s USING (root_id) LEFT JOIN k USING (root_id)),
t AS (SELECT *, CASE WHEN shown + claimed + units = 0 AND band IS NULL THEN 'unresolved' WHEN shown >= 3 AND units >= 2 AND band IN ('50-199', '200+') THEN 'A'
  WHEN shown >= 2 AND (units >= 1 OR coalesce(band IN ('20-49', '50-199'), false)) THEN 'B' WHEN shown >= 1 THEN 'C' ELSE 'D' END AS tier FROM e)
SELECT entity_id, 'legal_entity_size' AS concept, CASE WHEN band IN ('1-4', '5-19', '20-49', '50-199', '200+') THEN band ELSE 'unresolved' END AS band,
  CASE WHEN band IN ('1-4', '5-19', '20-49', '50-199', '200+') THEN round(conf, 3) ELSE 0.0 END AS confidence FROM t
UNION ALL SELECT entity_id, 'operating_group_size', CASE WHEN units + subs >= 2 THEN 'multi-site' WHEN units + subs = 1 THEN 'single-site' ELSE 'unresolved' END, CASE WHEN units + subs >= 1 THEN 0.6 ELSE 0.0 END FROM t
UNION ALL SELECT entity_id, 'capability_tier', tier, CASE tier WHEN 'A' THEN 0.7 WHEN 'B' THEN 0.6 WHEN 'C' THEN 0.55 WHEN 'D' THEN 0.4 ELSE 0.0 END FROM t""",
    "group_children": f"""WITH RECURSIVE {_CANON}, c AS (SELECT DISTINCT org_id, 'organisation_identifier' AS kind, identifier_id AS child FROM organisation_identifier UNION ALL
  SELECT DISTINCT org_id, 'org_location', location_id FROM org_location UNION ALL SELECT DISTINCT org_id, 'fact_assertion', assertion_id FROM fact_assertion)
SELECT root_id, org_id AS origin_id, kind, count(*) AS children FROM c JOIN canon USING (org_id) GROUP BY 1, 2, 3""",
    "open_duplicates": rf"""WITH RECURSIVE {_CANON}, c AS (SELECT DISTINCT candidate_id, organisation_a_id AS a, organisation_b_id AS b FROM entity_match_candidate
  WHERE regexp_replace(lower(trim(match_state)), '[\s\-]+', '_', 'g') IN ('possible_review', 'unresolved') AND organisation_b_id IS NOT NULL),
s AS (SELECT candidate_id, a AS org_id, b AS other_id FROM c UNION SELECT candidate_id, b, a FROM c) SELECT DISTINCT root_id, candidate_id, other_id FROM s JOIN canon USING (org_id)""",
    "ancestors": f"""WITH RECURSIVE {_UP.format(col='parent_organisation_id')}, ends AS (SELECT org_id, bool_or(looped) AS looped, max(depth) AS depth, arg_max(seen, depth) AS seen FROM climb GROUP BY 1)
SELECT org_id, array_to_string(list_reverse(seen[2:]), '>') AS above, CAST(depth AS INTEGER) AS depth FROM ends WHERE NOT looped AND depth > 0""",
    "predicate_sets": f"""WITH RECURSIVE {_CANON} SELECT root_id, string_agg(DISTINCT predicate, ',' ORDER BY predicate) AS predicates FROM observation JOIN canon USING (org_id) WHERE normalisation_status <> 'rejected' GROUP BY 1""",
    "identifier_upserts": r"""WITH i AS (SELECT DISTINCT * FROM organisation_identifier)
SELECT org_id, scheme, upper(regexp_replace(value, '[\s\-./]', '', 'g')) AS value_key, bool_or(coalesce(is_current, false)) AS is_current, strftime(min(first_observed_at) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS first_observed_at,
strftime(max(last_observed_at) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS last_observed_at, count(*) AS sightings FROM i GROUP BY 1, 2, 3""",
    "facts_up_to_date": f"""WITH o AS (SELECT DISTINCT org_id, predicate, observation_id, received_at < TIMESTAMPTZ '{EARLIER}+00:00' AS early FROM observation WHERE normalisation_status <> 'rejected')
SELECT org_id AS entity_id, bool_and(early) AS current FROM o GROUP BY 1""",
    "research_plan": r"""WITH o AS (SELECT org_id, '"' || min(coalesce(legal_name, canonical_name)) || '"' AS q FROM organisation GROUP BY 1),
i AS (SELECT org_id, list_sort(list(DISTINCT upper(regexp_replace(value, '[\s\-./]', '', 'g')))) AS ids FROM organisation_identifier GROUP BY 1),
l AS (SELECT org_id, arg_min(struct_pack(l := locality, r := region), struct_pack(a := location_id, b := locality, c := region)) AS pl FROM org_location WHERE locality IS NOT NULL GROUP BY 1),
s AS (SELECT org_id, bool_or(predicate IN ('phone', 'email')) AS contact FROM observation WHERE normalisation_status <> 'rejected' GROUP BY 1)
SELECT org_id AS entity_id, array_to_string(list_filter([q || ' official website'] || list_transform(coalesce(ids, []), lambda x: q || ' "' || x || '"') || [CASE WHEN pl IS NOT NULL THEN concat_ws(' ', q, pl.l, pl.r) END,
CASE WHEN NOT coalesce(contact, false) THEN q || ' contact address phone email' END], lambda x: x IS NOT NULL), ' | ') AS queries FROM o LEFT JOIN i USING (org_id) LEFT JOIN l USING (org_id) LEFT JOIN s USING (org_id)""",
}
