"""Queries on organisations, observations and facts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import confidence as conf
from ledgerloom.functions import geography as geo
from ledgerloom.functions import text
from ledgerloom.operators import facts, graph, matching, targeting
from ledgerloom.operators.bad_rows import parse_records
from ledgerloom.plans.data_problems import _P6_PARSE, _UP
from ledgerloom.session import table

AS_OF = "2025-07-01 00:00:00"
STATE_CODES = {"New South Wales": "NSW", "Victoria": "VIC", "Queensland": "QLD", "South Australia": "SA", "Western Australia": "WA",
               "Tasmania": "TAS", "Northern Territory": "NT", "Wellington": "WGN"}


def as_of():
    return F.to_timestamp(F.lit(AS_OF + "+00:00"))


def org_name_keys(spark: SparkSession, d: str) -> DataFrame:
    key = text.name_key(F.col("canonical_name"))
    return table(spark, d, "organisation").select("org_id", "canonical_name").distinct().select(
        "org_id", key.alias("name_key"), F.array_join(F.array_sort(text.blocking_tokens(key)), " ").alias("blocking"))


def contact_keys(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("object_value")
    key = F.when(F.col("predicate") == "phone", text.phone_tail(v)).when(F.col("predicate") == "email", text.email_business_domain(v)).otherwise(text.bare_host(v))
    return table(spark, d, "observation").where("predicate in ('phone', 'email', 'website_domain') and normalisation_status <> 'rejected'").select(
        "org_id", "predicate", key.alias("key")).where("key is not null").distinct()


def identifier_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "organisation_identifier").groupBy("org_id", "scheme", text.identifier_key(F.col("value")).alias("value_key")).agg(
        F.bool_or("is_current").alias("is_current"), F.countDistinct("identifier_id").alias("sightings"))


def candidate_hosts(spark: SparkSession, d: str) -> DataFrame:
    """Host names an organisation may use that some observation gives as its website."""
    names = table(spark, d, "organisation").select("org_id", F.explode(text.candidate_hosts(F.col("canonical_name"), 8, ("example", "com.au"))).alias("host")).distinct()
    seen = table(spark, d, "observation").where("predicate = 'website_domain'").select("org_id", text.bare_host(F.col("object_value")).alias("host")).distinct()
    return names.join(seen, ["org_id", "host"]).select("org_id", "host")


def observation_scores(spark: SparkSession, d: str) -> DataFrame:
    src = table(spark, d, "source_definition").select("source_id", "authority_tier", "source_category")
    return table(spark, d, "observation").select("observation_id", "predicate", "source_id", "observed_at").distinct().join(
        F.broadcast(src), "source_id").select(  # the source table is fixed at 64 rows
        "observation_id", conf.authority(F.col("authority_tier"), F.col("source_category"), F.col("predicate")).alias("authority"),
        conf.freshness(F.col("predicate"), F.col("observed_at"), as_of()).alias("freshness"))


def _origins(spark: SparkSession, d: str) -> DataFrame:
    """Sources of one category that are of tier 6 or beyond stand for copies of each other, at 0.9; of better tiers at 0.4, which is too little."""
    src = table(spark, d, "source_definition").groupBy("source_category", "authority_tier").agg(F.array_sort(F.collect_set("source_id")).alias("ids"))
    pairs = src.select(F.element_at("ids", 1).alias("source_id"), F.explode("ids").alias("related_source_id"), F.lit("same_publisher").alias("relationship_type"),
                       F.when(F.col("authority_tier") >= 6, 0.9).otherwise(0.4).alias("confidence"), F.lit(None).cast("timestamp").alias("valid_to"))
    return facts.independent_origins(pairs, as_of())


def reconcile_facts(spark: SparkSession, d: str) -> DataFrame:
    canonical = facts.canonical_map(table(spark, d, "organisation"))
    out = facts.reconcile(table(spark, d, "observation"), table(spark, d, "source_definition"), canonical, as_of(), _origins(spark, d))
    return out.withColumn("last_observed_at", F.date_format("last_observed_at", "yyyy-MM-dd HH:mm:ss"))


def canonical_map(spark: SparkSession, d: str) -> DataFrame:
    return facts.canonical_map(table(spark, d, "organisation"))


def merge_groups(spark: SparkSession, d: str) -> DataFrame:
    return canonical_map(spark, d).where("not looped").groupBy("root_id").agg(F.count("*").alias("members"), F.min("org_id").alias("least_id")).where("members > 1")


def blocking_keys(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of two or more organisations and how many members they have."""
    feats = matching.features(*(table(spark, d, t) for t in ("organisation", "organisation_identifier", "org_location", "observation")))
    return matching.blocks(feats).groupBy("key", "weak").agg(F.count("*").alias("members")).where("members > 1")


def duplicate_candidates(spark: SparkSession, d: str) -> DataFrame:
    return matching.duplicate_candidates(*(table(spark, d, t) for t in ("organisation", "organisation_identifier", "org_location", "observation"))).select(
        "a", "b", "match_state", "score", "conflict_count", F.size("signals").alias("n_signals"))


def review_queue(spark: SparkSession, d: str) -> DataFrame:
    """The first 200 unresolved candidates: score and conflicts descending, oldest first."""
    state = F.regexp_replace(F.lower(F.trim("match_state")), r"[\s\-]+", "_")
    rows = table(spark, d, "entity_match_candidate").distinct().where(state.isin("possible_review", "unresolved"))
    return rows.orderBy(F.desc_nulls_last("score"), F.desc("conflict_count"), "created_at", "candidate_id").limit(200).select("candidate_id", "score", "conflict_count")


def organisation_counts(spark: SparkSession, d: str) -> DataFrame:
    merged = F.length(F.trim("merged_into_id")) > 0
    return table(spark, d, "organisation").groupBy("org_id").agg(F.max(merged).alias("m")).agg(
        F.count("*").alias("total"), F.count_if("m").alias("merged"), F.count_if(~F.coalesce("m", F.lit(False))).alias("live"))


def source_document_counts(spark: SparkSession, d: str) -> DataFrame:
    key = F.lower(F.trim("source"))
    return table(spark, d, "documents").groupBy(key.alias("source")).agg(
        F.count("*").alias("documents"), F.sum("n_chars").alias("chars"), F.countDistinct(F.sha2("text", 256)).alias("distinct_texts"))


def coverage_matrix(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "source_definition").select(
        F.col("source_id"), F.col("source_id").alias("coverage_key"), F.array("source_category").alias("category"), F.array_compact(F.array("language")).alias("language"))
    return targeting.coverage_matrix(rows, "category", "language")


def source_targeting(spark: SparkSession, d: str) -> DataFrame:
    """Sources that cover registries and directories in English, unknown language kept."""
    src = table(spark, d, "source_definition")
    coverages = src.select("source_id", F.col("source_id").alias("coverage_key"), F.when(F.col("lifecycle_status") == "disabled", "disabled").otherwise("active").alias("lifecycle_status"),
                           F.col("created_at").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"))
    aims = src.select(F.col("source_id").alias("coverage_key"), F.explode(F.array(
        F.struct(F.lit("category").alias("dimension"), F.col("source_category").alias("target_key")),
        F.struct(F.lit("language").alias("dimension"), F.col("language").alias("target_key")))).alias("t")).select(
        "coverage_key", "t.*", F.lit("include").alias("polarity")).where("target_key is not null")
    wanted = {"category": ["government_registry", "directory"], "language": ["en"]}
    return targeting.source_matches(targeting.coverage_matches(coverages, aims, wanted, as_of())).select("source_id", "matched")


def evidence_rollup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "observation").where("document_id is not null").groupBy("document_id").agg(
        F.array_join(F.array_sort(F.collect_set("predicate")), ",").alias("predicates"), F.countDistinct("observation_id").alias("observations"),
        F.max("extraction_confidence").alias("max_confidence"), F.countDistinct("org_id").alias("organisations"))


def profile_completeness(spark: SparkSession, d: str) -> DataFrame:
    org = table(spark, d, "organisation").groupBy("org_id").agg(F.max(F.col("legal_name").isNotNull()).alias("legal"), F.max(F.col("country_of_registration").isNotNull()).alias("country"))
    ids = table(spark, d, "organisation_identifier").select("org_id").distinct().withColumn("ident", F.lit(True))
    loc = table(spark, d, "org_location").select("org_id").distinct().withColumn("place", F.lit(True))
    said = table(spark, d, "observation").where("normalisation_status <> 'rejected'").groupBy("org_id").agg(
        F.max(F.col("predicate") == "phone").alias("phone"), F.max(F.col("predicate") == "website_domain").alias("web"))
    n = sum(F.coalesce(F.col(c), F.lit(False)).cast("int") for c in ("legal", "country", "ident", "place", "phone", "web"))
    return org.join(ids, "org_id", "left").join(loc, "org_id", "left").join(said, "org_id", "left").select("org_id", F.round(n / 6, 3).alias("completeness"))


def latest_observations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "observation").groupBy("org_id", "predicate").agg(
        F.max_by("object_value", F.struct("observed_at", "observation_id")).alias("value"), F.countDistinct("observation_id").alias("observations"))


def contact_points(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "observation").where("predicate in ('phone', 'email') and normalisation_status <> 'rejected'")
    return rows.groupBy("org_id", "predicate", text.value_key(F.col("object_value")).alias("contact")).agg(
        F.max("extraction_confidence").alias("confidence"), F.countDistinct("observation_id").alias("evidence"),
        F.bool_or(F.coalesce(text.is_role_email(F.col("object_value")), F.lit(False)) & (F.col("predicate") == "email")).alias("role_based"))


def dangling_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Observations whose document, source or organisation does not exist."""
    obs = table(spark, d, "observation").select("observation_id", "document_id", "source_id", "org_id").distinct()
    docs, src, org = (table(spark, d, t).select(c).distinct() for t, c in (("documents", "doc_id"), ("source_definition", "source_id"), ("organisation", "org_id")))
    miss = lambda df, kind: df.select("observation_id", F.lit(kind).alias("missing"))
    return miss(obs.where("document_id is not null").join(docs, F.col("document_id") == F.col("doc_id"), "left_anti"), "document").unionByName(
        miss(obs.join(src, "source_id", "left_anti"), "source")).unionByName(miss(obs.join(org, "org_id", "left_anti"), "organisation"))


def stale_entities(spark: SparkSession, d: str) -> DataFrame:
    """Organisations with evidence newer than their newest fact, or with evidence and no fact."""
    seen = table(spark, d, "observation").groupBy("org_id").agg(F.max("observed_at").alias("seen"))
    known = table(spark, d, "fact_assertion").groupBy("org_id").agg(F.max("last_observed_at").alias("known"))
    return seen.join(known, "org_id", "left").where("known is null or seen > known").select("org_id", F.col("known").isNull().alias("unknown"))


def entity_search(spark: SparkSession, d: str) -> DataFrame:
    """Live organisations whose name holds 'scaff', or an identifier of which holds '4821'."""
    org = table(spark, d, "organisation").where("merged_into_id is null or trim(merged_into_id) = ''")
    by_id = table(spark, d, "organisation_identifier").where(text.identifier_key(F.col("value")).contains("4821")).select("org_id").distinct().withColumn("hit", F.lit(True))
    found = org.join(by_id, "org_id", "left").where(F.col("hit") | F.col("canonical_name").ilike("%scaff%") | F.col("legal_name").ilike("%scaff%"))
    return found.select("org_id", "canonical_name").distinct()


def research_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Missing kinds of evidence per organisation, and facts that are in conflict or stale."""
    kinds = ("phone", "email", "website_domain", "location", "employee_count_band")
    org = table(spark, d, "organisation").select("org_id").distinct().withColumn("kind", F.explode(F.array(*[F.lit(k) for k in kinds])))
    have = table(spark, d, "observation").where("normalisation_status <> 'rejected'").select("org_id", F.col("predicate").alias("kind")).distinct()
    missing = org.join(have, ["org_id", "kind"], "left_anti").select("org_id", F.concat(F.lit("missing:"), "kind").alias("gap"))
    bad = table(spark, d, "fact_assertion").where("status in ('conflicted', 'stale')").select("org_id", F.concat_ws(":", F.concat("status", F.lit("_fact")), "predicate").alias("gap")).distinct()
    return missing.unionByName(bad)


def _links(spark: SparkSession, d: str) -> DataFrame:
    org = table(spark, d, "organisation").groupBy("org_id").agg(F.min(F.struct("parent_organisation_id", "merged_into_id", "entity_confidence")).alias("o")).select("org_id", "o.*")
    c = F.round(F.coalesce("entity_confidence", F.lit(0.5)), 3)
    rows = org.select("org_id", F.explode(F.array(
        F.struct(F.col("parent_organisation_id").alias("object"), F.lit("child_of").alias("relation")),
        F.struct(F.col("merged_into_id").alias("object"), F.lit("merged_into").alias("relation")))).alias("e"), c.alias("confidence"))
    return graph.edges(rows.select(F.col("org_id").alias("subject"), "e.object", "e.relation", "confidence").where("trim(object) <> ''"))


def _near(links: DataFrame) -> DataFrame:
    starts = links.select(F.col("src").alias("id")).distinct()
    return graph.neighbourhood(starts, links, depth=2, least=0.05)


def _paths(links: DataFrame, near: DataFrame) -> DataFrame:
    pairs = near.where("hops = 2").select(F.col("start").alias("source"), F.col("id").alias("target"))
    return graph.shortest_paths(pairs, links, depth=2).select("source", "target", F.array_join("path", ">").alias("path"), "confidence")


def graph_neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    """Within two hops over parent and merge links, from every linked organisation."""
    return _near(_links(spark, d))


def graph_paths(spark: SparkSession, d: str) -> DataFrame:
    """Shortest paths from every linked organisation to what is two hops away."""
    return _paths(_links(spark, d), graph_neighbourhood(spark, d))


def _met(spark: SparkSession, d: str) -> DataFrame:
    obs = table(spark, d, "observation").where("document_id is not null")
    meetings = obs.groupBy(F.col("org_id").alias("member"), F.col("document_id").cast("string").alias("event")).agg(F.max("extraction_confidence").alias("confidence"))
    starts = obs.where("org_id is not null").select(F.col("org_id").alias("id")).distinct()
    none = spark.createDataFrame([], "src string, dst string, relation string, confidence double")
    return graph.neighbourhood(starts, none, depth=1, meetings=meetings)


def shared_documents(spark: SparkSession, d: str) -> DataFrame:
    """Organisations met through a common document by every organisation with an observation from a document."""
    return _met(spark, d)


def location_scope(spark: SparkSession, d: str) -> DataFrame:
    """Place code of each location and how it stands to Australia's east and to ANZ."""
    pairs = [x for k, v in STATE_CODES.items() for x in (F.lit(k), F.lit(v))]
    state = F.coalesce(F.element_at(F.create_map(*pairs), F.col("region")), F.col("region"))
    country = F.when(F.col("country").isin("AU", "Australia"), "AU").when(F.col("country").isin("NZ", "New Zealand"), "NZ")
    code = F.when(country.isNotNull(), F.concat_ws("-", country, state))
    rows = table(spark, d, "org_location").select("location_id", code.alias("code")).distinct()
    item = F.array_compact(F.array("code"))
    east = F.array(F.lit("AU-NSW"), F.lit("AU-QLD"), F.lit("AU-VIC"))
    return rows.select("location_id", "code", geo.matches(item, east, "overlaps", False).alias("meets_east"),
                       geo.matches(item, east, "within", False).alias("within_east"), geo.matches(item, F.array(F.lit("ANZ")), "within", True).alias("within_anz"),
                       geo.excluded(item, F.array(F.lit("NZ"))).alias("outside"))


def import_matches(spark: SparkSession, d: str) -> DataFrame:
    """Loadable import rows matched to organisations: by identifier, else by a name and town only one organisation has."""
    from ledgerloom.operators.imports import match_imports

    parsed = parse_records(table(spark, d, "import_record"), table(spark, d, "bulk_import_run"))
    return match_imports(parsed, table(spark, d, "bulk_import_run"), table(spark, d, "organisation"), table(spark, d, "organisation_identifier"), table(spark, d, "org_location"))


QUERIES = {f.__name__: f for f in (
    org_name_keys, contact_keys, identifier_keys, candidate_hosts, observation_scores, reconcile_facts, canonical_map, merge_groups,
    blocking_keys, duplicate_candidates, review_queue, organisation_counts, source_document_counts, coverage_matrix, source_targeting,
    evidence_rollup, profile_completeness, latest_observations, contact_points, dangling_evidence, stale_entities, entity_search,
    research_gaps, graph_neighbourhood, graph_paths, shared_documents, location_scope, import_matches)}

_SUFFIX = "|".join(text.LEGAL_SUFFIXES)


def _name(c: str) -> str:
    return (rf"regexp_replace(trim(regexp_replace(replace(lower(regexp_replace(strip_accents({c}), '[^\x00-\x7F]', '', 'g')), '&', ' and '), '[^a-z0-9]+', ' ', 'g')),"
            rf" '([a-z0-9])( (?:{_SUFFIX}))+$', '\1')")


_HOST = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim({c})), '^[a-z][a-z0-9+.\-]*://|^//', ''), '[/?#].*$', ''), '^.*@|:\d*$', '', 'g'), '^www\.', '')"
_HALF = "CASE predicate " + " ".join(f"WHEN '{p}' THEN {v if v is not None else 'NULL'}" for p, v in conf.HALF_LIFE_DAYS.items()) + f" ELSE {conf.DEFAULT_HALF_LIFE_DAYS} END"
_LIKED = " OR ".join(f"(predicate = '{p}' AND source_category IN ({', '.join(repr(c) for c in cs)}))" for p, cs in conf.PREFERRED.items())
_AUTH = f"round(CASE WHEN {_LIKED} THEN least(1.0, least(1.0, 1.0 - 0.08 * (greatest(1, authority_tier) - 1))::DOUBLE + 0.1) ELSE greatest(0.0, least(1.0, 1.0 - 0.08 * (greatest(1, authority_tier) - 1))) END::DOUBLE, 3)"
_FRESH = f"coalesce(round(pow(0.5, greatest(0.0, (epoch_us(TIMESTAMPTZ '{AS_OF}+00') - epoch_us({{t}})) / 86400000000.0) / ({_HALF})), 3), 1.0)"
_PHONE = "CASE WHEN length(regexp_replace({c}, '[^0-9]', '', 'g')) >= 8 THEN right(regexp_replace({c}, '[^0-9]', '', 'g'), 8) END"
_PUBLIC = ", ".join(repr(x) for x in text.PUBLIC_EMAIL_DOMAINS)
_LIVE = "(merged_into_id IS NULL OR trim(merged_into_id) = '')"
_CANON = f"""{_UP.format(col='merged_into_id')},
tops AS (SELECT org_id, arg_max(here, depth) AS here, bool_or(looped) AS looped, arg_max(seen, depth) AS seen FROM climb GROUP BY org_id),
canon AS (SELECT org_id, CASE WHEN looped THEN list_min(list_slice(seen, list_position(seen, here), len(seen))) ELSE here END AS root_id, looped FROM tops)"""
_CORR = "CASE WHEN {n} <= 1 THEN 1.0 ELSE round(least(1.2, 1.0 + 0.08 * ({n} - 1)), 3) END::DOUBLE"
_LINKS = """org AS (SELECT org_id, min(struct_pack(p := parent_organisation_id, m := merged_into_id, c := entity_confidence)) AS o FROM organisation GROUP BY org_id),
rel AS (SELECT org_id AS subject, o.p AS object, 'child_of' AS relation, round(coalesce(o.c, 0.5), 3) AS confidence FROM org
        UNION ALL SELECT org_id, o.m, 'merged_into', round(coalesce(o.c, 0.5), 3) FROM org),
good AS (SELECT * FROM rel WHERE trim(object) <> '' AND object <> subject),
links AS (SELECT src, dst, relation, max(confidence) AS confidence FROM (
  SELECT subject AS src, object AS dst, relation, confidence FROM good UNION ALL SELECT object, subject, relation, confidence FROM good) GROUP BY ALL),
best AS (SELECT src, dst, max(confidence) AS confidence FROM links GROUP BY src, dst),
starts AS (SELECT DISTINCT src AS id FROM links),
one AS (SELECT s.id AS start, b.dst AS id, round(b.confidence, 3) AS reach FROM starts s JOIN best b ON b.src = s.id WHERE round(b.confidence, 3) >= 0.05),
two AS (SELECT o.start, b.dst AS id, max(round(o.reach * b.confidence, 3)) AS reach FROM one o JOIN best b ON b.src = o.id
        WHERE b.dst <> o.start AND (o.start, b.dst) NOT IN (SELECT (start, id) FROM one) GROUP BY o.start, b.dst HAVING max(round(o.reach * b.confidence, 3)) >= 0.05)"""

SQL = {
    "org_name_keys": rf"""WITH n AS (SELECT DISTINCT org_id, canonical_name, {_name('canonical_name')} AS name_key FROM organisation)
SELECT org_id, name_key, array_to_string(list_sort(list_distinct(list_filter(string_split(name_key, ' '), lambda t: length(t) >= 2 AND t NOT IN {text.STOP_WORDS}))), ' ') AS blocking FROM n""",
    "contact_keys": rf"""WITH k AS (SELECT org_id, predicate, CASE predicate WHEN 'phone' THEN {_PHONE.format(c='object_value')}
  WHEN 'email' THEN CASE WHEN contains(object_value, '@') THEN nullif({_HOST.format(c="regexp_extract(object_value, '[^@]*$')")}, '') END
  ELSE {_HOST.format(c='object_value')} END AS key FROM observation WHERE predicate IN ('phone', 'email', 'website_domain') AND normalisation_status <> 'rejected')
SELECT DISTINCT org_id, predicate, key FROM k WHERE key IS NOT NULL AND NOT (predicate = 'email' AND key IN ({_PUBLIC}))""",
    "identifier_keys": r"""SELECT org_id, scheme, upper(regexp_replace(value, '[\s\-./]', '', 'g')) AS value_key, bool_or(is_current) AS is_current,
count(DISTINCT identifier_id) AS sightings FROM organisation_identifier GROUP BY 1, 2, 3""",
    "candidate_hosts": rf"""WITH k AS (SELECT DISTINCT org_id, list_filter(string_split({_name('canonical_name')}, ' '), lambda t: t <> '') AS r FROM organisation),
w AS (SELECT org_id, list_filter(r, lambda t, i: list_position(r, t) = i) AS w FROM k),
s AS (SELECT DISTINCT org_id, unnest([array_to_string(w, ''), array_to_string(w, '-'), array_to_string(w[1:2], ''), coalesce(w[1], '')]) AS stem FROM w),
h AS (SELECT org_id, stem || '.' || e AS host FROM s, (VALUES ('example'), ('com.au')) v(e) WHERE length(stem) >= 3)
SELECT DISTINCT h.org_id, h.host FROM h JOIN observation o ON o.org_id = h.org_id AND o.predicate = 'website_domain' AND {_HOST.format(c='o.object_value')} = h.host""",
    "observation_scores": f"""SELECT observation_id, {_AUTH} AS authority, {_FRESH.format(t='observed_at')} AS freshness
FROM (SELECT DISTINCT observation_id, predicate, source_id, observed_at FROM observation) JOIN source_definition USING (source_id)""",
    "reconcile_facts": f"""WITH RECURSIVE {_CANON},
og AS (SELECT source_id, CASE WHEN authority_tier >= 6 THEN min(source_id) OVER (PARTITION BY source_category, authority_tier) ELSE source_id END AS origin FROM source_definition),
obs AS (SELECT DISTINCT ON (observation_id) * FROM observation WHERE normalisation_status <> 'rejected' AND predicate NOT IN {facts.MANY_VALUED}),
seen AS (SELECT coalesce(c.root_id, o.org_id) AS entity_id, o.*, lower(trim(object_value)) AS vkey, coalesce(og.origin, o.source_id) AS origin, coalesce({_AUTH}, 0.0) AS auth
         FROM obs o LEFT JOIN canon c USING (org_id) LEFT JOIN source_definition s USING (source_id) LEFT JOIN og USING (source_id)),
val AS (SELECT entity_id, predicate, vkey, count(*) AS n, max(auth) AS auth, max(extraction_confidence) AS extraction, max(observed_at) AS newest,
        bool_or(human_verified) AS human, count(DISTINCT source_id) AS sources, count(DISTINCT origin) AS origins, arg_min_null(document_id, struct_pack(a := -auth, b := observed_at, c := observation_id)) AS doc, arg_max(object_value, struct_pack(a := observed_at, b := observation_id)) AS value
        FROM seen GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY entity_id, predicate ORDER BY round(auth * ({_CORR.format(n='origins')}), 6) DESC, extraction DESC, sources DESC, newest DESC, vkey) AS place FROM val),
win AS (SELECT * FROM ranked WHERE place = 1),
lost AS (SELECT s.entity_id, s.predicate, count(DISTINCT s.origin) AS contradicting, count(*) AS n_against FROM seen s
         JOIN win w ON s.entity_id = w.entity_id AND s.predicate = w.predicate AND s.vkey <> w.vkey GROUP BY ALL),
parts AS (SELECT w.*, coalesce(l.contradicting, 0) AS contradicting, coalesce(l.n_against, 0) AS n_against, CASE WHEN human THEN 0.95 ELSE 0.85 END::DOUBLE AS match_score,
          {_FRESH.format(t='newest')} AS freshness_score, {_CORR.format(n='origins')} AS corroboration_score,
          CASE WHEN coalesce(l.contradicting, 0) = 0 THEN 1.0 ELSE round(greatest(0.4, 1.0 - 0.6 * (l.contradicting / (origins + l.contradicting))), 3) END::DOUBLE AS contradiction_score
          FROM win w LEFT JOIN lost l USING (entity_id, predicate)),
full_ AS (SELECT *, round(greatest(0.0, least(1.0, 1.0 * auth * extraction * match_score * freshness_score * corroboration_score * contradiction_score)), 3) AS final_confidence,
          contradicting > 0 AND contradicting / (origins + contradicting) >= 1.0::DOUBLE / 3 AS conflicted, freshness_score < 0.3 AS stale FROM parts)
SELECT entity_id, predicate, value, CASE WHEN conflicted THEN 'conflicted' WHEN stale THEN 'stale'
  WHEN (final_confidence >= 0.8 AND origins >= 2) OR (human AND final_confidence >= 0.6) THEN 'confirmed' WHEN final_confidence >= 0.55 THEN 'probable'
  WHEN final_confidence >= 0.3 THEN 'possible' ELSE 'unknown' END AS status,
  auth AS authority_score, extraction AS extraction_score, match_score, freshness_score, corroboration_score, contradiction_score, final_confidence,
  CASE WHEN conflicted THEN 'conflicted' WHEN stale THEN 'stale' WHEN human THEN 'verified' WHEN final_confidence >= 0.75 THEN 'high'
  WHEN final_confidence >= 0.5 THEN 'moderate' WHEN final_confidence >= 0.3 THEN 'low' ELSE 'speculative' END AS confidence_vocabulary,
  CAST(origins AS INTEGER) AS independent_source_count, n AS supporting_observations, n_against AS contradicting_observations, doc AS best_evidence_document_id,
  strftime(newest AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS last_observed_at FROM full_""",
    "canonical_map": f"WITH RECURSIVE {_CANON} SELECT org_id, root_id, looped FROM canon",
    "merge_groups": f"WITH RECURSIVE {_CANON} SELECT root_id, count(*) AS members, min(org_id) AS least_id FROM canon WHERE NOT looped GROUP BY root_id HAVING count(*) > 1",
    "blocking_keys": rf"""WITH live AS (SELECT org_id, any_value(canonical_name) AS c, any_value(legal_name) AS l, any_value(trading_names) AS t FROM organisation WHERE {_LIVE} GROUP BY org_id),
raw AS (SELECT org_id, unnest(list_concat([c, l], coalesce(t, []))) AS n FROM live),
names AS (SELECT DISTINCT org_id, {_name('n')} AS k FROM raw WHERE n IS NOT NULL),
loc AS (SELECT org_id, arg_min(struct_pack(a := address_lines, p := postal_code, l := locality, r := region, c := country), location_id) AS x FROM org_location GROUP BY org_id),
addr AS (SELECT org_id, list_filter(list_transform(list_filter(list_concat(x.a, [x.p, x.l, x.r, x.c]), lambda v: v IS NOT NULL), lambda v: trim(v)), lambda v: v <> '') AS parts FROM loc WHERE len(x.a) > 0),
said AS (SELECT * FROM observation WHERE normalisation_status <> 'rejected'),
keys AS (SELECT org_id, 'name:' || k AS key, false AS weak FROM names WHERE k <> ''
  UNION ALL SELECT org_id, 'token:' || t, true FROM (SELECT org_id, unnest(string_split(k, ' ')) AS t FROM names) WHERE length(t) >= 2 AND t NOT IN {text.STOP_WORDS}
  UNION ALL SELECT org_id, 'id:' || scheme || ':' || upper(regexp_replace(coalesce(value_normalised, value), '[\s\-./]', '', 'g')), false FROM organisation_identifier WHERE is_current
  UNION ALL SELECT org_id, 'dom:' || {_HOST.format(c='object_value')}, false FROM said WHERE predicate = 'website_domain'
  UNION ALL SELECT org_id, 'phone:' || {_PHONE.format(c='object_value')}, false FROM said WHERE predicate = 'phone'
  UNION ALL SELECT org_id, 'email:' || h, false FROM (SELECT org_id, CASE WHEN contains(object_value, '@') THEN nullif({_HOST.format(c="regexp_extract(object_value, '[^@]*$')")}, '') END AS h
    FROM said WHERE predicate = 'email') WHERE h NOT IN ({_PUBLIC})
  UNION ALL SELECT org_id, 'address:' || k, false FROM (SELECT org_id, {_name("array_to_string(parts, ' ')")} AS k FROM addr WHERE len(parts) >= 2) WHERE k <> '')
SELECT key, weak, count(DISTINCT org_id) AS members FROM keys WHERE key IS NOT NULL AND org_id IN (SELECT org_id FROM live) GROUP BY key, weak HAVING count(DISTINCT org_id) > 1""",
    "review_queue": r"""SELECT candidate_id, score, conflict_count FROM (SELECT DISTINCT * FROM entity_match_candidate
WHERE regexp_replace(lower(trim(match_state)), '[\s\-]+', '_', 'g') IN ('possible_review', 'unresolved'))
ORDER BY score DESC NULLS LAST, conflict_count DESC, created_at, candidate_id LIMIT 200""",
    "organisation_counts": """WITH o AS (SELECT org_id, max(coalesce(trim(merged_into_id) <> '', false)) AS m FROM organisation GROUP BY org_id)
SELECT count(*) AS total, count(*) FILTER (m) AS merged, count(*) FILTER (NOT m) AS live FROM o""",
    "source_document_counts": """SELECT lower(trim(source)) AS source, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars,
count(DISTINCT sha256(text)) AS distinct_texts FROM documents GROUP BY 1""",
    "coverage_matrix": """SELECT source_category AS category, coalesce(language, 'UNKNOWN') AS language, count(DISTINCT source_id) AS coverages,
count(DISTINCT source_id) AS sources FROM source_definition GROUP BY 1, 2""",
    "source_targeting": f"""SELECT DISTINCT source_id, source_category IN ('government_registry', 'directory') AND coalesce(language = 'en', true) AS matched
FROM source_definition WHERE lifecycle_status <> 'disabled' AND created_at <= TIMESTAMPTZ '{AS_OF}+00'""",
    "evidence_rollup": """SELECT document_id, array_to_string(list_sort(list(DISTINCT predicate)), ',') AS predicates, count(DISTINCT observation_id) AS observations,
max(extraction_confidence) AS max_confidence, count(DISTINCT org_id) AS organisations FROM observation WHERE document_id IS NOT NULL GROUP BY 1""",
    "profile_completeness": """WITH o AS (SELECT org_id, max((legal_name IS NOT NULL)::INT) + max((country_of_registration IS NOT NULL)::INT) AS n FROM organisation GROUP BY org_id),
s AS (SELECT org_id, max((predicate = 'phone')::INT) + max((predicate = 'website_domain')::INT) AS n FROM observation WHERE normalisation_status <> 'rejected' GROUP BY org_id)
SELECT o.org_id, round((o.n + coalesce(s.n, 0) + (o.org_id IN (SELECT org_id FROM organisation_identifier))::INT + (o.org_id IN (SELECT org_id FROM org_location))::INT) / 6, 3) AS completeness
FROM o LEFT JOIN s USING (org_id)""",
    "latest_observations": """SELECT org_id, predicate, arg_max(object_value, struct_pack(a := observed_at, b := observation_id)) AS value,
count(DISTINCT observation_id) AS observations FROM observation GROUP BY 1, 2""",
    "contact_points": f"""SELECT org_id, predicate, lower(trim(object_value)) AS contact, max(extraction_confidence) AS confidence, count(DISTINCT observation_id) AS evidence,
bool_or(predicate = 'email' AND lower(string_split(trim(object_value), '@')[1]) IN {text.ROLE_WORDS}) AS role_based
FROM observation WHERE predicate IN ('phone', 'email') AND normalisation_status <> 'rejected' GROUP BY 1, 2, 3""",
    "dangling_evidence": """WITH o AS (SELECT DISTINCT observation_id, document_id, source_id, org_id FROM observation)
SELECT observation_id, 'document' AS missing FROM o WHERE document_id IS NOT NULL AND document_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT observation_id, 'source' FROM o WHERE source_id NOT IN (SELECT source_id FROM source_definition)
UNION ALL SELECT observation_id, 'organisation' FROM o WHERE org_id NOT IN (SELECT org_id FROM organisation)""",
    "stale_entities": """WITH s AS (SELECT org_id, max(observed_at) AS seen FROM observation GROUP BY 1), k AS (SELECT org_id, max(last_observed_at) AS known FROM fact_assertion GROUP BY 1)
SELECT org_id, known IS NULL AS unknown FROM s LEFT JOIN k USING (org_id) WHERE known IS NULL OR seen > known""",
    "entity_search": rf"""SELECT DISTINCT org_id, canonical_name FROM organisation WHERE {_LIVE} AND (canonical_name ILIKE '%scaff%' OR legal_name ILIKE '%scaff%'
OR org_id IN (SELECT org_id FROM organisation_identifier WHERE contains(upper(regexp_replace(value, '[\s\-./]', '', 'g')), '4821')))""",
    "research_gaps": """WITH k AS (SELECT DISTINCT org_id, kind FROM organisation, (VALUES ('phone'), ('email'), ('website_domain'), ('location'), ('employee_count_band')) v(kind))
SELECT org_id, 'missing:' || kind AS gap FROM k WHERE (org_id, kind) NOT IN (SELECT (org_id, predicate) FROM observation WHERE normalisation_status <> 'rejected')
UNION ALL SELECT DISTINCT org_id, status || '_fact:' || predicate FROM fact_assertion WHERE status IN ('conflicted', 'stale')""",
    "graph_neighbourhood": f"WITH {_LINKS} SELECT start, id, CAST(1 AS INTEGER) AS hops, reach AS confidence FROM one UNION ALL SELECT start, id, CAST(2 AS INTEGER), reach FROM two",
    "graph_paths": f"""WITH {_LINKS}, walks AS (SELECT t.start AS source, t.id AS target, t.start || '>' || a.dst || '>' || t.id AS path, round(a.confidence * b.confidence, 3) AS confidence
  FROM two t JOIN best a ON a.src = t.start JOIN best b ON b.src = a.dst AND b.dst = t.id)
SELECT * FROM walks QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY confidence DESC, path) <= 5""",
    "shared_documents": """WITH m AS (SELECT org_id AS member, document_id AS event, max(extraction_confidence) AS confidence FROM observation WHERE document_id IS NOT NULL GROUP BY 1, 2)
SELECT a.member AS start, b.member AS id, CAST(1 AS INTEGER) AS hops, max(round(least(a.confidence, b.confidence), 3)) AS confidence
FROM m a JOIN m b ON a.event = b.event AND b.member <> a.member GROUP BY 1, 2""",
    "location_scope": "WITH c AS (SELECT DISTINCT location_id, CASE WHEN country IN ('AU', 'Australia') THEN 'AU' WHEN country IN ('NZ', 'New Zealand') THEN 'NZ' END AS land, CASE region "
                      + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATE_CODES.items()) + """ ELSE region END AS state FROM org_location),
k AS (SELECT DISTINCT location_id, CASE WHEN land IS NOT NULL THEN land || coalesce('-' || state, '') END AS code FROM c)
SELECT location_id, code, coalesce(code = 'AU' OR code IN ('AU-NSW', 'AU-QLD', 'AU-VIC'), false) AS meets_east, coalesce(code IN ('AU-NSW', 'AU-QLD', 'AU-VIC'), false) AS within_east,
true AS within_anz, coalesce(code = 'NZ' OR starts_with(code, 'NZ-'), false) AS outside FROM k""",
    "import_matches": rf"""WITH {_P6_PARSE}, loaded AS (SELECT r.*, s.f, s.header, s.mapping FROM reasons r JOIN split s USING (run_id, line_no) WHERE r.reason IS NULL),
rows AS (SELECT run_id, line_no, {_name('name')} AS name_key, nullif(upper(regexp_replace(f[list_position(header, json_extract_string(mapping, '$.columns.identifier'))], '[\s\-./]', '', 'g')), '') AS ident,
         lower(trim(f[list_position(header, json_extract_string(mapping, '$.columns.locality'))])) AS town FROM loaded),
ids AS (SELECT upper(regexp_replace(value, '[\s\-./]', '', 'g')) AS ident, min(org_id) AS org_id FROM organisation_identifier WHERE scheme = 'abn' GROUP BY 1 HAVING count(DISTINCT org_id) = 1),
places AS (SELECT {_name('canonical_name')} AS name_key, lower(trim(locality)) AS town, min(o.org_id) AS org_id FROM organisation o JOIN org_location l USING (org_id)
           WHERE locality IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT o.org_id) = 1)
SELECT run_id, line_no, coalesce(i.org_id, p.org_id) AS org_id, CASE WHEN i.org_id IS NOT NULL THEN 'identifier' WHEN p.org_id IS NOT NULL THEN 'name_place' ELSE 'new' END AS matched_by
FROM rows r LEFT JOIN ids i ON r.ident = i.ident LEFT JOIN places p ON r.name_key = p.name_key AND r.town = p.town""",
}
