"""What is known and what is missing about organisations: classifications, sizes, open questions, completion, group views."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.records import strengthened

# What a source category lets a claim be, and how sure; other categories are observed at 0.5.
ASSIGNMENTS = {
    "government_registry": ("registered", 0.9), "regulator": ("registered", 0.9), "bulk_dataset": ("observed", 0.6),
    "company_website": ("self_described", 0.7), "industry_association": ("observed", 0.6), "directory": ("observed", 0.4)}
OTHER_ASSIGNMENT = ("observed", 0.5)
CLAIMS = {"service_claim": "service_taxonomy", "archetype_claim": "company_archetypes"}
# Bands of employees, and capability states that count as shown.
BANDS = ("1-4", "5-19", "20-49", "50-199", "200+")
SHOWN = ("evidenced", "repeatedly_evidenced", "verified")
# What a finished profile needs.
NEEDS = ("stable_identity", "official_domain", "specific_location", "public_contact_route", "business_description", "evidenced_relevance")
# Questions asked for what is missing, and for facts in a state, with their priority.
MISSING = {"identifier": ("missing_identifier", 0.8), "domain": ("missing_domain", 0.7), "location": ("missing_location", 0.6),
           "contact": ("missing_contact", 0.5), "capability": ("no_capability_evidence", 0.6)}
DOUBTS = {"conflicted": ("conflicted_fact", 0.8), "stale": ("stale_fact", 0.55)}
CONTRADICTED = ("contradicted_capability", 0.75)


def assignment_of(category: Column, tier: Column) -> Column:
    """(assignment_type, confidence) that a source of that category and authority tier gives a claim."""
    kind, base = F.lit(OTHER_ASSIGNMENT[0]), F.lit(OTHER_ASSIGNMENT[1])
    for name, (k, c) in ASSIGNMENTS.items():
        kind, base = F.when(category == name, k).otherwise(kind), F.when(category == name, c).otherwise(base)
    factor = F.greatest(F.lit(0.45), 1.0 - 0.08 * (F.least(F.greatest(tier, F.lit(1)), F.lit(7)) - 1))
    return F.struct(kind.alias("assignment_type"), F.round(base * factor, 3).alias("confidence"))


def classified(claims: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Classification assignments from claims: one row per entity, taxonomy and category.

    ``claims``: entity_id, predicate, value, observation_id, source_category, authority_tier; ``vocabulary``: predicate,
    category_id, category_label. Claims outside the vocabulary are left out, not guessed; repeats strengthen.
    """
    known = claims.where(F.col("predicate").isin(*CLAIMS)).join(
        vocabulary.select("predicate", F.col("category_id").alias("value"), "category_label").dropDuplicates(["predicate", "value"]), ["predicate", "value"])
    taxonomy = F.when(F.col("predicate") == "service_claim", CLAIMS["service_claim"]).otherwise(CLAIMS["archetype_claim"])
    rows = known.withColumn("a", assignment_of(F.col("source_category"), F.coalesce("authority_tier", F.lit(5)))).select(
        "entity_id", taxonomy.alias("taxonomy_id"), F.col("value").alias("category_id"), "category_label", "a.*", F.array("observation_id").alias("evidence_ids"))
    return strengthened(rows, ["entity_id", "taxonomy_id", "category_id", "category_label"])


def active(assignments: DataFrame, entities: DataFrame, retracted: bool = False) -> DataFrame:
    """Assignments of the entities, without rejected ones unless asked for."""
    rows = assignments.join(entities.select("entity_id").distinct(), "entity_id", "left_semi")
    return rows if retracted else rows.where("assignment_type <> 'rejected'")


def sizes(entities: DataFrame) -> DataFrame:
    """``(entity_id, concept, band, confidence)`` of three size concepts; what has no evidence is unresolved.

    ``entities``: entity_id, band and band_confidence of the employee fact (null without), units, subsidiaries, shown and
    claimed capabilities, all of the merge group. No precision beyond the band is made up.
    """
    band = F.when(F.col("band").isin(*BANDS), F.col("band"))
    breadth = F.col("units") + F.col("subsidiaries")
    size = lambda concept, value, sure: F.struct(F.lit(concept).alias("concept"), value.alias("band"), sure.cast("double").alias("confidence"))
    legal = size("legal_entity_size", F.coalesce(band, F.lit("unresolved")), F.when(band.isNotNull(), F.round("band_confidence", 3)).otherwise(0.0))
    group = size("operating_group_size", F.when(breadth >= 2, "multi-site").when(breadth == 1, "single-site").otherwise("unresolved"), F.when(breadth >= 1, 0.6).otherwise(0.0))
    bare = (F.col("shown") + F.col("claimed") + F.col("units") == 0) & F.col("band").isNull()
    tier = (F.when(bare, "unresolved").when((F.col("shown") >= 3) & (F.col("units") >= 2) & F.coalesce(F.col("band").isin("50-199", "200+"), F.lit(False)), "A")
            .when((F.col("shown") >= 2) & ((F.col("units") >= 1) | F.coalesce(F.col("band").isin("20-49", "50-199"), F.lit(False))), "B")
            .when(F.col("shown") >= 1, "C").otherwise("D"))
    capability = size("capability_tier", tier, F.when(tier == "A", 0.7).when(tier == "B", 0.6).when(tier == "C", 0.55).when(tier == "D", 0.4).otherwise(0.0))
    return entities.select("entity_id", F.explode(F.array(legal, group, capability)).alias("s")).select("entity_id", "s.*")


def needed_questions(entities: DataFrame, facts: DataFrame, capabilities: DataFrame) -> DataFrame:
    """``(entity_id, question_type, priority)``: what is missing, contradicted, conflicted or stale.

    ``entities``: entity_id and a boolean column per key of ``MISSING`` saying whether it is there; ``facts``: entity_id, predicate,
    status; ``capabilities``: entity_id, capability_id, status. One row per type however often it is met.
    """
    lacks = F.array_compact(F.array(*[F.when(~F.coalesce(F.col(c), F.lit(False)), F.struct(F.lit(q).alias("question_type"), F.lit(p).alias("priority"))) for c, (q, p) in MISSING.items()]))
    missing = entities.select("entity_id", F.explode(lacks).alias("q")).select("entity_id", "q.*")
    doubt = facts.where(F.col("status").isin(*DOUBTS)).select(
        "entity_id", F.concat_ws(":", F.when(F.col("status") == "conflicted", DOUBTS["conflicted"][0]).otherwise(DOUBTS["stale"][0]), "predicate").alias("question_type"),
        F.when(F.col("status") == "conflicted", DOUBTS["conflicted"][1]).otherwise(DOUBTS["stale"][1]).alias("priority"))
    against = capabilities.where("status = 'contradicted'").select("entity_id", F.concat_ws(":", F.lit(CONTRADICTED[0]), "capability_id").alias("question_type"), F.lit(CONTRADICTED[1]).alias("priority"))
    return missing.unionByName(doubt).unionByName(against).groupBy("entity_id", "question_type").agg(F.max("priority").alias("priority"))


def question_changes(open_questions: DataFrame, needed: DataFrame) -> DataFrame:
    """``(entity_id, question_type, change)``: asked where needed and not open; resolved where open, asked by the system and no
    longer needed; kept otherwise. Questions of people are never resolved."""
    mine = open_questions.groupBy("entity_id", "question_type").agg(F.bool_and(F.col("generated_by") == "system").alias("ours"))
    now = needed.select("entity_id", "question_type", F.lit(True).alias("need"))
    change = F.when(F.col("ours").isNull(), "asked").when(F.col("need").isNull() & F.col("ours"), "resolved").otherwise("kept")
    return mine.join(now, ["entity_id", "question_type"], "full").select("entity_id", "question_type", change.alias("change"))


def decided_questions(questions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Questions with the latest decision (resolved or dismissed); decisions on closed or unknown questions change nothing."""
    last = decisions.where(F.col("status").isin("resolved", "dismissed")).groupBy("question_id").agg(F.max_by("status", F.struct("at", "status")).alias("decided"))
    live = F.col("status").isin("open", "in_progress")
    return questions.join(last, "question_id", "left").withColumn("status", F.when(live, F.coalesce("decided", "status")).otherwise(F.col("status"))).drop("decided")


def question_queue(questions: DataFrame, most: int = 200) -> DataFrame:
    """Open questions, the most urgent first, then the oldest."""
    return questions.where(F.col("status").isin("open", "in_progress")).orderBy(F.desc("priority"), "created_at", "entity_id", "question_type").limit(most)


def completion(entities: DataFrame) -> DataFrame:
    """``(entity_id, complete, score, present, missing, signature)`` from one boolean column per entry of ``NEEDS``.

    Missing is no false fact: null counts as not there. The signature is the same as long as the entity's needs are.
    """
    there = lambda c: F.coalesce(F.col(c), F.lit(False))
    present = F.array_compact(F.array(*[F.when(there(c), F.lit(c)) for c in NEEDS]))
    missing = F.array_compact(F.array(*[F.when(~there(c), F.lit(c)) for c in NEEDS]))
    rows = entities.select("entity_id", present.alias("present"), missing.alias("missing"))
    quoted = lambda a: F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ","), F.lit("]"))
    text = F.concat(F.lit('{"entity_id":"'), "entity_id", F.lit('","missing":'), quoted(F.col("missing")), F.lit(',"present":'), quoted(F.col("present")), F.lit("}"))
    return rows.select("entity_id", (F.size("missing") == 0).alias("complete"), F.round(F.size("present") / len(NEEDS), 3).alias("score"), "present", "missing",
                       F.left(F.sha2(text, 256), F.lit(20)).alias("signature"))


def research_queries(entities: DataFrame) -> DataFrame:
    """``(entity_id, queries)``: search queries from the strongest identity outward.

    ``entities``: entity_id, name, identifiers (array), locality, region, missing (array of ``NEEDS``).
    """
    quoted = F.concat(F.lit('"'), "name", F.lit('"'))
    place = F.concat_ws(" ", "locality", "region")
    ask = lambda *needs: F.arrays_overlap("missing", F.array(*[F.lit(n) for n in needs]))
    plan = F.concat(
        F.array(F.concat(quoted, F.lit(" official website"))), F.transform(F.coalesce("identifiers", F.array().cast("array<string>")), lambda i: F.concat(quoted, F.lit(' "'), i, F.lit('"'))),
        F.array_compact(F.array(F.when(place != "", F.concat_ws(" ", quoted, place)), F.when(ask("public_contact_route", "specific_location"), F.concat(quoted, F.lit(" contact address phone email"))),
                                F.when(ask("business_description", "evidenced_relevance"), F.concat(quoted, F.lit(" services capabilities projects"))))))
    return entities.select("entity_id", F.array_distinct(plan).alias("queries"))


def attributed(children: DataFrame, canonical: DataFrame) -> DataFrame:
    """Child rows of merged records under the canonical one: adds ``root_id`` and keeps the record they came from as ``origin_id``."""
    return children.withColumnRenamed("org_id", "origin_id").join(canonical.select(F.col("org_id").alias("origin_id"), "root_id"), "origin_id")


def duplicate_warnings(candidates: DataFrame, canonical: DataFrame, states: Iterable[str]) -> DataFrame:
    """``(root_id, candidate_id, other_id)``: open match candidates of each group, seen from either side."""
    rows = candidates.where(F.col("state").isin(*states)).select("candidate_id", "a", "b").distinct()
    sides = rows.select("candidate_id", F.col("a").alias("org_id"), F.col("b").alias("other_id")).unionByName(
        rows.select("candidate_id", F.col("b").alias("org_id"), F.col("a").alias("other_id")))
    return sides.join(canonical.select("org_id", "root_id"), "org_id").select("root_id", "candidate_id", "other_id").distinct()


def facts_current(concluded: DataFrame, evidence: DataFrame) -> DataFrame:
    """``(entity_id, current)``: whether predicates and observation ids behind the conclusions equal those on record.

    Both: entity_id, predicate, observation_id. One full join of per-entity hashes of the sets, whatever their size.
    """
    digest = lambda df, n: df.select("entity_id", "predicate", "observation_id").distinct().groupBy("entity_id").agg(
        F.sum(F.xxhash64("predicate", "observation_id").cast("decimal(38,0)")).alias(f"h{n}"), F.count("*").alias(f"n{n}"))
    both = digest(concluded, 1).join(digest(evidence, 2), "entity_id", "full")
    return both.select("entity_id", (F.col("h1").eqNullSafe(F.col("h2")) & F.col("n1").eqNullSafe(F.col("n2"))).alias("current"))


def evidence_documents(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """``(entity_id, kind, document_id, uses)``: arrays of evidence ids spread out and joined to the documents they name."""
    spread = rows.select("entity_id", "kind", F.explode("evidence_ids").alias("document_id"))
    return spread.join(documents.select("document_id").distinct(), "document_id").groupBy("entity_id", "kind", "document_id").agg(F.count("*").alias("uses"))


def decided_matches(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates with the latest decision: merge (state exact, with a merge to do), related or distinct; undecided ones keep
    their state, and a rescan never changes decided ones."""
    last = decisions.where(F.col("decision").isin("merge", "related", "distinct")).groupBy("candidate_id").agg(F.max_by("decision", F.struct("at", "decision")).alias("decision"))
    state = F.when(F.col("decision") == "merge", "exact").when(F.col("decision") == "related", "related_but_distinct").when(F.col("decision") == "distinct", "confirmed_distinct").otherwise(F.col("state"))
    return candidates.join(last, "candidate_id", "left").withColumn("state", state).withColumn("merges", F.coalesce(F.col("decision") == "merge", F.lit(False)))


def upserted(rows: DataFrame, keys: list[str], flags: Iterable[str] = (), first: str | None = None, last: str | None = None) -> DataFrame:
    """One row per key: flags are or-ed, the earliest ``first`` and the latest ``last`` kept, the sightings counted."""
    aggs = [F.bool_or(F.coalesce(f, F.lit(False))).alias(f) for f in flags]
    aggs += [F.min(first).alias(first)] if first else []
    aggs += [F.max(last).alias(last)] if last else []
    return rows.groupBy(*keys).agg(*aggs, F.count("*").alias("sightings"))


def vocabulary_of(pack: str) -> list[tuple[str, str, str]]:
    """(predicate, category_id, category_label) of a pack's JSON: ``{"services": {id: label}, "archetypes": {id: label}}``."""
    parts = json.loads(pack)
    return [(p, k, v) for p, part in (("service_claim", "services"), ("archetype_claim", "archetypes")) for k, v in parts.get(part, {}).items()]


def bounded_confidence(confidence: Column, evidence: Column) -> Column:
    """Null where a confidence may not stand: outside 0 to 1, or above a half without evidence."""
    some = F.coalesce(F.size(evidence), F.lit(0)) > 0
    return F.when((confidence >= 0) & (confidence <= 1) & ((confidence <= 0.5) | some), confidence)
