"""Reconciling observations to one fact per entity and predicate, with inspectable confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import confidence as conf
from ledgerloom.functions.text import value_key
from ledgerloom.operators.components import connected_components
from ledgerloom.operators.hierarchy import hierarchy

# Evidence with many true values at once, and relations that make one source depend on another.
MANY_VALUED = ("service_claim", "archetype_claim", "social_profile", "source_record")
DEPENDENT = ("copied_from", "owned_by", "syndicated_from", "mirror_of", "aggregates", "same_publisher")
CONFLICT_SHARE = 1 / 3


def canonical_map(organisations: DataFrame) -> DataFrame:
    """``(org_id, root_id, looped)``: the organisation at the end of each merge chain. On a loop the least id stands."""
    walked = hierarchy(organisations.select("org_id", "merged_into_id"), "org_id", "merged_into_id", paths=False)
    return walked.select(F.col("id").alias("org_id"), F.col("root").alias("root_id"), (F.col("depth") < 0).alias("looped"))


def independent_origins(relations: DataFrame, as_of: Column) -> DataFrame:
    """``(source_id, origin)``: sources linked by a dependency in force are one origin, named by its least id."""
    live = relations.where(F.col("relationship_type").isin(*DEPENDENT) & (F.col("confidence") >= 0.5) & (
        F.col("valid_to").isNull() | (F.col("valid_to") >= as_of)))
    return connected_components(live, "source_id", "related_source_id").select(F.col("id").alias("source_id"), F.col("component").alias("origin"))


def reconcile(observations: DataFrame, sources: DataFrame, canonical: DataFrame, as_of: Column, origins: DataFrame | None = None) -> DataFrame:
    """One row per canonical entity and predicate: winning value, status, confidence and its components.

    Rejected observations and predicates of many values are left out. The values of a predicate are compared by authority
    times corroboration, then extraction confidence, number of sources, newest observation, and the least value key.
    Exact repeats of an observation count once. Aggregations that combine map-side (per source, per value, per predicate), so
    an entity with any share of the observations is no bottleneck; the winner is taken by an aggregation, not by a window, and
    what speaks against it is counted, not collected.
    """
    obs = observations.where("normalisation_status <> 'rejected'").where(~F.col("predicate").isin(*MANY_VALUED)).select(
        "observation_id", "org_id", "predicate", "object_value", "observed_at", "source_id", "document_id",
        "extraction_confidence", "human_verified").dropDuplicates(["observation_id"])
    tiers = sources.select("source_id", "authority_tier", "source_category")
    if origins is not None:
        tiers = tiers.join(origins, "source_id", "left").withColumn("origin", F.coalesce("origin", "source_id"))
    else:
        tiers = tiers.withColumn("origin", F.col("source_id"))
    joined = obs.join(canonical.select("org_id", "root_id"), "org_id", "left").withColumn(
        "entity_id", F.coalesce("root_id", "org_id")).join(tiers, "source_id", "left")
    seen = joined.withColumn("vkey", value_key(F.col("object_value"))).withColumn(
        "auth", F.coalesce(conf.authority(F.col("authority_tier"), F.col("source_category"), F.col("predicate")), F.lit(0.0)))
    key = ["entity_id", "predicate"]
    per_source = seen.groupBy(*key, "vkey", "origin", "source_id").agg(
        F.count("*").alias("n"), F.max("auth").alias("auth"), F.max("extraction_confidence").alias("extraction"),
        F.max("observed_at").alias("newest"), F.bool_or("human_verified").alias("human"),
        F.max_by("object_value", F.struct("observed_at", "observation_id")).alias("value"),
        F.max(F.struct("observed_at", "observation_id")).alias("at"),
        F.min_by("document_id", F.struct(-F.col("auth"), "observed_at", "observation_id")).alias("document"),
        F.min(F.struct((-F.col("auth")).alias("a"), "observed_at", "observation_id")).alias("document_rank"))
    per_value = per_source.groupBy(*key, "vkey").agg(
        F.sum("n").alias("n"), F.max("auth").alias("auth"), F.max("extraction").alias("extraction"), F.max("newest").alias("newest"),
        F.bool_or("human").alias("human"), F.count("source_id").alias("sources"), F.collect_set("origin").alias("origins"),
        F.max_by("value", "at").alias("value"), F.min_by("document", "document_rank").alias("document"))
    ranked = per_value.withColumn("rank", F.struct(
        F.round(F.col("auth") * conf.corroboration(F.size("origins")), 6).alias("weight"), "extraction", "sources", "newest"))
    # the winner by one aggregation, map-side; what speaks against it by one more that leaves the winning value out
    order = F.struct((-F.col("rank.weight")).alias("a"), (-F.col("rank.extraction")).alias("b"), (-F.col("rank.sources")).alias("c"), (-F.unix_micros("rank.newest")).alias("d"), "vkey")
    best = ranked.groupBy(*key).agg(F.min_by(F.struct("vkey", "value", "auth", "extraction", "newest", "human", "origins", "document", "n"), order).alias("win"))
    lost = per_source.join(best.select(*key, F.col("win.vkey").alias("won")), key).where(~F.col("vkey").eqNullSafe(F.col("won"))).groupBy(*key).agg(
        F.countDistinct("origin").alias("contradicting"), F.sum("n").alias("n_against"))
    merged = best.join(lost, key, "left")
    out = merged.select(*key, "win.*", F.coalesce("contradicting", F.lit(0)).alias("contradicting"), F.coalesce("n_against", F.lit(0)).alias("n_against")).withColumns({
        "supporting": F.size("origins"),
        "match_score": F.when(F.col("human"), 0.95).otherwise(0.85)})
    out = out.withColumns({
        "freshness_score": conf.freshness(F.col("predicate"), F.col("newest"), as_of),
        "corroboration_score": conf.corroboration(F.col("supporting")),
        "contradiction_score": conf.contradiction(F.col("supporting"), F.col("contradicting"))})
    out = out.withColumn("final_confidence", conf.final(*[F.col(c) for c in (
        "auth", "extraction", "match_score", "freshness_score", "corroboration_score", "contradiction_score")]))
    conflicted = (F.col("contradicting") > 0) & (F.col("contradicting") / (F.col("supporting") + F.col("contradicting")) >= CONFLICT_SHARE)
    stale = F.col("freshness_score") < conf.STALE_BELOW
    sure = ((F.col("final_confidence") >= 0.8) & (F.col("supporting") >= 2)) | (F.col("human") & (F.col("final_confidence") >= 0.6))
    return out.select(
        *key, F.col("value"), (F.when(conflicted, "conflicted").when(stale, "stale").when(sure, "confirmed").when(
            F.col("final_confidence") >= 0.55, "probable").when(F.col("final_confidence") >= 0.3, "possible").otherwise("unknown")).alias("status"),
        F.col("auth").alias("authority_score"), F.col("extraction").alias("extraction_score"), "match_score", "freshness_score",
        "corroboration_score", "contradiction_score", "final_confidence",
        conf.wording(F.col("final_confidence"), conflicted, stale, F.col("human")).alias("confidence_vocabulary"),
        F.col("supporting").cast("int").alias("independent_source_count"), F.col("n").alias("supporting_observations"),
        F.col("n_against").alias("contradicting_observations"), F.col("document").alias("best_evidence_document_id"),
        F.col("newest").alias("last_observed_at"))
