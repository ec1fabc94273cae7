"""Joins and folds over record tables: as-of and prefix joins, table diffs, identities, event logs, evidence ledgers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.geography import ancestor_codes
from ledgerloom.operators.hierarchy import hierarchy
from ledgerloom.session import Stash


def as_of_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: Iterable[str], slices: str = "month") -> DataFrame:
    """Each left row with the ``values`` of the latest right row of its key at or before its time; null without one.

    Both sides meet in one stream per key and time slice, ordered by time, where the last right row seen is carried on; what
    is carried into a slice comes from one row per slice. A key with any share of the rows is thus spread over its slices.
    Of right rows with one key and time the greatest values count. Left rows with a null key or time get nulls.
    """
    names = list(values)
    pack = F.struct(*[F.col(v) for v in names])
    r = right.where(F.col(key).isNotNull() & F.col(right_time).isNotNull()).groupBy(F.col(key).alias("__k"), F.col(right_time).alias("__t")).agg(F.max(pack).alias("__v"))
    cut = lambda t: F.date_trunc(slices, t)
    marks = r.select("__k", "__t", cut(F.col("__t")).alias("__s"), "__v", F.lit(0).alias("__o"), F.lit(None).cast(left.select(F.struct(*[f"`{c}`" for c in left.columns]).alias("l")).schema["l"].dataType).alias("__l"))
    asks = left.select(F.col(key).alias("__k"), F.col(left_time).alias("__t"), cut(F.col(left_time)).alias("__s"), F.lit(None).cast(marks.schema["__v"].dataType).alias("__v"),
                       F.lit(1).alias("__o"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("__l"))
    both = marks.unionByName(asks)
    inside = Window.partitionBy("__k", "__s").orderBy("__t", "__o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    over = Window.partitionBy("__k").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    ends = both.groupBy("__k", "__s").agg(F.max_by("__v", F.when(F.col("__o") == 0, F.col("__t"))).alias("__end"))
    carried = ends.select(F.col("__k").alias("__ck"), F.col("__s").alias("__cs"), F.last("__end", True).over(over).alias("__in"))
    seen = both.withColumn("__v", F.last("__v", True).over(inside)).where("__o = 1")
    out = seen.join(carried, F.col("__k").eqNullSafe(F.col("__ck")) & F.col("__s").eqNullSafe(F.col("__cs")), "left")
    known = F.when(F.col("__k").isNotNull() & F.col("__t").isNotNull(), F.coalesce("__v", "__in"))
    return out.withColumn("__v", known).select("__l.*", *[F.col(f"__v.{v}").alias(v) for v in names])


def related_places(left: DataFrame, right: DataFrame, left_code: str, right_code: str) -> DataFrame:
    """Pairs whose place codes are equal or ancestor and descendant, as equi-joins on the ancestors of either side."""
    a = left.withColumn("__up", F.explode(ancestor_codes(F.col(left_code))))
    b = right.withColumn("__up2", F.explode(ancestor_codes(F.col(right_code))))
    under = a.join(right, F.col("__up") == F.col(right_code)).drop("__up")
    over = left.join(b, F.col(left_code) == F.col("__up2")).drop("__up2").where(F.col(left_code) != F.col(right_code))
    return under.unionByName(over)


def table_diff(existing: DataFrame, desired: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``(*keys, change)``: created, updated, unchanged or removed. Keys are unique on each side; nulls compare as equal."""
    old = existing.select(*keys, F.struct(*columns).alias("__old"))
    new = desired.select(*keys, F.struct(*columns).alias("__new"))
    change = (F.when(F.col("__old").isNull(), "created").when(F.col("__new").isNull(), "removed")
              .when(F.to_json("__old") == F.to_json("__new"), "unchanged").otherwise("updated"))
    return old.join(new, keys, "full").select(*keys, change.alias("change"))


def resolve_identities(aliases: DataFrame, known: DataFrame, keys: list[str], owner: str) -> DataFrame:
    """``aliases`` with the owner of their identity and how many owners claim it; more than one is a conflict, with none set."""
    claims = known.where(F.col(owner).isNotNull()).groupBy(*keys).agg(F.min(owner).alias("__a"), F.countDistinct(owner).alias("owners"))
    return aliases.join(claims, keys, "left").withColumn("owners", F.coalesce("owners", F.lit(0))).withColumn(
        owner, F.when(F.col("owners") == 1, F.col("__a"))).drop("__a")


def first_seen(rows: DataFrame, group: list[str], content: str, time: str, tie: str) -> DataFrame:
    """``rows`` with ``novel``: whether the content is new in its group, that is, the row is its first there."""
    least = rows.groupBy(*group, F.sha2(F.col(content), 256).alias("__h")).agg(F.min(F.struct(time, tie)).alias("__m"))
    marked = rows.withColumn("__h", F.sha2(F.col(content), 256)).join(least, [*group, "__h"])
    return marked.withColumn("novel", F.struct(time, tie).eqNullSafe(F.col("__m"))).drop("__h", "__m")


def evidence_union(*lists: Column) -> Column:
    """Distinct ids of the lists, sorted; null lists count as empty."""
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists]))))


def merges_in_force(events: DataFrame) -> DataFrame:
    """``(org_id, merged_into_id)`` from a log of ``(merge_id, survivor_id, absorbed_id, at, reversed_at)``.

    A reversed merge is as if it had never been; of several in force the latest counts (then the greatest merge_id);
    self-merges and nulls are no merges.
    """
    live = events.where("reversed_at is null and survivor_id <> absorbed_id")
    return live.groupBy(F.col("absorbed_id").alias("org_id")).agg(F.max_by("survivor_id", F.struct("at", "merge_id")).alias("merged_into_id"))


def refused_merges(organisations: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (survivor_id, absorbed_id) with the first reason against the merge, null if it can be done."""
    state = hierarchy(organisations.select("org_id", "merged_into_id"), "org_id", "merged_into_id", paths=False).select("id", "root", F.col("parent").alias("into"))
    a = state.select(F.col("id").alias("survivor_id"), F.col("root").alias("root_a"), F.col("into").alias("into_a"))
    b = state.select(F.col("id").alias("absorbed_id"), F.col("root").alias("root_b"), F.col("into").alias("into_b"))
    reason = (F.when(F.col("survivor_id").eqNullSafe(F.col("absorbed_id")), "same").when(F.col("root_a").isNull() | F.col("root_b").isNull(), "unknown")
              .when(F.col("root_a") == F.col("root_b"), "already together").when(F.col("into_a").isNotNull() | F.col("into_b").isNotNull(), "already merged"))
    return wanted.join(a, "survivor_id", "left").join(b, "absorbed_id", "left").select("survivor_id", "absorbed_id", reason.alias("reason"))


# Assignment types, the stronger later.
ASSIGNMENT_STRENGTH = ("registered", "self_described", "observed", "inferred", "human_confirmed", "rejected")


def strengthened(assignments: DataFrame, keys: list[str]) -> DataFrame:
    """One row per assignment: the strongest type, the best confidence (at least 0.9 once a human confirmed), the evidence
    of all; a human rejection stays."""
    rank = F.array_position(F.array(*[F.lit(t) for t in ASSIGNMENT_STRENGTH]), F.col("assignment_type"))
    out = assignments.groupBy(*keys).agg(
        F.max(F.when(F.col("assignment_type") != "rejected", rank)).alias("__r"), F.max("confidence").alias("__c"),
        F.bool_or(F.col("assignment_type") == "rejected").alias("__no"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence_ids")))).alias("evidence_ids"))
    kind = F.when(F.col("__no"), "rejected").otherwise(F.element_at(F.array(*[F.lit(t) for t in ASSIGNMENT_STRENGTH]), F.col("__r").cast("int")))
    sure = F.when(F.col("__no"), 0.0).when(kind == "human_confirmed", F.greatest("__c", F.lit(0.9))).otherwise(F.col("__c"))
    return out.select(*keys, kind.alias("assignment_type"), sure.alias("confidence"), "evidence_ids")


SELF_DESCRIBING = ("company_website", "social_profile")


def claim_ladder(ledger: DataFrame, keys: list[str], as_of: Column) -> DataFrame:
    """Status of each claim from its evidence: verified, contradicted, uncertain, historical, repeatedly_evidenced,
    evidenced, claimed; the first that applies. Repeats of an observation count once, the latest row of it."""
    rows = ledger.groupBy(*keys, "observation_id").agg(F.max(F.struct("observed_at", "source_id", "source_category", "contradicts", "human_verified", "hypothesis")).alias("e")).select(*keys, "e.*")
    support = ~F.col("contradicts")
    own = F.coalesce(F.col("source_category").isin(*SELF_DESCRIBING), F.lit(False))
    agg = rows.groupBy(*keys).agg(
        F.bool_or("human_verified").alias("human"), F.bool_or("contradicts").alias("against"), F.count_if(support).alias("n"), F.max(F.when(support, F.col("observed_at"))).alias("newest"),
        F.countDistinct(F.when(support & ~own, F.col("source_id"))).alias("independent"), F.bool_and(F.when(support, F.col("hypothesis"))).alias("guess"))
    old = (F.unix_micros(as_of) - F.unix_micros("newest")) / 86_400_000_000.0 > 1095
    status = (F.when(F.col("human"), "verified").when(F.col("against"), "contradicted").when(F.col("n") == 0, "uncertain").when(old, "historical")
              .when((F.col("n") >= 3) & (F.col("independent") >= 2), "repeatedly_evidenced").when(F.col("independent") >= 1, "evidenced")
              .when(F.coalesce("guess", F.lit(False)), "uncertain").otherwise("claimed"))
    return agg.select(*keys, status.alias("status"), F.col("n").alias("supporting"), "independent")


def review_priority(candidates: DataFrame) -> DataFrame:
    """Adds ``priority`` from score, importance, rows affected, conflicts, and how easy the case is to decide."""
    impact = F.least(F.lit(1.0), F.col("rows_affected") / 10)
    ease = F.when(F.col("shared_identifier") & (F.col("conflict_count") == 0), 1.0).when(F.col("conflict_count") == 0, 0.8).otherwise(
        F.greatest(F.lit(0.1), F.col("score") - 0.15 * F.col("conflict_count")))
    total = 0.55 * F.col("score") + 0.1 * F.col("importance") + 0.15 * impact + 0.1 * F.least(F.lit(1.0), F.col("conflict_count") / 3) + 0.1 * ease
    return candidates.withColumn("priority", F.round(total, 3))


def crawl_plan(links: DataFrame, seeds: DataFrame, depth: int = 2, pages: int = 30) -> DataFrame:
    """``(source_id, url, depth, rank)`` of the pages a crawl would take: breadth first from the seeds over ``links``
    (source_id, url, target), each page once per source, in order of depth and URL, at most ``pages`` per source (the
    crawl's budget). One join a level."""
    stash = Stash(links.sparkSession)
    known = front = stash.put(seeds.select("source_id", "url", F.lit(0).alias("depth")).distinct())
    for d in range(1, depth + 1):
        ahead = front.join(links, ["source_id", "url"]).select("source_id", F.col("target").alias("url")).where("url is not null").distinct()
        front = stash.put(ahead.join(known.select("source_id", "url"), ["source_id", "url"], "left_anti").withColumn("depth", F.lit(d)))
        known = known.unionByName(front)
    w = Window.partitionBy("source_id").orderBy("depth", "url")
    return known.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= pages)
