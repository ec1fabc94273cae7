"""Which sources cover a request: conjunctive coverage tuples over dimensions, places by the geography algebra."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import geography as geo

REGION = "region"


def coverage_matches(coverages: DataFrame, targets: DataFrame, wanted: dict[str, Iterable[str]], as_of: Column, unknown: bool = True,
                     regions: dict[str, Iterable[str]] = geo.REGIONS) -> DataFrame:
    """``(source_id, coverage_key, matched, outcomes)`` for coverages active and valid at ``as_of``.

    ``targets``: coverage_key, dimension, target_key, polarity (include, exclude). For each wanted dimension the first
    that holds decides: an excluded target covers a wanted value: excluded; no included target: unknown; an included one
    meets a wanted value: matched; else no_match. A coverage matches if every dimension does, unknown as ``unknown`` says.
    """
    live = coverages.where((F.col("lifecycle_status") == "active") & (F.col("valid_from").isNull() | (F.col("valid_from") <= as_of)) & (
        F.col("valid_to").isNull() | (F.col("valid_to") >= as_of)))
    lists = targets.groupBy("coverage_key").agg(*[
        F.array_sort(F.collect_set(F.when((F.col("dimension") == dim) & (F.col("polarity") == pol), F.col("target_key")))).alias(f"{dim}_{pol}")
        for dim in wanted for pol in ("include", "exclude")])
    rows = live.join(lists, "coverage_key", "left")
    outcomes = []
    for dim, values in wanted.items():
        ask = F.array(*[F.lit(v) for v in values]).cast("array<string>")
        have = F.coalesce(F.col(f"{dim}_include"), F.array().cast("array<string>"))
        barred = F.coalesce(F.col(f"{dim}_exclude"), F.array().cast("array<string>"))
        if dim == REGION:
            hit_bar = F.exists(ask, lambda v: F.exists(barred, lambda b: geo.covers(b, v, regions)))
            hit = geo.matches(have, ask, "overlaps", False, regions)
        else:
            hit_bar, hit = F.arrays_overlap(barred, ask), F.arrays_overlap(have, ask)
        outcomes.append(F.struct(F.lit(dim).alias("dimension"), (
            F.when(F.size(ask) == 0, "matched").when(hit_bar, "excluded").when(F.size(have) == 0, "unknown").when(hit, "matched").otherwise("no_match")).alias("outcome")))
    good = ("matched", "unknown") if unknown else ("matched",)
    return rows.withColumn("outcomes", F.array(*outcomes)).select(
        "source_id", "coverage_key", F.forall("outcomes", lambda o: o["outcome"].isin(*good)).alias("matched"), "outcomes")


def source_matches(matched: DataFrame) -> DataFrame:
    """A source matches if one of its coverages does; with the keys of those that do."""
    return matched.groupBy("source_id").agg(F.bool_or("matched").alias("matched"), F.array_sort(F.collect_set(F.when(F.col("matched"), F.col("coverage_key")))).alias("coverages"))


def coverage_matrix(coverages: DataFrame, left: str, right: str) -> DataFrame:
    """Counts of distinct coverages and sources for every pair of values of two array columns; none counts as UNKNOWN."""
    one = lambda c: F.explode(F.when(F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0, F.col(c)).otherwise(F.array(F.lit("UNKNOWN"))))
    return coverages.withColumn("x", one(left)).withColumn("y", one(right)).groupBy(F.col("x").alias(left), F.col("y").alias(right)).agg(
        F.countDistinct("coverage_key").alias("coverages"), F.countDistinct("source_id").alias("sources"))
