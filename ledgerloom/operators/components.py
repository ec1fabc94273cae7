"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ledgerloom.session import Stash


def _with_least(edges: DataFrame) -> DataFrame:
    """Rows (u, v, m): m is the least of u and its neighbours. A hot u is split by AQE, as both sides meet in a join."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u"), F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def connected_components(edges: DataFrame, src: str, dst: str, stash: Stash | None = None) -> DataFrame:
    """``(id, component)`` for every vertex of ``edges``; component is the least id of the component.

    Rows with a null end are ignored, a self-link alone makes a component of its own, repeats do not matter.
    Each round is two aggregations with map-side combining and two joins; the number of rounds grows with the
    logarithm of the longest path. No component is brought to one task or the driver.
    """
    own = stash or Stash(edges.sparkSession)
    a, b = F.col(src), F.col(dst)
    clean = edges.select(a.alias("u"), b.alias("v")).where(a.isNotNull() & b.isNotNull())
    loops = clean.where("u = v").select("u")

    def put(df: DataFrame) -> tuple[DataFrame, tuple]:
        """Writes the edges; their number and a hash of them are observed on the way, without a pass of their own."""
        seen = Observation()
        out = own.put(df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")))
        return out, (seen.get["n"], seen.get["h"])

    work, before = put(clean.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    ends = work.select(F.explode(F.array("u", "v")).alias("id"))
    vertices = own.put(ends.unionByName(loops.select(F.col("u").alias("id"))).distinct())

    while before[0]:
        both = work.unionByName(work.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        mid = own.put(large)
        down = mid.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = _with_least(down)
        after, now = put(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v")))
            .where("u <> v").distinct())
        own.drop(work)
        own.drop(mid)
        work = after
        if now == before:
            break
        before = now
    return vertices.join(work.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select(
        "id", F.coalesce("component", "id").alias("component"))
