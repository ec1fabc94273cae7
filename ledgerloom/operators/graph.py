"""Typed edges between organisations, bounded neighbourhoods and shortest paths.

Joint participation is kept bipartite (organisation - event - organisation): a step goes to the event and on to its
participants, so the pairs within an event are never written out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import Stash

MAX_DEPTH = 4


def edges(relations: DataFrame) -> DataFrame:
    """Both directions of ``(subject, object, relation, confidence)``, one row per pair and relation with the best
    confidence; self-links and null ends are dropped."""
    a = relations.select(F.col("subject").alias("src"), F.col("object").alias("dst"), "relation", "confidence")
    b = relations.select(F.col("object").alias("src"), F.col("subject").alias("dst"), "relation", "confidence")
    return a.unionByName(b).where("src <> dst").groupBy("src", "dst", "relation").agg(F.max("confidence").alias("confidence"))


def _step(frontier: DataFrame, links: DataFrame, meetings: DataFrame | None) -> DataFrame:
    """``(start, dst, reach)`` one hop on: by an edge, or through an event with the least confidence of the two ends."""
    out = frontier.join(links, frontier.id == links.src).select("start", "dst", (F.col("reach") * F.col("confidence")).alias("reach"))
    if meetings is not None:
        there = frontier.join(meetings.select(F.col("member").alias("m"), "event", F.col("confidence").alias("c1")), F.col("id") == F.col("m"))
        back = there.select("start", "id", "event", "reach", "c1").join(meetings.select("event", "member", F.col("confidence").alias("c2")), "event")
        met = back.where("member <> id").select("start", F.col("member").alias("dst"), (F.col("reach") * F.round(F.least("c1", "c2"), 3)).alias("reach"))
        out = out.unionByName(met)
    return out.groupBy("start", "dst").agg(F.max(F.round("reach", 3)).alias("reach"))


def neighbourhood(starts: DataFrame, links: DataFrame, depth: int = 2, least: float = 0.0, meetings: DataFrame | None = None) -> DataFrame:
    """``(start, id, hops, confidence)`` of all nodes within ``depth`` hops of each start.

    Hops is the least number of links; the confidence is the best product over paths that reach the node in that many
    hops, rounded at each hop. Nodes below ``least`` are not gone on from. All starts go together, one join a hop.
    """
    if not 1 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must be 1 to {MAX_DEPTH}")
    stash = Stash(starts.sparkSession)
    frontier = stash.put(starts.select(F.col("id").alias("start"), "id", F.lit(1.0).alias("reach"), F.lit(0).alias("hops")).distinct())
    known = frontier
    for hop in range(1, depth + 1):
        found = _step(frontier, links, meetings).where(F.col("reach") >= least)
        fresh = found.join(known.select("start", F.col("id").alias("dst")), ["start", "dst"], "left_anti")
        frontier = stash.put(fresh.select("start", F.col("dst").alias("id"), "reach", F.lit(hop).alias("hops")))
        known = known.unionByName(frontier)
    return known.where("hops > 0").select("start", "id", "hops", F.col("reach").alias("confidence"))


def shortest_paths(pairs: DataFrame, links: DataFrame, depth: int = MAX_DEPTH, limit: int = 5) -> DataFrame:
    """``(source, target, path, confidence)``: the shortest simple paths of each pair, best product first.

    The breadth-first distances from the source prune the search: a path is only extended to a node at the next distance,
    so the paths kept are the shortest ones only.
    """
    stash = Stash(pairs.sparkSession)
    wanted = pairs.select("source", "target").where("source <> target").distinct()
    near = stash.put(neighbourhood(wanted.select(F.col("source").alias("id")).distinct(), links, depth))
    best = links.groupBy("src", "dst").agg(F.max("confidence").alias("confidence"))
    todo = wanted.join(near.select(F.col("start").alias("source"), F.col("id").alias("target"), F.col("hops").alias("far")), ["source", "target"])
    at = stash.put(todo.select("source", "target", "far", F.array("source").alias("path"), F.lit(1.0).alias("reach"), F.lit(0).alias("n")))
    level = near.select(F.col("start").alias("source"), F.col("id").alias("dst"), "hops")
    done = None
    for hop in range(1, depth + 1):
        ahead = at.where(F.col("far") >= hop).join(best, F.element_at("path", -1) == F.col("src")).join(level, ["source", "dst"]).where(
            (F.col("hops") == hop) & ((F.col("far") > hop) | (F.col("dst") == F.col("target"))))
        at = stash.put(ahead.select("source", "target", "far", F.concat("path", F.array("dst")).alias("path"), (F.col("reach") * F.col("confidence")).alias("reach"), F.lit(hop).alias("n")))
        hit = at.where("far = n")
        done = hit if done is None else done.unionByName(hit)
    w = Window.partitionBy("source", "target").orderBy(F.desc("confidence"), F.array_join("path", ">"))
    return done.withColumn("confidence", F.round("reach", 3)).withColumn("k", F.row_number().over(w)).where(F.col("k") <= limit).select("source", "target", "path", "confidence")
