"""Parent-child links to full hierarchies: root, depth, path, descendants and loops.

Method: connected components first, then each component of bounded size is co-located and walked depth-first with
node colours; a component beyond the bound is never brought to one task but resolved by pointer doubling joins, which
give the same rows. Both ways are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.components import connected_components
from ledgerloom.session import Stash

SCHEMA = "id string, parent string, root string, depth int, path array<string>, on_loop boolean, descendants bigint"
WHITE, GREY, BLACK = 0, 1, 2
#: Path elements that a task holds at a time: paths are written out in batches, as those of a deep component together grow
#: with the square of its depth.
BATCH_ELEMENTS = 1 << 19


def clean_links(nodes: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """One row ``(id, parent)`` per node. Blank parents are null; of several parents the least counts, so that exact
    duplicates and ties give one defined result; rows with a null id are dropped as they name no node."""
    parent = F.when(F.length(F.trim(parent_col)) > 0, F.col(parent_col))
    return nodes.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(parent).alias("parent"))


def walk(ids: list[str], parents: list[str | None]) -> tuple[list[int], list[int], list[int], list[bool], list[int]]:
    """Iterative depth-first walk of whole components with node colouring; parents outside ``ids`` count as absent.

    For each node (place of its parent or -1, place of its root, depth, on a loop, descendants): the parent of a node on a
    loop counts as absent, so that ways up end."""
    at = {x: i for i, x in enumerate(ids)}
    up = [at.get(p, -1) if p is not None else -1 for p in parents]
    children: list[list[int]] = [[] for _ in ids]
    for i, p in enumerate(up):
        if p >= 0:
            children[p].append(i)
    colour = [WHITE] * len(ids)
    root, depth, loop, below = [-1] * len(ids), [0] * len(ids), [False] * len(ids), [0] * len(ids)
    for start in range(len(ids)):
        trail, i = [], start
        while i >= 0 and colour[i] == WHITE:
            colour[i] = GREY
            trail.append(i)
            i = up[i]
        if i >= 0 and colour[i] == GREY:  # back edge: the tail of the trail from i on is a loop
            ring = trail[trail.index(i):]
            least = min(ring, key=lambda k: ids[k])
            for k in ring:
                root[k], depth[k], loop[k] = least, -1, True
        for k in reversed(trail):
            colour[k] = BLACK
            if loop[k]:
                continue
            if up[k] < 0:
                root[k], depth[k] = k, 0
            else:
                root[k] = root[up[k]]
                depth[k] = -1 if depth[up[k]] < 0 else depth[up[k]] + 1
    for top in range(len(ids)):  # descendants, children before parents
        if up[top] >= 0 and not loop[top]:
            continue
        order, todo = [], [c for c in children[top] if not loop[c]]
        while todo:
            k = todo.pop()
            order.append(k)
            todo.extend(children[k])
        for k in reversed(order):
            below[up[k]] += below[k] + 1
    return [-1 if loop[i] else p for i, p in enumerate(up)], root, depth, loop, below


def _walked_rows(ids: list[str], parents: list[str | None]) -> Iterator[pd.DataFrame]:
    """The rows of ``SCHEMA`` of whole components, in batches of about ``BATCH_ELEMENTS`` path elements."""
    columns = [x.split()[0] for x in SCHEMA.split(", ")]
    up, root, depth, loop, below = walk(ids, parents)
    rows, held = [], 0
    for i in range(len(ids)):
        way, k = [], i
        while k >= 0:
            way.append(ids[k])
            k = up[k]
        rows.append((ids[i], parents[i], ids[root[i]], depth[i], way[::-1], loop[i], below[i]))
        held += len(way)
        if held >= BATCH_ELEMENTS:
            yield pd.DataFrame(rows, columns=columns)
            rows, held = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=columns)


def _walk_frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Components arrive whole and sorted by component within a partition; each is walked on its own."""
    rest: pd.DataFrame | None = None
    out = lambda df: _walked_rows(df["id"].tolist(), [None if pd.isna(p) else p for p in df["parent"]])
    for df in frames:
        df = df if rest is None else pd.concat([rest, df], ignore_index=True)
        last = df["component"].iloc[-1] if len(df) else None
        done, rest = df[df["component"] != last], df[df["component"] == last]
        if len(done):  # several whole components form a forest, walked together
            yield from out(done)
    if rest is not None and len(rest):
        yield from out(rest)


def by_doubling(links: DataFrame, stash: Stash, paths: bool = True) -> DataFrame:
    """The rows of ``walk`` by pointer doubling: each round doubles the distance looked up.

    For every node the state is the ancestor ``2^k`` links up (or the top, if nearer), the links to it, and the least
    id passed. After more rounds than the logarithm of the node count, nodes whose pointer still moves are on or below
    a loop. Paths and descendants are then built over the links of the nodes off the loops. Without ``paths`` both are left
    out, for callers that do not read them: in a long chain all paths together grow with the square of its length.
    """
    known = links.select(F.col("id").alias("p_id"))
    base = links.join(known, links.parent == known.p_id, "left").select(
        "id", "parent", F.col("p_id").alias("up"))
    now = stash.put(base.select("id", "parent", F.coalesce("up", "id").alias("jump"),
                                F.when(F.col("up").isNull(), 0).otherwise(1).cast("bigint").alias("hops"),
                                F.col("up").isNull().alias("done"), F.least("id", F.coalesce("up", "id")).alias("least")))
    n, reach = now.count(), 1
    while reach <= n and now.where("not done").limit(1).count():
        far = now.select(F.col("id").alias("j"), F.col("jump").alias("j2"), F.col("hops").alias("h2"),
                         F.col("done").alias("d2"), F.col("least").alias("l2"))
        step = now.join(far, now.jump == far.j).select(
            "id", "parent", F.when(F.col("done"), F.col("jump")).otherwise(F.col("j2")).alias("jump"),
            F.when(F.col("done"), F.col("hops")).otherwise(F.col("hops") + F.col("h2")).alias("hops"),
            (F.col("done") | F.col("d2")).alias("done"),
            F.when(F.col("done"), F.col("least")).otherwise(F.least("least", "l2")).alias("least"))
        after = stash.put(step)
        stash.drop(now)
        now, reach = after, reach * 2
    # What still moves has gone at least n links, so its pointer is on the loop, and from there a whole turn was made:
    # the least id passed by the node pointed at is the least on the loop.
    on = stash.put(now.where("not done").select(F.col("jump").alias("on_id")).distinct())
    turn = now.join(on, now.id == on.on_id).select(F.col("id").alias("on_id"), F.col("least").alias("loop_least"))
    ring = on.select(F.col("on_id").alias("ring_id"))
    whole = now.join(turn, now.jump == turn.on_id, "left").join(ring, now.id == ring.ring_id, "left").select(
        "id", "parent", F.when(F.col("done"), F.col("jump")).otherwise(F.col("loop_least")).alias("root"),
        F.when(F.col("done"), F.col("hops")).otherwise(F.lit(-1)).cast("int").alias("depth"), F.col("ring_id").isNotNull().alias("on_loop"))
    if not paths:
        return whole
    tree = base.join(ring, base.id == ring.ring_id, "left").select("id", F.when(F.col("ring_id").isNull(), F.col("up")).alias("up"))
    return whole.join(_paths_by_doubling(tree, stash), "id")


def _paths_by_doubling(tree: DataFrame, stash: Stash) -> DataFrame:
    """``(id, path, descendants)`` of a forest ``(id, up)``. After round k a node has the last ``2^k`` nodes of its path and
    the number of nodes fewer than ``2^k`` links below it, itself included; rounds grow with the logarithm of the depth."""
    now = stash.put(tree.select("id", F.col("up").alias("jump"), F.array("id").alias("path"), F.lit(1).cast("bigint").alias("held")))
    while now.where("jump is not null").limit(1).count():
        far = now.select(F.col("id").alias("j"), F.col("jump").alias("j2"), F.col("path").alias("p2"))
        under = now.where("jump is not null").groupBy(F.col("jump").alias("u")).agg(F.sum("held").alias("more"))
        moves = F.col("jump").isNotNull()
        step = now.join(far, F.coalesce(now.jump, now.id) == far.j).join(under, now.id == under.u, "left").select(
            "id", F.when(moves, F.col("j2")).alias("jump"),
            F.when(moves, F.concat("p2", "path")).otherwise(F.col("path")).alias("path"),
            (F.col("held") + F.coalesce("more", F.lit(0))).alias("held"))
        after = stash.put(step)
        stash.drop(now)
        now = after
    return now.select("id", "path", (F.col("held") - 1).alias("descendants"))


def hierarchy(nodes: DataFrame, id_col: str, parent_col: str, max_component: int = 20_000, paths: bool = True) -> DataFrame:
    """Root, depth, path from the root, loop membership and number of descendants of every node.

    ``depth`` is -1 and ``root`` the least id of the loop for nodes on or below a loop. A parent that is not a node
    counts as absent: the node is a root itself, at depth 0. Empty input gives an empty result; extra columns are
    ignored. ``max_component`` bounds what one task holds; larger components are resolved by ``by_doubling``.
    Without ``paths`` the result has no columns ``path`` and ``descendants``.
    """
    stash = Stash(nodes.sparkSession)
    links = stash.put(clean_links(nodes, id_col, parent_col))
    known = links.select(F.col("id").alias("parent"))
    inside = links.where("parent is not null").join(known, "parent", "left_semi")
    parts = stash.put(connected_components(inside, "id", "parent", stash))
    sizes = parts.groupBy("component").agg(F.count("*").alias("size"))
    large = sizes.where(F.col("size") > max_component).select("component")
    placed = links.join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    shown = lambda df: df if paths else df.drop("path", "descendants")
    if not large.limit(1).count():
        return shown(_walked(placed))
    big = placed.join(large, "component", "left_semi")
    rest = placed.join(large, "component", "left_anti")
    return shown(_walked(rest)).unionByName(by_doubling(big.select("id", "parent"), stash, paths))


def _walked(placed: DataFrame) -> DataFrame:
    return placed.repartition("component").sortWithinPartitions("component").mapInPandas(_walk_frames, SCHEMA)


def descendant_pairs(resolved: DataFrame) -> DataFrame:
    """``(ancestor, descendant, distance)`` from the paths; a node is its own descendant at distance 0. Nodes on or
    below a loop have no root and are left out."""
    return resolved.where("path is not null and depth >= 0").select(
        F.posexplode("path").alias("at", "ancestor"), F.col("id").alias("descendant"), F.size("path").alias("n")).select(
        "ancestor", "descendant", (F.col("n") - 1 - F.col("at")).alias("distance"))
