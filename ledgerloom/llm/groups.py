"""Consolidating pairwise matches into groups, and the best representative of each group of duplicates."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators.components import connected_components
from ledgerloom.operators.hierarchy import hierarchy
from ledgerloom.session import Stash

#: The match states that make a pair a link.
LINK_STATES = ("exact", "high_confidence_probable")
#: Written values that say nothing.
PLACEHOLDERS = (
    "n/a", "na", "n.a.", "not available", "not provided", "not known", "none", "null", "nil", "nan", "tba", "tbc", "tbd",
    "to be confirmed", "to be advised", "unknown", "unspecified", "undefined", "pending", "see notes", "test", "xxx", "x")
#: Breadth-first rounds after which what was reached is contracted and left to the minimum propagation.
BFS_ROUNDS = 12


def current_links(candidates: DataFrame) -> DataFrame:
    """``(a, b)``, a < b, of the unordered pairs whose latest row links them.

    The latest updated_at counts (null is earliest), of equal ones the greatest candidate_id. Pairs with a null or blank
    end or with twice the same are dropped; states are compared in lower case with one underscore for blanks and dashes.
    """
    a, b = F.col("organisation_a_id"), F.col("organisation_b_id")
    state = F.regexp_replace(F.lower(F.trim("match_state")), r"[\s_\-]+", "_")
    rows = candidates.where((F.length(F.trim(a)) > 0) & (F.length(F.trim(b)) > 0) & (a != b)).select(
        F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.struct("updated_at", "candidate_id", state.alias("state")).alias("r"))
    last = rows.groupBy("a", "b").agg(F.max("r").alias("r"))
    return last.where(F.col("r.state").isin(*LINK_STATES)).select("a", "b")


def group_ids(links: DataFrame, rounds: int = BFS_ROUNDS) -> DataFrame:
    """``(id, group_id)`` of every vertex; the least id of its component.

    The component of the vertex of highest degree, which may hold most of the graph, is peeled first by breadth-first
    frontier joins: only the edges not yet reached are read again, and a round costs one join however large the component
    is. The rest, small components, is labelled by minimum propagation. If the peeled component is so long that the
    frontier is not empty after ``rounds``, its reached part is contracted to one vertex and finished by the propagation,
    so the number of rounds stays logarithmic and the result the same.
    """
    stash = Stash(links.sparkSession)
    both = stash.put(links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").distinct())
    arcs = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
    top = arcs.groupBy("u").count().orderBy(F.desc("count"), "u").limit(1).collect()  # one row
    if not top:
        return links.select(F.col("a").alias("id"), F.col("a").alias("group_id")).limit(0)
    seed = links.sparkSession.createDataFrame([(top[0]["u"],)], "id string")
    reached, frontier, rest, k = seed, seed, both, 0
    while k < rounds:
        k += 1
        ahead = rest.join(frontier.select(F.col("id").alias("u")), "u", "left_semi").select(F.col("v").alias("id")).unionByName(
            rest.join(frontier.select(F.col("id").alias("v")), "v", "left_semi").select(F.col("u").alias("id")))
        seen = Observation()
        fresh = stash.put(ahead.distinct().join(reached, "id", "left_anti").observe(seen, F.count(F.lit(1)).alias("n")))
        if not seen.get["n"]:
            frontier = None
            break
        # edges with an end in the old frontier are done with
        left = stash.put(rest.join(frontier.select(F.col("id").alias("u")), "u", "left_anti").join(
            frontier.select(F.col("id").alias("v")), "v", "left_anti"))
        if rest is not both:
            stash.drop(rest)
        reached, frontier, rest = reached.unionByName(fresh), fresh, left
    least = reached.agg(F.min("id")).first()[0]
    if frontier is None:
        others = both.join(reached.select(F.col("id").alias("u")), "u", "left_anti")
        peeled = reached.select("id", F.lit(least).alias("group_id"))
        small = connected_components(others, "u", "v", stash)
        return peeled.unionByName(small.select("id", F.col("component").alias("group_id")))
    hit = reached.withColumn("in", F.lit(True))
    short = both.join(hit.select(F.col("id").alias("u"), F.col("in").alias("iu")), "u", "left").join(
        hit.select(F.col("id").alias("v"), F.col("in").alias("iv")), "v", "left").where("iu is null or iv is null").select(
        F.when(F.col("iu"), F.lit(least)).otherwise(F.col("u")).alias("u"), F.when(F.col("iv"), F.lit(least)).otherwise(F.col("v")).alias("v"))
    parts = stash.put(connected_components(short, "u", "v", stash))
    core = parts.where(F.col("id") == F.lit(least)).select("component").first()
    inner = reached.where(F.col("id") != F.lit(least)) if core else reached  # without edges left the vertex is in no part
    inner = inner.select("id", F.lit(core[0] if core else least).alias("group_id"))
    return parts.select("id", F.col("component").alias("group_id")).unionByName(inner)


def groups(candidates: DataFrame) -> DataFrame:
    """``(org_id, group_id)`` of every organisation linked to another, directly or through others.

    Empty input, or input without links, gives an empty result; other columns are ignored.
    """
    return group_ids(current_links(candidates)).select(F.col("id").alias("org_id"), "group_id")


def usable(value: Column) -> Column:
    """Not null, blank, a sign only, or a placeholder; a number of zeros only says nothing either."""
    text = F.regexp_replace(F.lower(F.trim(value)), r"\s+", " ")
    return F.coalesce((F.length(text) > 0) & ~text.isin(*PLACEHOLDERS) & ~text.rlike(r"^[\W_]+$") & ~text.rlike(r"^[0\W_]+$"), F.lit(False))


def mark_dominated(rows: DataFrame, group: list[str], first: str, second: str, level: str, levels: int, salts: int = 32) -> DataFrame:
    """``rows`` with ``dominated``: another row of the group is as good in all three columns and better in one.

    ``first`` and ``second`` are doubles (null is least), ``level`` an int from 0 to ``levels - 1`` (null is 0); more is better.
    Rows equal in all three do not dominate each other. A skyline within each salt comes first: what is dominated there is
    dominated, and only the rest of a group, however large the group, meets in one window. No pairs are made.
    """
    low = F.lit(float("-inf"))
    base = rows.withColumns({
        "__x": F.coalesce(F.col(first).cast("double"), low), "__y": F.coalesce(F.col(second).cast("double"), low),
        "__z": F.coalesce(F.col(level).cast("int"), F.lit(0)), "__salt": F.pmod(F.xxhash64(*rows.columns), F.lit(salts))})

    def mark(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        ranked = df.withColumn("__r", F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.desc("__x"))))
        by_rank = Window.partitionBy(*keys).orderBy("__r")
        ahead, peers = by_rank.rangeBetween(Window.unboundedPreceding, -1), by_rank.rangeBetween(0, 0)
        best = [F.when(F.col("__z") >= t, F.col("__y")) for t in range(levels + 1)]
        seen = ranked.withColumns({"__a": F.array(*[F.max(b).over(ahead) for b in best]), "__p": F.array(*[F.max(b).over(peers) for b in best])})
        at = lambda a, k: F.get(F.col(a), k)
        worse = (at("__a", F.col("__z")) >= F.col("__y")) | (at("__p", F.col("__z")) > F.col("__y")) | (at("__p", F.col("__z") + 1) >= F.col("__y"))
        return seen.withColumn(name, F.coalesce(worse, F.lit(False))).drop("__r", "__a", "__p")

    local = mark(base, [*group, "__salt"], "__local")
    kept = mark(local.where("not __local").drop("__local"), group, "dominated")
    gone = local.where("__local").drop("__local").withColumn("dominated", F.lit(True))
    return kept.unionByName(gone).drop("__x", "__y", "__z", "__salt")


def merge_sets(organisations: DataFrame) -> DataFrame:
    """``(org_id, root_org_id)`` of sets of two or more whose merged_into_id chains end at one organisation."""
    walked = hierarchy(organisations.select("org_id", "merged_into_id"), "org_id", "merged_into_id", paths=False)
    members = Stash(organisations.sparkSession).put(
        walked.where("depth >= 0").select(F.col("id").alias("org_id"), F.col("root").alias("root_org_id")))
    several = members.groupBy("root_org_id").count().where("count > 1").select("root_org_id")
    return members.join(several, "root_org_id", "left_semi")


def surviving_facts(facts: DataFrame, members: DataFrame) -> DataFrame:
    """``(root_org_id, predicate, assertion_id)``: one surviving value per predicate of each set.

    The facts of a predicate are compared by usability, authority and recency; of the undominated ones the policy takes
    the usable, the highest authority (null is lowest), the latest (null is earliest), the smallest assertion_id. The usable
    fact that is best in that order is never dominated, so a set without a row has no usable fact. Facts with a null
    id or predicate, or of organisations in no set, do not count; exact repeats count once.
    """
    rows = facts.where("assertion_id is not null and predicate is not null").join(members, "org_id").select(
        "root_org_id", "predicate", "assertion_id", "authority_score",
        F.unix_micros("last_observed_at").cast("double").alias("seen"),
        (usable(F.col("value")) & ~F.coalesce(F.lower(F.trim("status")) == "disproven", F.lit(False))).cast("int").alias("usable"))
    best = mark_dominated(rows, ["root_org_id", "predicate"], "authority_score", "seen", "usable", 2).where("not dominated and usable = 1")
    low = F.lit(float("-inf"))
    policy = F.struct((-F.coalesce("authority_score", low)).alias("a"), (-F.coalesce("seen", low)).alias("b"), F.col("assertion_id"))
    return best.groupBy("root_org_id", "predicate").agg(F.min(policy).alias("p")).select("root_org_id", "predicate", "p.assertion_id")


GOLDEN_FIELDS = ("canonical_name", "legal_name", "organisation_type", "country_of_registration", "parent_organisation_id")
#: Sets of no more records are layered in one task; larger ones by windows, a round a layer.
SMALL_SET = 512


def layers_of(points: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Dominance layer, from 1, of each record of a set: ``points`` has its ranks (more is better), ``filled`` its usable fields.
    Peeled until every field that some record has is had; 0 for records of later layers."""
    layer, rest, n = np.zeros(len(points), dtype=int), np.arange(len(points)), 0
    while len(rest):
        n += 1
        p = points[rest]
        better = (p[:, None, :] >= p[None, :, :]).all(2) & (p[:, None, :] > p[None, :, :]).any(2)
        top = ~better.any(0)
        layer[rest[top]] = n
        rest = rest[~top]
        if not (filled[rest].any(0) & ~filled[layer > 0].any(0)).any():
            break
    return layer


def _layered(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """``rows`` of small sets with ``layer``, without the records of layers that are not needed. Sets are co-located whole."""
    schema = T.StructType([*rows.schema.fields, T.StructField("layer", T.IntegerType())])

    def layered(df: pd.DataFrame) -> pd.DataFrame:
        points = df[["complete", "seen", "trust"]].to_numpy(dtype=float)
        points[np.isnan(points)] = -np.inf
        filled, roots = df[list(fields)].notna().to_numpy(), df["root_org_id"].to_numpy()
        cuts = np.nonzero(roots[1:] != roots[:-1])[0] + 1
        layer = np.concatenate([layers_of(p, f) for p, f in zip(np.split(points, cuts), np.split(filled, cuts))])
        return df.assign(layer=layer.astype("int32"))[layer > 0]

    def frames(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for df in parts:
            df = df if rest is None else pd.concat([rest, df], ignore_index=True)
            last = df["root_org_id"].iloc[-1] if len(df) else None
            done, rest = df[df["root_org_id"] != last], df[df["root_org_id"] == last]
            if len(done):
                yield layered(done)
        if rest is not None and len(rest):
            yield layered(rest)

    return rows.repartition("root_org_id").sortWithinPartitions("root_org_id").mapInPandas(frames, schema)


def golden_records(organisations: DataFrame, members: DataFrame, fields: tuple[str, ...] = GOLDEN_FIELDS, small: int = SMALL_SET) -> DataFrame:
    """One record per set, ``(root_org_id, survivor_id, layers, *fields)``, built field by field.

    Records are compared by completeness (number of usable fields), recency and trust. The undominated ones are layer 1,
    those undominated without them layer 2, and so on. Each field has the value of the first record with a usable one in
    order of layer, completeness, recency, trust, then org_id; the survivor is the first record. Layers are peeled only
    for sets that still lack a field some remaining record has. Nulls are least; of rows with one id the least, as a struct of
    these columns, counts. Sets of more than ``small`` records never meet in one task: their layers are peeled by windows.
    """
    stash = Stash(organisations.sparkSession)
    columns = [*fields, "last_observed_at", "entity_confidence"]
    one = organisations.where("org_id is not null").groupBy("org_id").agg(F.min(F.struct(*columns)).alias("o")).select("org_id", "o.*")
    full = sum((F.col(f).isNotNull().cast("int") for f in fields), F.lit(0))
    rows = one.join(members, "org_id").select(
        "root_org_id", "org_id", *[F.when(usable(F.col(f)), F.col(f)).alias(f) for f in fields],
        F.unix_micros("last_observed_at").cast("double").alias("seen"), F.col("entity_confidence").alias("trust")).withColumn("complete", full)
    rows = stash.put(rows)
    large = rows.groupBy("root_org_id").count().where(F.col("count") > small).select("root_org_id")
    peeled = [_layered(rows.join(large, "root_org_id", "left_anti"), fields)]
    rest, layer = rows.join(large, "root_org_id", "left_semi"), 0
    had: DataFrame | None = None
    while rest.limit(1).count():
        layer += 1
        marked = stash.put(mark_dominated(rest, ["root_org_id"], "seen", "trust", "complete", len(fields) + 1))
        first = marked.where("not dominated").drop("dominated").withColumn("layer", F.lit(layer))
        later = marked.where("dominated").drop("dominated")
        peeled.append(first)
        has = first.groupBy("root_org_id").agg(*[F.max(F.col(f).isNotNull()).alias(f"h_{f}") for f in fields])
        had = stash.put(has if had is None else had.unionByName(has).groupBy("root_org_id").agg(*[F.max(f"h_{f}").alias(f"h_{f}") for f in fields]))  # one row per set
        could = later.groupBy("root_org_id").agg(*[F.max(F.col(f).isNotNull()).alias(f"c_{f}") for f in fields])
        lacking = could.join(had, "root_org_id").where(" or ".join(f"(c_{f} and not h_{f})" for f in fields)).select("root_org_id")
        rest = stash.put(later.join(lacking, "root_org_id", "left_semi"))
    low = F.lit(float("-inf"))
    order = F.struct("layer", (-F.col("complete")).alias("c"), (-F.coalesce("seen", low)).alias("s"), (-F.coalesce("trust", low)).alias("t"), "org_id")
    firsts = [F.min(F.when(F.col(f).isNotNull(), F.struct(order.alias("o"), F.col(f).alias("v")))).getField("v").alias(f) for f in fields]
    return reduce(DataFrame.unionByName, peeled).groupBy("root_org_id").agg(F.min_by("org_id", order).alias("survivor_id"), F.max("layer").alias("layers"), *firsts)
