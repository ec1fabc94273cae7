import random

import pytest

from ledgerloom.operators import hierarchy as hierarchy_module
from ledgerloom.operators.components import connected_components
from ledgerloom.operators.hierarchy import by_doubling, descendant_pairs, hierarchy, walk
from ledgerloom.session import Stash


def brute(parent: dict) -> dict:
    out = {}
    for x in parent:
        trail, at = [x], x
        while parent.get(at) in parent and parent[at] not in trail:
            at = parent[at]
            trail.append(at)
        nxt = parent.get(at)
        out[x] = (min(trail[trail.index(nxt):]), -1) if nxt in parent else (at, len(trail) - 1)
    return out


def forest(seed: int, n: int = 120) -> dict:
    r = random.Random(seed)
    ids = [f"n{i:03d}" for i in range(n)]
    return {x: r.choice([None, "", "gone", *r.sample(ids, 3)]) for x in ids}


def as_rows(parent: dict) -> dict:
    return {k: (v if v and v.strip() else None) for k, v in parent.items()}


@pytest.mark.parametrize("bound", [1000, 3])
def test_random_forests_against_brute_force(spark, bound):
    parent = forest(bound)
    df = spark.createDataFrame([(k, v, "x") for k, v in parent.items()] * 2, "org string, up string, id string")
    got = {r["id"]: (r["root"], r["depth"]) for r in hierarchy(df, "org", "up", max_component=bound).collect()}
    assert got == brute(as_rows(parent))


def test_doubling_equals_walk(spark):
    parent = as_rows(forest(7))
    links = spark.createDataFrame(list(parent.items()), "id string, parent string")
    got = {r["id"]: (r["root"], r["depth"]) for r in by_doubling(links, Stash(spark)).collect()}
    ids = list(parent)
    _, root, depth, _, _ = walk(ids, list(parent.values()))
    assert got == brute(parent) == {x: (ids[root[i]], depth[i]) for i, x in enumerate(ids)}


def test_paths_and_descendants(spark):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "b"), ("x", "y"), ("y", "x"), ("z", "y"), (None, "a")], "id string, p string")
    rows = {r["id"]: r for r in hierarchy(df, "id", "p").collect()}
    assert rows["c"]["path"] == ["a", "b", "c"] and rows["a"]["descendants"] == 3 and rows["b"]["descendants"] == 2
    assert rows["x"]["on_loop"] and rows["y"]["root"] == "x" and not rows["z"]["on_loop"] and rows["z"]["depth"] == -1
    pairs = {(r[0], r[1], r[2]) for r in descendant_pairs(hierarchy(df, "id", "p")).collect()}
    assert ("a", "d", 2) in pairs and not any("x" in p for p in pairs)


def test_empty_and_long_chain(spark):
    assert hierarchy(spark.createDataFrame([], "id string, p string"), "id", "p").count() == 0
    chain = [(f"{i:05d}", f"{i - 1:05d}" if i else None) for i in range(700)]
    got = hierarchy(spark.createDataFrame(chain, "id string, p string"), "id", "p", max_component=100).agg({"depth": "max"}).first()[0]
    assert got == 699


def test_components_against_brute_force(spark):
    r = random.Random(3)
    edges = [(f"v{r.randrange(80):02d}", f"v{r.randrange(80):02d}") for _ in range(60)] + [(None, "v01"), ("v02", None)]
    adj = {}
    for a, b in edges:
        if a and b:
            adj.setdefault(a, set()).add(b)
            adj.setdefault(b, set()).add(a)
    want = {}
    for v in adj:
        seen, todo = {v}, [v]
        while todo:
            for w in adj[todo.pop()] - seen:
                seen.add(w)
                todo.append(w)
        want[v] = min(seen)
    got = connected_components(spark.createDataFrame(edges, "a string, b string"), "a", "b")
    assert {x["id"]: x["component"] for x in got.collect()} == want


def test_large_components_give_all_rows_of_the_walk(spark):
    parent = as_rows(forest(11)) | {f"w{i:02d}": "n000" for i in range(40)} | {f"c{i:03d}": f"c{i - 1:03d}" if i else None for i in range(70)}
    df = spark.createDataFrame(list(parent.items()), "id string, p string")
    whole, cut = hierarchy(df, "id", "p"), hierarchy(df, "id", "p", max_component=3)
    rows = lambda found: {r["id"]: r.asDict() for r in found.collect()}
    want = rows(whole)
    assert rows(cut) == want and any(x["on_loop"] for x in want.values()) and any(x["depth"] < 0 and not x["on_loop"] for x in want.values())
    pairs = lambda found: sorted(map(tuple, descendant_pairs(found).collect()))
    assert pairs(cut) == pairs(whole)
    assert rows(hierarchy(df, "id", "p", max_component=3, paths=False)) == {k: {c: v for c, v in x.items() if c not in ("path", "descendants")} for k, x in want.items()}


def test_long_chains_are_written_in_batches():
    import tracemalloc

    n = 3000
    ids = [f"{i:05d}" for i in range(n)]
    tracemalloc.start()
    seen = held = 0
    for df in hierarchy_module._walked_rows(ids, [None, *ids[:-1]]):
        sizes = df["path"].str.len()
        assert sizes.tolist() == list(range(seen + 1, seen + len(df) + 1)) and df["path"].iloc[-1] == ids[:seen + len(df)]
        assert sizes.sum() < hierarchy_module.BATCH_ELEMENTS + n
        seen, held = seen + len(df), held + int(sizes.sum())
    assert seen == n and held == n * (n + 1) // 2
    assert tracemalloc.get_traced_memory()[1] < 40 << 20  # all paths at once take 36 MB of references a million elements
    tracemalloc.stop()
