import random
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.history import HistoryStore, StaleManifest, chains, fold_identifier, fold_value, snapshot_statements
from ledgerloom.session import shared_folder

SCHEMA = "entity_id string, attribute string, value string, folded string, start timestamp, observed_at timestamp, tie string"
T0 = datetime(2024, 1, 1)


def made(seed: int, n: int = 400):
    r = random.Random(seed)
    out = []
    for i in range(n):
        v = r.choice(["a", "A", "b", None])
        out.append((r.choice(["hot"] * 8 + ["e1", "e2"]), r.choice(["x", "y"]), v, v.lower() if v else None, T0 + timedelta(hours=r.randrange(300)), T0 + timedelta(hours=r.randrange(900)), f"t{i}"))
    return out


def brute(rows):
    by = {}
    for e, a, v, f, s, o, t in rows:
        k = by.setdefault((e, a), {})
        if s not in k or (o, t) > k[s][:2]:
            k[s] = (o, t, f)
    out = set()
    for (e, a), starts in by.items():
        n, last, open_ = 0, object(), []
        for s in sorted(starts):
            if starts[s][2] != last:
                n, last = n + 1, starts[s][2]
                open_.append((e, a, n, s))
        ends = [x[3] for x in open_[1:]] + [None]
        out |= {(*x, end) for x, end in zip(open_, ends)}
    return out


def rows_of(df):
    return {(r["entity_id"], r["attribute"], r["version_no"], r["valid_from"], r["valid_to"]) for r in df.collect()}


def test_chains_and_sliced_chains_equal_brute_force(spark):
    rows = made(1)
    df = spark.createDataFrame(rows + rows[:20], SCHEMA)
    assert rows_of(chains(df)) == brute(rows) == rows_of(chains(df, hot=10, slices=7))


def test_store_rebuilds_only_touched_chains(spark):
    rows = made(2)
    store = HistoryStore(spark, f"{shared_folder(spark)}/t-{uuid.uuid4().hex}", buckets=4)
    for k in range(0, 400, 150):
        store.append(spark.createDataFrame(rows[k:k + 150], SCHEMA))
        assert rows_of(store.history()) == brute(rows[:k + 150])
    store.append(spark.createDataFrame([], SCHEMA))
    assert rows_of(store.history()) == brute(rows) and store.raw().count() == 400


def test_store_begun_empty(spark):
    store = HistoryStore(spark, f"{shared_folder(spark)}/t-{uuid.uuid4().hex}", buckets=2)
    store.append(spark.createDataFrame([], SCHEMA))
    assert store.history().count() == 0
    store.append(spark.createDataFrame([(None, "x", "a", "a", T0, T0, "t"), ("e", "x", "a", "a", None, T0, "t"), ("e", "x", "a", "a", T0, None, None)], SCHEMA))
    assert rows_of(store.history()) == {("e", "x", 1, T0, None)}


def test_folding_and_snapshots(spark):
    df = spark.createDataFrame([("50 to 199", "50–199"), (" Active ", "active"), ("200+", " 200+")], "a string, b string")
    assert df.where(fold_value(F.col("a")).eqNullSafe(fold_value(F.col("b")))).count() == 3
    assert df.select(fold_identifier(F.lit("51-824 753.556"))).first()[0] == "51824753556"
    snaps = spark.createDataFrame([("e", T0, "x", 1), ("e", T0 + timedelta(1), "X ", 2)], "id string, at timestamp, name string, n int")
    got = rows_of(chains(snapshot_statements(snaps, "id", "at", ["name", "n"])))
    assert {(x[1], x[2]) for x in got} == {("name", 1), ("n", 1), ("n", 2)}


def fresh_store(spark, **k):
    return HistoryStore(spark, f"{shared_folder(spark)}/t-{uuid.uuid4().hex}", **k)


def test_frames_read_before_an_update_and_vacuum(spark):
    rows = made(3)
    store = fresh_store(spark, buckets=3)
    store.append(spark.createDataFrame(rows[:200], SCHEMA))
    before = store.history()
    store.append(spark.createDataFrame(rows[200:], SCHEMA))
    store.compact()
    assert rows_of(before) == brute(rows[:200]) and rows_of(store.history()) == brute(rows)
    store.vacuum()
    assert rows_of(store.history()) == brute(rows) and store.raw().count() == 400


def test_of_two_writers_one_is_refused(spark):
    rows = made(4)
    store = fresh_store(spark)
    store.append(spark.createDataFrame(rows[:200], SCHEMA))
    stale = store._manifest()
    store.append(spark.createDataFrame(rows[200:300], SCHEMA))
    with pytest.raises(StaleManifest):
        store._switch({**stale, "version": stale["version"] + 1})
    store.append(spark.createDataFrame(rows[300:], SCHEMA))
    assert rows_of(store.history()) == brute(rows)


def test_an_update_writes_what_it_touches_and_deltas_are_folded(spark):
    rows = [(f"e{i}", "x", str(i), str(i), T0 + timedelta(hours=k), T0, f"t{i}.{k}") for i in range(500) for k in range(2)]
    store = fresh_store(spark, bucket_rows=100, max_deltas=2)
    store.append(spark.createDataFrame(rows, SCHEMA))
    assert store._manifest()["buckets"] == 10
    late = [(f"e{i}", "x", "new", "new", T0 + timedelta(minutes=30), T0, f"l{i}") for i in range(5)]
    store.append(spark.createDataFrame(late, SCHEMA))
    delta = store._manifest()["deltas"][0]
    assert spark.read.parquet(delta["chains"]).count() == 15 and rows_of(store.history()) == brute(rows + late)
    for i in (7, 8):
        late.append((f"e{i}", "x", None, None, T0, T0 + timedelta(1), "z"))
        store.append(spark.createDataFrame(late[-1:], SCHEMA))
    assert store._manifest()["deltas"] == [] and rows_of(store.history()) == brute(rows + late)
