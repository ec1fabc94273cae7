from datetime import datetime

from pyspark.sql import functions as F

from ledgerloom.operators import records

T = lambda m, d: datetime(2024, m, d)


def test_as_of_join(spark):
    left = spark.createDataFrame([("a", T(1, 5), 1), ("a", T(3, 1), 2), ("a", T(1, 1), 3), ("b", T(2, 1), 4), (None, T(2, 1), 5), ("a", None, 6), ("a", T(1, 3), 7)], "k string, t timestamp, i int")
    right = spark.createDataFrame([("a", T(1, 3), "x"), ("a", T(1, 20), "y"), ("a", T(1, 20), "w"), ("a", T(5, 1), "z"), (None, T(1, 1), "n"), ("b", None, "m")], "k string, s timestamp, v string")
    got = {r["i"]: r["v"] for r in records.as_of_join(left, right, "k", "t", "s", ["v"]).collect()}
    assert got == {1: "x", 2: "y", 3: None, 4: None, 5: None, 6: None, 7: "x"}


def test_places_and_diff(spark):
    a = spark.createDataFrame([(1, "AU-QLD-X"), (2, "AU"), (3, "AUX"), (4, "AU-QLD"), (5, None)], "i int, c string")
    b = spark.createDataFrame([("AU-QLD",)], "w string")
    assert sorted(r["i"] for r in records.related_places(a, b, "c", "w").collect()) == [1, 2, 4]
    old = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 1)], "k int, x string, y int")
    new = spark.createDataFrame([(1, "a", None), (2, "b", 2), (4, "d", 1)], "k int, x string, y int")
    assert {tuple(r) for r in records.table_diff(old, new, ["k"], ["x", "y"]).collect()} == {(1, "unchanged"), (2, "updated"), (3, "removed"), (4, "created")}


def test_identities_and_novelty(spark):
    known = spark.createDataFrame([("url", "a", "s1"), ("url", "b", "s1"), ("url", "b", "s2"), ("url", "a", "s1")], "t string, v string, o string")
    got = records.resolve_identities(spark.createDataFrame([("url", "a"), ("url", "b"), ("url", "c")], "t string, v string"), known, ["t", "v"], "o")
    assert {(r["v"], r["o"], r["owners"]) for r in got.collect()} == {("a", "s1", 1), ("b", None, 2), ("c", None, 0)}
    rows = spark.createDataFrame([("s", "x", 2, 1), ("s", "x", 1, 2), ("s", "y", 3, 3), ("t", "x", 9, 4)], "g string, c string, t int, i int")
    assert {r["i"] for r in records.first_seen(rows, ["g"], "c", "t", "i").where("novel").collect()} == {2, 3, 4}
    arr = lambda *x: F.array(*map(F.lit, x))
    assert spark.range(1).select(records.evidence_union(arr("b", "a"), F.lit(None).cast("array<string>"), arr("a"))).first()[0] == ["a", "b"]


def test_merges(spark):
    log = spark.createDataFrame([("1", "a", "b", T(1, 1), None), ("2", "c", "b", T(1, 2), T(1, 3)), ("3", "d", "e", T(1, 1), None), ("4", "f", "e", T(1, 2), None), ("5", "g", "g", T(1, 1), None)],
                                "merge_id string, survivor_id string, absorbed_id string, at timestamp, reversed_at timestamp")
    assert {tuple(r) for r in records.merges_in_force(log).collect()} == {("b", "a"), ("e", "f")}
    org = spark.createDataFrame([("a", None), ("b", "a"), ("c", None), ("d", "c")], "org_id string, merged_into_id string")
    ask = spark.createDataFrame([("a", "c"), ("a", "a"), ("a", "b"), ("a", "d"), ("a", "zz")], "survivor_id string, absorbed_id string")
    assert {(r["absorbed_id"], r["reason"]) for r in records.refused_merges(org, ask).collect()} == {("c", None), ("a", "same"), ("b", "already together"), ("d", "already merged"), ("zz", "unknown")}


def test_assignments_and_ladder(spark):
    rows = [("e", "c1", "observed", 0.4, ["2"]), ("e", "c1", "human_confirmed", 0.5, ["1", "2"]), ("e", "c2", "rejected", 0.9, []), ("e", "c2", "observed", 0.8, ["3"]), ("e", "c3", "registered", 0.3, None)]
    got = {r["c"]: (r["assignment_type"], r["confidence"]) for r in records.strengthened(spark.createDataFrame(rows, "e string, c string, assignment_type string, confidence double, evidence_ids array<string>"), ["e", "c"]).collect()}
    assert got == {"c1": ("human_confirmed", 0.9), "c2": ("rejected", 0.0), "c3": ("registered", 0.3)}
    L = lambda k, o, s, cat="directory", against=False, human=False, guess=False, t=T(1, 1): (k, o, t, s, cat, against, human, guess)
    led = [L("claimed", "1", "w", "company_website"), L("evidenced", "1", "r"), L("rep", "1", "r"), L("rep", "2", "s"), L("rep", "3", "w", "company_website"), L("contra", "1", "r"), L("contra", "2", "r", against=True),
           L("ver", "1", "r", human=True), L("ver", "2", "r", against=True), L("old", "1", "r", t=datetime(2015, 1, 1)), L("guess", "1", "w", "company_website", guess=True), L("rep", "3", "w", "company_website")]
    df = spark.createDataFrame(led, "k string, observation_id string, observed_at timestamp, source_id string, source_category string, contradicts boolean, human_verified boolean, hypothesis boolean")
    got = {r["k"]: r["status"] for r in records.claim_ladder(df, ["k"], F.to_timestamp(F.lit("2024-06-01T00:00:00Z"))).collect()}
    assert got == {"claimed": "claimed", "evidenced": "evidenced", "rep": "repeatedly_evidenced", "contra": "contradicted", "ver": "verified", "old": "historical", "guess": "uncertain"}


def test_priority_and_crawl(spark):
    df = spark.createDataFrame([(0.8, 1.0, 20, 0, True), (0.5, 0.0, 5, 3, False)], "score double, importance double, rows_affected int, conflict_count int, shared_identifier boolean")
    assert [r["priority"] for r in records.review_priority(df).collect()] == [0.79, 0.46]
    links = spark.createDataFrame([("s", "a", "b"), ("s", "b", "c"), ("s", "b", "a"), ("s", "c", "d"), ("s", "a", None)], "source_id string, url string, target string")
    seeds = spark.createDataFrame([("s", "a")], "source_id string, url string")
    assert [(r["url"], r["depth"]) for r in records.crawl_plan(links, seeds, 2, 30).orderBy("rank").collect()] == [("a", 0), ("b", 1), ("c", 2)]
    assert records.crawl_plan(links, seeds, 2, 2).count() == 2
