import io
import json
import uuid
import zipfile
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import confidence as conf
from ledgerloom.functions import geography as geo
from ledgerloom.functions import text, web
from ledgerloom.operators import facts, graph, matching, targeting
from ledgerloom.session import salted_join, shared_folder
from ledgerloom.sources import datasets
from ledgerloom.streaming import jobs


def values(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def test_text_keys(spark):
    got = values(spark, text.name_key(F.lit("The Acmé & Sons Pty. Ltd.")), text.name_key(F.lit("Limited")), text.bare_host(F.lit("https://www.Acme.com.au:8080/x?y")),
                 text.email_business_domain(F.lit("a@Gmail.com")), text.email_business_domain(F.lit("a@www.acme.com")), text.phone_tail(F.lit("+61 7 3333 1111")),
                 text.phone_tail(F.lit("123")), text.identifier_key(F.lit("51 824-753.556")), text.slug(F.lit("  A b! ")), text.split_claims(F.lit("b; a|b")),
                 text.address_key(F.array(F.lit("1 High St"), F.lit(" "), F.lit("Town"))), text.address_key(F.array(F.lit("x"))), text.is_role_email(F.lit("Tenders@x.com")))
    assert got == ["the acme and sons", "limited", "acme.com.au", None, "acme.com", "33331111", None, "51824753556", "a_b", ["a", "b"], "1 high st town", None, True]
    assert values(spark, text.candidate_hosts(F.lit("Rovera Scaffolding Pty Limited")))[0][:3] == ["roverascaffolding.com.au", "roverascaffolding.net.au", "roverascaffolding.au"]
    assert values(spark, text.blocking_tokens(text.name_key(F.lit("The House of A Bb"))))[0] == ["house", "bb"]


def test_confidence(spark):
    at = F.to_timestamp(F.lit("2024-01-01T00:00:00Z"))
    got = values(spark, conf.authority(F.lit(1), F.lit("regulator"), F.lit("registration_status")), conf.authority(F.lit(7), F.lit(None).cast("string"), F.lit("phone")),
                 conf.freshness(F.lit("phone"), at, F.to_timestamp(F.lit("2024-12-31T00:00:00Z"))), conf.freshness(F.lit("project_participation"), at, F.to_timestamp(F.lit("2034-12-31T00:00:00Z"))),
                 conf.corroboration(F.lit(2)), conf.corroboration(F.lit(9)), conf.contradiction(F.lit(1), F.lit(1)), conf.contradiction(F.lit(1), F.lit(0)),
                 conf.backoff_seconds(F.lit(3)), conf.backoff_seconds(F.lit(30)), conf.retry_after_seconds(F.lit("5")), conf.retry_after_seconds(F.lit("x")))
    assert got == [1.0, 0.52, 0.5, 1.0, 1.08, 1.2, 0.7, 1.0, 20.0, 300.0, 30.0, 900.0]


@pytest.mark.parametrize("items, wanted, mode, unknown, want", [
    (["AU-QLD"], ["AU"], "overlaps", True, True), (["AU"], ["AU-QLD"], "overlaps", True, True), (["AU"], ["AU-QLD"], "within", True, False), (["AU"], ["AU-QLD"], "covers", True, True),
    (["BR"], ["LATAM"], "within", True, True), (["AU"], ["LATAM"], "overlaps", True, False), ([], ["AU"], "overlaps", False, False), ([], ["AU"], "overlaps", True, True),
    (["GLOBAL"], ["AU"], "within", True, False), (["GLOBAL"], ["AU"], "covers", True, True), (["APAC"], ["ANZ"], "covers", True, True), (["ANZ"], ["APAC"], "covers", True, False),
    (["au qld"], [], "exact", True, True), (["AUS-X"], ["AU"], "overlaps", True, False), (["ANZ"], ["ANZ"], "exact", True, True)])
def test_geography(spark, items, wanted, mode, unknown, want):
    arr = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    assert values(spark, geo.matches(arr(items), arr(wanted), mode, unknown))[0] is want


def test_geography_codes(spark):
    assert values(spark, geo.parse_jurisdiction(F.lit("au/nz, Au,")), geo.valid_code(F.lit("AU-QLD-X_1")), geo.valid_code(F.lit("Aus")), geo.ancestor_codes(F.lit("AU-VIC-MEL"))) == [
        ["AU", "NZ"], True, False, ["AU", "AU-VIC", "AU-VIC-MEL"]]
    arr = lambda *xs: F.array(*map(F.lit, xs))
    assert values(spark, geo.excluded(arr("AU-QLD"), arr("AU")), geo.excluded(arr("AU", "NZ"), arr("AU")), geo.excluded(geo.normal_codes(F.lit(None).cast("array<string>")), arr("AU"))) == [True, False, False]
    assert geo.region_problems("PACIFIC_NORTHWEST", ["US-WA", "US-OR", "CA-BC"]) == [] and len(geo.region_problems("GLOBAL", ["ANZ"])) == 2 and geo.region_problems("X1Y", [])


ORG = "org_id string, canonical_name string, legal_name string, trading_names array<string>, merged_into_id string"
IDN = "org_id string, scheme string, value string, value_normalised string, is_current boolean"
LOC = "location_id string, org_id string, address_lines array<string>, locality string, region string, postal_code string, country string"
OBS = "org_id string, predicate string, object_value string, normalisation_status string"


def scored(spark, a, b, ids=(), obs=(), locs=()):
    orgs = spark.createDataFrame([("a", a, None, [], None), ("b", b, None, None, None)], ORG)
    out = matching.duplicate_candidates(orgs, spark.createDataFrame(list(ids), IDN), spark.createDataFrame(list(locs), LOC), spark.createDataFrame(list(obs), OBS)).collect()
    return (out[0]["match_state"], out[0]["score"], out[0]["conflict_count"]) if out else None


def test_pair_scores(spark):
    idn = lambda o, v: (o, "abn", v, None, True)
    said = lambda o, p, v: (o, p, v, "raw")
    assert scored(spark, "Acme Scaffolding Pty Ltd", "ACME Scaffold Hire", [idn("a", "51824753556"), idn("b", "51 824 753 556")])[0] == "exact"
    assert scored(spark, "Acme Scaffolding", "Acme Hire Group", obs=[said("a", "website_domain", "acme.com.au"), said("b", "website_domain", "www.acme.com.au")])[:2] == ("high_confidence_probable", 0.9)
    assert scored(spark, "Acme Scaffolding Pty Ltd", "ACME Scaffolding Limited")[:2] == ("high_confidence_probable", 0.85)
    state, score, conflicts = scored(spark, "Acme Scaffolding", "Acme Scaffolding", [idn("a", "11111111111"), idn("b", "22222222222")])
    assert state == "possible_review" and conflicts == 1 and score == 0.55
    assert scored(spark, "Acme Scaffolding", "Brisbane Formwork") is None
    state, score, _ = scored(spark, "Acme Scaffolding Services", "Acme Scaffolding Solutions", obs=[said("a", "phone", "+61 7 3333 1111"), said("b", "phone", "(07) 3333 1111")])
    assert state == "possible_review" and score > 0.5


def test_large_blocks_are_stars(spark):
    orgs = spark.createDataFrame([(f"o{i:02d}", "Repeated Exact Name Pty Ltd", None, [], None) for i in range(51)], ORG)
    feats = matching.features(orgs, spark.createDataFrame([], IDN), spark.createDataFrame([], LOC), spark.createDataFrame([], OBS))
    pairs = matching.candidate_pairs(feats).collect()
    assert len(pairs) == 50 and {p["a"] for p in pairs} == {"o00"}


OBS2 = "observation_id string, org_id string, predicate string, object_value string, observed_at timestamp, source_id string, document_id bigint, extraction_confidence double, human_verified boolean, normalisation_status string"


def test_reconcile_cases(spark):
    t, as_of = datetime(2024, 1, 1, tzinfo=UTC), F.to_timestamp(F.lit("2024-01-02T00:00:00Z"))
    src = spark.createDataFrame([("web", 4, "company_website"), ("reg", 1, "government_registry"), ("dir", 7, "directory"), ("dir2", 7, "directory")], "source_id string, authority_tier int, source_category string")
    orgs = spark.createDataFrame([("a", None), ("b", "a"), ("c", None)], "org_id string, merged_into_id string")
    o = lambda i, org, p, v, s, c=0.9, h=False, n="raw": (i, org, p, v, t, s, 1, c, h, n)
    rows = [o("1", "a", "phone", "07 1", "web"), o("2", "b", "phone", "07 1 ", "reg"), o("3", "c", "registration_status", "active", "reg"), o("4", "c", "registration_status", "inactive", "dir"),
            o("5", "c", "registration_status", "Inactive", "dir2"), o("6", "c", "email", "x", "web", n="rejected"), o("7", "c", "service_claim", "x", "web"), o("1", "a", "phone", "07 1", "web")]
    got = {(r["entity_id"], r["predicate"]): r for r in facts.reconcile(spark.createDataFrame(rows, OBS2), src, facts.canonical_map(orgs), as_of).collect()}
    assert set(got) == {("a", "phone"), ("c", "registration_status")}
    assert got["a", "phone"]["independent_source_count"] == 2 and got["a", "phone"]["corroboration_score"] == 1.08
    assert got["c", "registration_status"]["value"] == "active" and got["c", "registration_status"]["status"] == "conflicted"
    rel = spark.createDataFrame([("web", "reg", "copied_from", 0.95, None), ("dir", "dir2", "copied_from", 0.1, None)], "source_id string, related_source_id string, relationship_type string, confidence double, valid_to timestamp")
    origins = facts.independent_origins(rel, as_of)
    assert {tuple(r) for r in origins.collect()} == {("web", "reg"), ("reg", "reg")}
    got = {r["predicate"]: r for r in facts.reconcile(spark.createDataFrame(rows, OBS2), src, facts.canonical_map(orgs), as_of, origins).collect()}
    assert got["phone"]["independent_source_count"] == 1 and got["phone"]["supporting_observations"] == 2


def test_graph(spark):
    rel = spark.createDataFrame([("acme", "big", "project", 0.8), ("steel", "big", "supplier_to", 0.6), ("x", "x", "self", 1.0), ("y", None, "r", 1.0)], "subject string, object string, relation string, confidence double")
    links = graph.edges(rel)
    start = spark.createDataFrame([("acme",)], "id string")
    near = lambda **k: {(r["id"], r["hops"], r["confidence"]) for r in graph.neighbourhood(start, links, **k).collect()}
    assert near(depth=1) == {("big", 1, 0.8)} and near(depth=2) == {("big", 1, 0.8), ("steel", 2, 0.48)} and near(depth=2, least=0.7) == {("big", 1, 0.8)}
    paths = graph.shortest_paths(spark.createDataFrame([("acme", "steel"), ("acme", "none")], "source string, target string"), links).collect()
    assert [(r["path"], r["confidence"]) for r in paths] == [(["acme", "big", "steel"], 0.48)]
    meet = spark.createDataFrame([("acme", "p1", 0.9), ("m", "p1", 0.7), ("n", "p1", 0.2)], "member string, event string, confidence double")
    got = graph.neighbourhood(start, links.limit(0), 1, meetings=meet).collect()
    assert {(r["id"], r["confidence"]) for r in got} == {("m", 0.7), ("n", 0.2)}


def test_targeting(spark):
    cov = spark.createDataFrame([("s1", "c1", "active", None, None), ("s1", "c2", "active", None, None), ("s2", "c3", "active", None, datetime(2020, 1, 1)), ("s3", "c4", "active", None, None)],
                                "source_id string, coverage_key string, lifecycle_status string, valid_from timestamp, valid_to timestamp")
    aims = spark.createDataFrame([("c1", "industry", "scaffolding", "include"), ("c1", "region", "AU", "include"), ("c2", "industry", "coffee", "include"), ("c2", "region", "NZ", "include"),
                                  ("c4", "region", "AU", "include"), ("c4", "region", "AU-QLD", "exclude")], "coverage_key string, dimension string, target_key string, polarity string")
    ask = lambda i, r, u=True: {x["source_id"]: x["coverages"] for x in targeting.source_matches(targeting.coverage_matches(cov, aims, {"industry": i, "region": r}, F.current_timestamp(), u)).collect() if x["matched"]}
    assert ask(["scaffolding"], ["AU-NSW"]) == {"s1": ["c1"], "s3": ["c4"]} and ask(["scaffolding"], ["NZ"], False) == {} and ask([], ["AU-QLD"]) == {"s1": ["c1"]}


HTML = """<html><head><title>T</title><base href="https://a.example/x/"><meta property="article:published_time" content="2024-05-01T00:00:00Z"></head>
<body><nav>menu</nav><h2>Team</h2><p>Call  us</p><a href="p?z=2&a=1#team">A</a><a href="/f.PDF">F</a><a href="javascript:x">J</a><a href="p?a=1&z=2">again</a>
<img src="s.png" srcset="l.png 800w, m.png 400w"><time datetime="2023-01-01T00:00:00+10:00"></time></body></html>"""


def test_web(spark):
    assert web.canonical_url_of("HTTPS://Bücher.example:443/a/?b=2&a=1#x") == "https://xn--bcher-kva.example/a?a=1&b=2"
    assert web.canonical_url_of("https://u:p@x.example") is None and web.canonical_url_of("ftp://x") is None and web.canonical_url_of(None) is None
    assert web.social_profile_of("www.facebook.com/Acme/") == ("facebook", "https://facebook.com/acme") and web.social_profile_of("https://linkedin.com/in/joe") is None
    assert web.social_profile_of("https://facebook.com/sharer/x") is None and web.social_profile_of("https://m.linkedin.com/company/Acme/about")[1] == "https://linkedin.com/company/acme"
    assert web.page_text_of(HTML) == "# T\nTeam\nCall us\nAFJagain" or "menu" not in web.page_text_of(HTML)
    assert [(k, u, h) for _, k, u, h in web.references_of("https://b.example", HTML)] == [
        ("navigation", "https://a.example/x/p?a=1&z=2", "Team"), ("document", "https://a.example/f.PDF", "Team"), ("image", "https://a.example/x/l.png", "Team")]
    assert web.published_of(HTML) == datetime(2022, 12, 31, 14, tzinfo=UTC) and web.published_of("<time datetime='2024-01-01'>") is None
    assert web.sniff_of(b"%PDF-1") == "application/pdf" and web.sniff_of(b" <html>") == "text/html" and web.sniff_of(b"a,b", None, "x.csv") == "text/csv" and web.sniff_of(b"\x00\xff") == "application/octet-stream"
    assert web.decode_bytes(b"caf\xe9") == ("café", "cp1252") and web.decode_bytes("é".encode()) == ("é", "utf-8")
    df = spark.createDataFrame([(1, "https://b.example", HTML), (2, None, None)], "k int, u string, h string")
    assert web.page_references(df, "k", "u", "h").count() == 3
    got = df.select(web.canonical_url("u"), web.social_profile(F.lit("x.com/acme")).alias("s"), web.page_text("h"), web.published_at("h")).collect()
    assert got[0]["s"]["url"] == "https://x.com/acme" and got[1][0] is None
    assert values(spark, web.emails_in(F.lit("A@b.co, a@B.co x")), web.phones_in(F.lit("call (07) 3333 1111 or +61 7 3333 1111"))) == [["a@b.co"], ["0733331111", "61733331111"]]


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿n,m\nx,1\ny\n".encode())
    (tmp_path / "b.jsonl").write_text('{"n": 1}\n\n[1]\nnope\n')
    (tmp_path / "c.json").write_text(json.dumps({"records": [{"n": {"k": 1}}]}))
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("in.csv", "n\nq\n")
        z.writestr("readme.txt", "x")
    two = io.BytesIO()
    with zipfile.ZipFile(two, "w") as z:
        z.writestr("1.csv", "n\n")
        z.writestr("2.csv", "n\n")
    (tmp_path / "e.zip").write_bytes(two.getvalue())
    (tmp_path / "f.csv").write_bytes(b"n\n\xff\n")
    got = {(r["path"][-5:], r["row_number"]): (r["record"], r["problem"]) for r in datasets.read_datasets(spark, str(tmp_path)).collect()}
    assert got["a.csv", 2][0] == {"n": "x", "m": "1"} and got["a.csv", 3][0] == {"n": "y", "m": None} and got["jsonl", 3][1] == "not an object" and got["jsonl", 4][1] == "invalid JSON"
    assert got[".json", 1][0] == {"n": '{"k": 1}'} and got["d.zip", 2][0] == {"n": "q"} and "2 datasets" in got["e.zip", 0][1] and got["f.csv", 0][1] == "not UTF-8"
    docs = spark.createDataFrame([("s", "u", bytearray(b"x")), ("s", "u", bytearray(b"x")), ("s", "v", bytearray(b"y"))], "source_id string, url string, content binary")
    store = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    assert datasets.store_content(docs, store) == 2 and datasets.store_content(docs, store) == 0
    key = spark.read.parquet(store).where("url = 'v'").first()["content_hash"]
    assert datasets.load_content(spark, store, key).count() == 1
    (tmp_path / "v.json").write_text(json.dumps([{"id": "a", "label": "A", "synonyms": ["b"]}]))
    assert datasets.load_vocabulary([str(tmp_path / "v.json")]) == {"a": ["A", "b"]}
    (tmp_path / "w.json").write_text(json.dumps([{"id": "a"}, {"label": "x"}]))
    with pytest.raises(ValueError, match="v.json|w.json"):
        datasets.load_vocabulary([str(tmp_path / "v.json"), str(tmp_path / "w.json")])


def run(spark, rows, schema, op, tmp_path, name):
    src = tmp_path / name
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(src))
    out = []
    stream = op(jobs.stream_of(spark, str(src), schema, 1))
    q = stream.writeStream.outputMode("update").foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / (name + "-c"))).trigger(availableNow=True).start()
    q.awaitTermination()
    return {r[0]: r for r in out}


def test_stateful_streams(spark, tmp_path):
    got = run(spark, [[("j1", 1, "failed"), ("j2", 1, "ok")], [("j1", 2, "failed"), ("j2", 2, "failed")], [("j1", 3, "failed"), ("j3", 1, "failed")]], "job_id string, seq int, outcome string", jobs.job_states, tmp_path, "jobs")
    assert (got["j1"]["status"], got["j1"]["attempts"]) == ("failed", 3) and got["j2"]["status"] == "succeeded" and (got["j3"]["status"], got["j3"]["next_run_after"]) == ("queued", 5.0)
    got = run(spark, [[("s", i, "unchanged")] for i in range(6)] + [[("s", 9, "collected"), ("t", 1, "failure")]], "source_id string, seq int, outcome string", jobs.cadences, tmp_path, "cad")
    assert got["s"]["interval_seconds"] == pytest.approx(7 * 86400 * 0.6) and got["t"]["failures"] == 1


def test_salted_join(spark):
    left = spark.createDataFrame([("k", i) for i in range(50)] + [("z", 1)], "k string, v int")
    right = spark.createDataFrame([("k", "x")], "k string, w string")
    assert sorted(map(tuple, salted_join(left, right, "k").collect()), key=str) == sorted(map(tuple, left.join(right, "k", "left").collect()), key=str)


def test_salted_join_beyond_the_broadcast_bound(spark, monkeypatch):
    from ledgerloom import session

    monkeypatch.setattr(session, "MAX_BROADCAST_BYTES", -1)
    left = spark.createDataFrame([("k", i, "x") for i in range(60)] + [(None, 1, "y"), ("z", 2, None)], "k string, v int, w string")
    right = spark.createDataFrame([("k", 1), ("q", 2)], "k string, r int")
    for how in ("left", "inner"):
        got = session.salted_join(left, right, "k", how=how)
        assert "Broadcast" not in got._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(str, got.collect())) == sorted(map(str, left.join(right, "k", how).select(*got.columns).collect()))
