import json
import struct
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import geography as geo
from ledgerloom.functions import pages, text, web
from ledgerloom.operators import imports, ledgers, matching, registry, research
from ledgerloom.streaming import jobs as streams

T = lambda d, h=0: datetime(2024, 1, d, h)
TS = "timestamp"


def rows(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


# --- research

def test_classified_within_the_vocabulary(spark):
    claims = spark.createDataFrame([("e", "service_claim", "hire", "o1", "company_website", 1), ("e", "service_claim", "hire", "o2", "government_registry", 3), ("e", "service_claim", "guess", "o3", "directory", 1),
                                    ("e", "archetype_claim", "rental", "o4", None, None), ("e", "phone", "hire", "o5", "directory", 1)],
                                   "entity_id string, predicate string, value string, observation_id string, source_category string, authority_tier int")
    words = research.vocabulary_of(json.dumps({"services": {"hire": "Hire"}, "archetypes": {"rental": "Rental"}}))
    out = research.classified(claims, spark.createDataFrame(words, "predicate string, category_id string, category_label string"))
    got = {r["category_id"]: (r["taxonomy_id"], r["assignment_type"], r["confidence"], r["evidence_ids"]) for r in out.collect()}
    assert got == {"hire": ("service_taxonomy", "self_described", 0.756, ["o1", "o2"]), "rental": ("company_archetypes", "observed", 0.34, ["o4"])}
    assert research.active(out.withColumn("assignment_type", F.lit("rejected")), out).count() == 0 and research.active(out.withColumn("assignment_type", F.lit("rejected")), out, True).count() == 2


def test_sizes(spark):
    df = spark.createDataFrame([("big", "200+", 0.9, 2, 0, 3, 0), ("two", "20-49", 0.5, 1, 1, 2, 0), ("large two", "200+", 0.5, 0, 0, 2, 0), ("odd", "many", 0.5, 0, 0, 0, 1), ("bare", None, None, 0, 0, 0, 0)],
                               "entity_id string, band string, band_confidence double, units int, subsidiaries int, shown int, claimed int")
    got = {(r["entity_id"], r["concept"]): (r["band"], r["confidence"]) for r in research.sizes(df).collect()}
    assert got["big", "capability_tier"] == ("A", 0.7) and got["two", "capability_tier"] == ("B", 0.6) and got["large two", "capability_tier"] == ("C", 0.55) and got["odd", "capability_tier"] == ("D", 0.4)
    assert got["bare", "capability_tier"] == ("unresolved", 0.0) and got["odd", "legal_entity_size"] == ("unresolved", 0.0) and got["two", "operating_group_size"] == ("multi-site", 0.6)


def test_questions(spark):
    there = spark.createDataFrame([("e", True, False, None, True, True)], "entity_id string, identifier boolean, domain boolean, location boolean, contact boolean, capability boolean")
    facts = spark.createDataFrame([("e", "phone", "conflicted"), ("e", "email", "stale"), ("e", "phone", "conflicted"), ("e", "web", "probable")], "entity_id string, predicate string, status string")
    caps = spark.createDataFrame([("e", "hire", "contradicted"), ("e", "sale", "claimed")], "entity_id string, capability_id string, status string")
    needed = research.needed_questions(there, facts, caps)
    assert rows(needed, "question_type", "priority") == {("missing_domain", 0.7), ("missing_location", 0.6), ("conflicted_fact:phone", 0.8), ("stale_fact:email", 0.55), ("contradicted_capability:hire", 0.75)}
    asked = spark.createDataFrame([("e", "missing_domain", "system"), ("e", "missing_contact", "system"), ("e", "missing_identifier", "user")], "entity_id string, question_type string, generated_by string")
    change = {r["question_type"]: r["change"] for r in research.question_changes(asked, needed).collect()}
    assert (change["missing_domain"], change["missing_contact"], change["missing_identifier"], change["stale_fact:email"]) == ("kept", "resolved", "kept", "asked")
    open_ = spark.createDataFrame([("1", "open"), ("2", "resolved"), ("3", "open")], "question_id string, status string")
    votes = spark.createDataFrame([("1", "resolved", 1), ("1", "dismissed", 2), ("2", "dismissed", 9), ("9", "resolved", 1)], "question_id string, status string, at int")
    assert rows(research.decided_questions(open_, votes), "question_id", "status") == {("1", "dismissed"), ("2", "resolved"), ("3", "open")}


def test_completion_and_plan(spark):
    names = ", ".join(f"{n} boolean" for n in research.NEEDS)
    df = spark.createDataFrame([("e", *[True] * 6), ("f", True, None, False, True, True, True), ("e2", *[True] * 6)], f"entity_id string, {names}")
    got = {r["entity_id"]: r for r in research.completion(df).collect()}
    assert got["e"]["complete"] and got["f"]["score"] == 0.667 and got["f"]["missing"] == ["official_domain", "specific_location"] and len({r["signature"] for r in got.values()}) == 3
    plan = spark.createDataFrame([("e", "Acme", ["51"], "Brisbane", "QLD", ["business_description"]), ("f", "Bare", None, None, None, [])], "entity_id string, name string, identifiers array<string>, locality string, region string, missing array<string>")
    got = {r["entity_id"]: r["queries"] for r in research.research_queries(plan).collect()}
    assert got == {"e": ['"Acme" official website', '"Acme" "51"', '"Acme" Brisbane QLD', '"Acme" services capabilities projects'], "f": ['"Bare" official website']}


def test_matches_decided_and_evidence(spark):
    c = spark.createDataFrame([("1", "possible_review"), ("2", "possible_review"), ("3", "exact")], "candidate_id string, state string")
    d = spark.createDataFrame([("1", "distinct", 1), ("1", "merge", 2), ("3", "related", 1), ("2", "nonsense", 1)], "candidate_id string, decision string, at int")
    assert rows(research.decided_matches(c, d), "candidate_id", "state", "merges") == {("1", "exact", True), ("2", "possible_review", False), ("3", "related_but_distinct", False)}
    ev = spark.createDataFrame([("e", "fact", ["d1", "d2", "gone"]), ("e", "fact", ["d1"])], "entity_id string, kind string, evidence_ids array<string>")
    assert rows(research.evidence_documents(ev, spark.createDataFrame([("d1",), ("d2",)], "document_id string")), "document_id", "uses") == {("d1", 2), ("d2", 1)}
    df = spark.createDataFrame([(0.4, []), (0.6, []), (0.6, ["x"]), (1.2, ["x"]), (-0.1, None), (0.5, None)], "c double, e array<string>")
    assert [r[0] for r in df.select(research.bounded_confidence(F.col("c"), F.col("e"))).collect()] == [0.4, None, 0.6, None, None, 0.5]


# --- registry

def test_hosts_gates_and_schedule(spark):
    df = spark.createDataFrame([("acme.com", "acme.com", True), ("www.acme.com", "acme.com", True), ("badacme.com", "acme.com", False), (None, "acme.com", False)], "h string, r string, w boolean")
    assert df.where(registry.domain_matches(F.col("h"), F.col("r")) != F.col("w")).count() == 0
    gate = spark.createDataFrame([("a", "prohibited", "disallowed", "fetch", True), ("b", "approved", None, "fetch", True), ("c", "approved", "disallowed", "manual", True), ("d", "approved", "disallowed", "fetch", False)],
                                 "id string, t string, r string, m string, e boolean")
    got = {r["id"]: r["b"] for r in gate.select("id", registry.activation_blockers(*[F.col(c) for c in "trme"]).alias("b")).collect()}
    assert got == {"a": ["terms prohibit access", "robots disallow access"], "b": ["robots not verified"], "c": [], "d": []}
    src = spark.createDataFrame([("s1", "z", 2, "active", "fetch", None, None), ("s2", "a", 1, "degraded", "fetch", T(1), None), ("s3", "b", 1, "active", "fetch", T(9), None), ("s4", "c", 1, "active", "manual", None, None),
                                 ("s5", "d", 1, "active", "fetch", None, T(9)), ("s6", "e", 1, "disabled", "fetch", None, None)],
                                "source_id string, name string, authority_tier int, lifecycle_status string, access_method string, next_collect_at timestamp, retry_after_until timestamp")
    assert [r["source_id"] for r in registry.due(src, F.lit(T(5)), 9).collect()] == ["s2", "s1"]
    seen = spark.createDataFrame([("d", 1, "x"), ("d", 2, "x"), ("d", 3, "y"), ("e", 1, "y")], "batch string, ordinal int, host string")
    assert rows(registry.delays(seen), "batch", "ordinal", "delay") == {("d", 1, 0.0), ("d", 2, 4.0), ("d", 3, 2.0), ("e", 1, 0.0)}
    again = registry.reinstated(spark.createDataFrame([("a", "deprecated", 9), ("b", "active", 1)], "source_id string, lifecycle_status string, failures int"), spark.createDataFrame([("a",), ("b",)], "source_id string"))
    assert rows(again, "source_id", "lifecycle_status", "failures") == {("a", "candidate", 0), ("b", "active", 1)}
    scopes = spark.createDataFrame([("x", True), ("y", False)], "scope_id string, active boolean")
    assert rows(registry.activated(scopes, "y"), "scope_id", "active") == {("x", False), ("y", True)} and rows(registry.activated(scopes, "q"), "scope_id", "active") == {("x", True), ("y", False)}


def test_outcomes_and_identities(spark):
    f = spark.createDataFrame([("1", "s", "u", T(1), True, [], 200, "h"), ("2", "s", "u", T(2), True, [], 200, "h"), ("3", "s", "v", T(1), True, [], 200, "old"), ("4", "s", "w", T(1), True, [], 304, None), ("5", "s", "w", T(1), True, [], 429, None),
                               ("6", "s", "w", T(1), True, [], None, None), ("7", "s", "w", T(1), False, [], 200, "z"), ("8", "s", "w", T(1), True, ["terms"], 200, "z2")],
                              "fetch_id string, source_id string, url string, at timestamp, active boolean, blockers array<string>, status int, content_hash string")
    known = spark.createDataFrame([("s", "v", "old")], "source_id string, url string, content_hash string")
    got = {r["fetch_id"]: r["outcome"] for r in registry.collection_outcomes(f, known).collect()}
    assert got == {"1": "collected", "2": "duplicate", "3": "duplicate", "4": "unchanged", "5": "throttled", "6": "failure", "7": "skipped", "8": "blocked"}
    known = spark.createDataFrame([("url", "a", "s1", True)], "kind string, value string, source_id string, is_primary boolean")
    want = spark.createDataFrame([("url", "a", "s1"), ("url", "a", "s2"), ("url", "b", "s2"), ("key", "c", "s2"), ("key", "d", "s1")], "kind string, value string, source_id string")
    got = {(r["value"], r["source_id"]): (r["outcome"], r["is_primary"]) for r in registry.attached(known, want).collect()}
    assert got == {("a", "s1"): ("conflict", False), ("a", "s2"): ("conflict", False), ("b", "s2"): ("attached", False), ("c", "s2"): ("attached", True), ("d", "s1"): ("attached", False)}


def test_targets_and_filters(spark):
    t = spark.createDataFrame([("c", "Geography", "au-qld", "include", None), ("c", "region", "AU-QLD", "exclude", None), ("c", "Service Line", "Scaffold-Hire", "include", None), ("c", "service_line", "x", "include", "within"),
                               ("c", "region", "Nowhere!", "include", None), ("c", "region", "NZ", "include", "exact"), ("c", "region", "nz", "include", None), ("c", "9", "x", "include", None)],
                              "coverage_key string, dimension string, target_key string, polarity string, match_mode string")
    got = {(r["dimension"], r["target_key"]): (r["match_mode"], r["problem"]) for r in registry.normal_targets(t, ["coverage_key"]).collect()}
    assert got == {("region", "AU-QLD"): ("hierarchical", "included and excluded"), ("service_line", "scaffold_hire"): ("exact", None), ("service_line", "x"): ("within", "invalid mode"), ("region", "Nowhere!"): ("hierarchical", "invalid target"),
                   ("region", "NZ"): ("exact", "conflicting modes"), ("9", "x"): ("exact", "invalid dimension")}
    assert registry.query_filters(["Scaffolding "], ["au qld"], {"geo": {"exclude": ["AU-NT"]}, "service": "Hire"}) == {
        "industry": {"include": ("scaffolding",), "exclude": ()}, "region": {"include": ("AU_QLD",), "exclude": ("AU-NT",)}, "service": {"include": ("hire",), "exclude": ()}}
    p = spark.createDataFrame([(["AU-TAS"], False), (["AU-TAS", "AU-NSW"], True), (["NZ"], False), ([], False)], "c array<string>, w boolean")
    assert p.where(registry.in_scope(F.col("c"), ["AU"], ["AU-TAS"], False) != F.col("w")).count() == 0
    packs = spark.createDataFrame([("p", "1", "h", 1), ("p", "2", "h", 2), ("q", "1", "x", 1), ("q", "2", "y", 2)], "pack_id string, version string, content_hash string, at int")
    assert rows(registry.pack_versions(packs), "pack_id", "version", "changed") == {("p", "2", False), ("q", "2", True)}


# --- geography

def test_regions_and_row_codes(spark):
    df = spark.createDataFrame([("ZA-WC", "AFRICA", True), ("BR", "LATAM", True), ("AU", "LATAM", False), ("FR", "EUROPE", True), ("AE", "MIDDLE_EAST", True)], "c string, r string, w boolean")
    assert df.where(geo.covers(F.col("r"), F.col("c")) != F.col("w")).count() == 0
    df = spark.createDataFrame([("au", "New South Wales", "AU-NSW"), ("AU", "qld", "AU-QLD"), ("AU", "Atlantis", None), ("AU", None, "AU"), ("US", "WA", "US-WA"), ("Australia", "NSW", None), (None, "NSW", None), ("NZ", "WGN", "NZ-WGN")], "c string, r string, w string")
    assert df.where(~geo.row_code(F.col("c"), F.col("r")).eqNullSafe(F.col("w"))).count() == 0
    assert df.limit(1).select(geo.described(F.lit("AU"), {"AU": "Australia"}), geo.described(F.lit("X"), {})).first()[:] == ("Australia", "X")


# --- ledgers

def test_relationship_log(spark):
    canon = spark.createDataFrame([("a", "a"), ("b", "b"), ("a2", "a"), ("c", "c")], "org_id string, root_id string")
    r = spark.createDataFrame([("a2", "b", " Supplies ", 0.4, None, T(1)), ("a", "b", "supplies", 0.9, ["e1"], T(2)), ("a", "a2", "supplies", 0.4, None, T(1)), ("a", "zz", "x", 0.4, None, T(1)), ("a", "c", "x", 0.9, None, T(1)), ("a", "c", " ", 0.1, None, T(1))],
                              "subject string, object string, relation string, confidence double, evidence_ids array<string>, at timestamp")
    assert [x["problem"] for x in sorted(ledgers.relationship_requests(r, canon).collect(), key=lambda x: (x["subject"], x["object"], x["at"], x["relation"]))] == [
        "same organisation", None, "blank relation", "confidence without evidence", "unknown organisation", None]
    edges = ledgers.open_edges(r, canon)
    assert rows(edges.withColumn("e", F.array_join("evidence_ids", ",")), "subject", "object", "confidence", "e", "valid_from") == {("a", "b", 0.9, "e1", T(1))}
    ends = spark.createDataFrame([("a", "b", "supplies", "retracted", datetime(2023, 1, 1)), ("a", "b", "supplies", "historical", T(5)), ("a", "b", "supplies", "retracted", T(6))], "subject string, object string, relation string, status string, at timestamp")
    assert rows(ledgers.closed_edges(edges, ends, ["subject", "object", "relation"]), "status", "valid_to") == {("historical", T(5))}


def test_participations_and_status(spark):
    r = spark.createDataFrame([("p", "o", "Owner", "confirmed", 0.9, None, 1), ("p", "o", "owner ", "unconfirmed", 0.3, None, 2), ("p", "o", "owner", "probable", 0.8, ["e"], 3), ("p", "o", "owner", "confirmed", 0.7, None, 4), ("p", "o", "owner", "retracted", 0.7, ["x"], 5)],
                              "project_id string, org_id string, role string, status string, confidence double, evidence_ids array<string>, at int")
    assert rows(ledgers.participations(r), "role", "status", "confidence", "last_observed_at") == {("owner", "confirmed", 0.8, 4)}
    now = spark.createDataFrame([("x", "probable"), ("y", "retracted")], "id string, status string")
    ch = spark.createDataFrame([("x", "unconfirmed", 1), ("x", "confirmed", 2), ("x", "probable", 3), ("x", "historical", 4), ("x", "confirmed", 5), ("y", "confirmed", 1)], "id string, status string, at int")
    assert rows(ledgers.status_changes(now, ch, ["id"]), "id", "at", "accepted") == {("x", 1, False), ("x", 2, True), ("x", 3, False), ("x", 4, True), ("x", 5, False), ("y", 1, False)}
    p = spark.createDataFrame([("1", " ", "odd", -1.0, None, T(2), T(1)), ("2", "Bridge", "awarded", 5.0, "AUD", T(1), T(2))], "project_id string, name string, status string, value double, currency string, start timestamp, end timestamp")
    assert {r["project_id"]: len(r["problems"]) for r in ledgers.project_problems(p).collect()} == {"1": 5, "2": 0}


def test_jobs(spark):
    j = spark.createDataFrame([("1", "a", '{"u":1}', 2, T(1), T(1), "queued", 0, 3, None, False), ("2", "a", '{"u":2}', 1, T(2), T(1), "queued", 0, 3, None, False), ("3", "a", '{"u":3}', 0, T(9), T(1), "queued", 0, 3, None, False),
                               ("4", "b", None, 0, T(1), T(1), "running", 1, 3, T(1), False), ("5", "b", None, 0, T(1), T(1), "running", 3, 3, T(1), False), ("6", "b", None, 0, T(1), T(1), "running", 1, 3, T(3), False)],
                              "job_id string, job_type string, payload string, priority int, run_at timestamp, created_at timestamp, status string, attempts int, max_attempts int, heartbeat_at timestamp, cancel_requested boolean")
    at = F.lit(T(3))
    assert [(r["job_id"], r["attempts"]) for r in ledgers.claims(j, at, 2).collect()] == [("2", 1), ("1", 1)]
    got = {r["job_id"]: (r["status"], r["run_at"]) for r in ledgers.reaped(j, at).collect()}
    assert got["4"] == ("queued", datetime(2024, 1, 3, 0, 0, 5)) and got["5"][0] == "failed" and got["6"][0] == "running"
    beat = ledgers.beaten(j, spark.createDataFrame([("4", T(3)), ("1", T(3))], "job_id string, at timestamp"))
    assert {r["job_id"]: r["status"] for r in ledgers.reaped(beat, at).collect()}["4"] == "running" and beat.where("job_id = '1' and heartbeat_at is not null").count() == 0
    assert rows(ledgers.cancelled(j, j.where("job_id in ('1', '4')")), "job_id", "status", "cancel_requested") >= {("1", "cancelled", False), ("4", "running", True)}
    assert rows(ledgers.ended(j, spark.createDataFrame([("4", "succeeded", T(2)), ("1", "succeeded", T(2))], "job_id string, outcome string, at timestamp")), "job_id", "status") >= {("4", "succeeded"), ("1", "queued")}
    want = spark.createDataFrame([("a", '{"u":1}'), ("a", '{"u":7}'), ("a", '{"u":7}')], "job_type string, payload string")
    assert [r["payload"] for r in ledgers.enqueued(j, want, "$.u").collect()] == ['{"u":7}']
    h = ledgers.Handlers()
    h.register("demo")(len)
    with pytest.raises(ValueError):
        h.register("demo")(len)
    assert h.get("demo") is len and h.get("x") is None and h.types() == ["demo"]


def test_outcomes_of_several_frames_stay_in_order():
    import pandas as pd

    parts = [pd.DataFrame({"seq": [3, 5], "outcome": ["c", "e"]}), pd.DataFrame({"seq": [4, 1], "outcome": ["d", "a"]})]
    assert streams.in_order(iter(parts)) == ["a", "c", "d", "e"] and streams.in_order(iter([])) == []


# --- imports

def test_bulk_import(spark):
    mapping = json.dumps({"columns": {"name": "EntityName", "identifier": "ABN", "region": "State", "postcode": "Postcode", "locality": "Town", "employees_band": "Employees", "domain": "Web"}, "constants": {"identifier_scheme": "abn", "country": "AU"}})
    assert imports.mapping_problems(mapping) == [] and imports.mapping_problems('{"columns": {"colour": "c", "service_claim": "s"}}') == ["unknown field colour", "name is not bound to a column", "claims need a pack"] and imports.mapping_problems("x") == ["no mapping"]
    runs = spark.createDataFrame([("r", ",", "EntityName,ABN,State,Postcode,Town,Employees,Web", mapping, T(1)), ("r2", ",", "EntityName,ABN,State,Postcode,Town,Employees,Web", mapping, T(2))], "run_id string, field_sep string, header_line string, mapping string, created_at timestamp")
    data = [["Acme Scaffolding Pty Ltd", "51 824 753 556", "QLD", "4000", "Brisbane", "20-49", "acme.com.au"], ["Brisbane Formwork", "98 765 432 109", "QLD", "4101", "South Brisbane", "lots", ""], ["", "11 111 111 111", "QLD", "4000", "Brisbane", "", ""],
            ["Sydney Scaffold Co", "22 222 222 222", "New South Wales", "2000", "Sydney", "1-4", "no host"]]
    parsed = spark.createDataFrame([("r", i + 2, "missing_name" if not f[0] else None, f) for i, f in enumerate(data)], "run_id string, line_no int, reason string, fields array<string>")
    full = imports.with_fields(parsed, runs, ["name", "legal_name", "identifier", "registration_status", "domain", "street_address", "locality", "region", "postcode", "country", "email", "phone", "employees_band"])
    assert full.where("f_country = 'AU'").count() == 4
    known = spark.createDataFrame([("r", 2, "org-acme")], "run_id string, line_no int, org_id string")
    place = geo.row_code(F.col("f_country"), F.col("f_region"))
    out = imports.import_outcomes(full, known, imports.scope_outcome(place, F.lit(None).cast("string"), {}, ["AU-QLD"], [], [], {}, False))
    assert rows(out, "line_no", "outcome") == {(2, "matched"), (3, "imported"), (4, "rejected"), (5, "out_of_scope")} and [r["org_id"] for r in out.where("line_no = 2").collect()] == ["org-acme"]
    said = {(r["line_no"], r["predicate"]): (r["value"], r["normalisation_status"], r["confidence"]) for r in imports.import_statements(out).collect()}
    assert said[2, "registration_identifier"] == ("51 824 753 556", "normalised", 0.9) and said[3, "employee_count_band"] == ("lots", "rejected", 0.0) and (3, "website_domain") not in said and not any(k[0] > 3 for k in said)
    report = imports.import_report(out).first()
    assert (report["rows"], report["imported"], report["matched"], report["out_of_scope"], report["rejected"]) == (4, 1, 1, 1, 1) and [tuple(s) for s in report["samples"]] == [(4, "missing_name")]
    recs = spark.createDataFrame([("r", 2, "a"), ("r", 3, "b"), ("r2", 3, "b"), ("r2", 2, "a"), ("r2", 2, "a")], "run_id string, line_no int, raw_record string")
    assert rows(imports.repeated_runs(runs, recs, "v1"), "run_id", "first_run_id") == {("r2", "r")} and imports.repeated_runs(runs, recs.where("line_no = 2 or run_id = 'r'"), "v1").count() == 0


def test_scope_facets_and_dates(spark):
    df = spark.createDataFrame([("AU-QLD", "Scaffolding", ["Hire"], True), ("AU-VIC", "scaffolding", ["hire"], False), (None, "scaffolding", ["hire"], True), ("AU-QLD", "roofing", ["hire"], False), ("AU-QLD", None, [], True), ("AU-QLD", "scaffolding", ["sale"], False),
                                ("AU-QLD", "scaffolding", ["hire", "demo"], False)], "p string, k string, s array<string>, w boolean")
    scope = imports.scope_outcome(F.col("p"), F.col("k"), {"service": F.col("s")}, ["AU"], ["AU-VIC"], ["scaffolding"], {"service": {"include": ["HIRE"], "exclude": ["demo"]}}, True)
    assert df.where(scope != F.col("w")).count() == 0
    d = spark.createDataFrame([("2026-07-18", "2026-07-18 00:00:00"), ("2026-07-18T10:00:00+10:00", "2026-07-18 00:00:00"), ("2026-07-18 10:00", "2026-07-18 10:00:00"), ("18 July", None), (None, None)], "v string, w string")
    assert d.where(~F.date_format(imports.coverage_time(F.col("v")), "yyyy-MM-dd HH:mm:ss").eqNullSafe(F.col("w"))).count() == 0


# --- pages

PAGE = """Acme ABN: 51 824 753 556, ACN 123 456 789 and ABN 12 34. Visit 12 Smith Street, Brisbane QLD 4000 or 12 SMITH STREET, Brisbane, QLD 4000; 7/9 Old Mill Rd, South Yarra VIC 3141.
Our design team and OUR DESIGN TEAM offer in-house scaffold design."""


def test_page_signals(spark):
    r = spark.createDataFrame([(PAGE,)], "t string").select(pages.identifiers_in(F.col("t")).alias("i"), pages.addresses_in(F.col("t")).alias("a"), pages.in_house_phrases(F.col("t")).alias("p")).first()
    assert [tuple(x) for x in r["i"]] == [("abn", "51824753556"), ("acn", "123456789")]
    assert [tuple(x) for x in r["a"]] == [("12 Smith Street", "Brisbane", "QLD", "4000"), ("7/9 Old Mill Rd", "South Yarra", "VIC", "3141")]
    assert r["p"] == ["Our design team", "in-house scaffold design"]
    assert spark.createDataFrame([(None,)], "t string").select(pages.identifiers_in(F.col("t")), pages.split_urls(F.lit("a | b\nA|a")), pages.distillable(F.col("t")), pages.distillable(F.lit("application/rss+xml"))).first()[1:] == (["a", "b", "A"], False, True)
    assert pages.legal_name_in("Site of ACME  Scaffolding Pty. Ltd and Acme Scaffolding, Pty Ltd!", "Acme Scaffolding Limited") == "Acme Scaffolding, Pty Ltd" and pages.legal_name_in("Acme Roofing Ltd", "Acme") is None and pages.legal_name_in(None, "x") is None
    assert pages.published_time("2024-01-02T10:00:00+10:00").hour == 0 and pages.published_time("Tue, 02 Jan 2024 10:00:00 GMT").hour == 10 and pages.published_time("2024-01-02") is None and pages.published_time("soon") is None


def test_page_metadata(spark):
    html = '<meta name="description" content="short"><meta property="og:description" content="A company that puts up scaffolds in Brisbane."><a href="/x#a">One</a><a href="/x">Two</a><a href="mailto:a@b">M</a><form></form><p>Request a quote</p><script>var a="contact"</script>'
    text_, form, links = pages.page_metadata_of(html, "https://a.example/home")
    assert text_ == "A company that puts up scaffolds in Brisbane." and form == "https://a.example/home" and links == [("https://a.example/x", "One")]
    assert pages.page_metadata_of(None, None) == (None, None, []) and pages.page_metadata_of("<form></form>", "https://a.example/x")[1] is None
    r = spark.createDataFrame([(html, "https://a.example/home")], "h string, u string").select(pages.page_metadata("h", "u").alias("m")).first()["m"]
    assert r["links"][0]["label"] == "One"
    links = spark.createDataFrame([("p", 1, "https://a/blog", "Blog"), ("p", 2, "https://a/our-team", "About us"), ("p", 3, "https://a/contact", "Contact"), ("p", 4, "https://a/contact", "again")], "page_id string, ordinal int, url string, label string")
    lacks = spark.createDataFrame([("p", "public_contact_route"), ("p", "business_description")], "page_id string, need string")
    assert [(r["url"], r["rank"]) for r in pages.ranked_subpages(links, lacks).orderBy("rank").collect()] == [("https://a/our-team", 1), ("https://a/contact", 2)]


@pytest.mark.parametrize("value, expected, want", [
    ("https://www.facebook.com/Acme/", None, ("facebook", "https://facebook.com/acme")), ("fb.com/profile.php?id=12&x=1", None, ("facebook", "https://facebook.com/profile.php?id=12")), ("@acme", "tiktok", ("tiktok", "https://tiktok.com/@acme")),
    ("acme", "linkedin", ("linkedin", "https://linkedin.com/company/acme")), ("https://linkedin.com/in/joe", None, None), ("https://twitter.com/Acme", None, ("x", "https://x.com/acme")), ("https://www.reddit.com/r/Scaffolding/top", None, ("reddit", "https://reddit.com/r/scaffolding")),
    ("reddit.com/user/joe", None, None), ("https://youtube.com/channel/UCabC", None, ("youtube", "https://youtube.com/channel/UCabC")), ("https://youtube.com/watch?v=1", None, None), ("https://instagram.com/explore", None, None), ("https://tiktok.com/acme", None, None),
    ("https://facebook.com/acme", "x", None), ("https://user:pw@x.com/acme", None, None), ("https://example.com/acme", None, None), ("acme", None, None), ("", None, None), (None, None, None)])
def test_social_profiles(value, expected, want):
    assert web.social_profile_of(value, expected) == want


def test_references_and_images(spark):
    ref = spark.createDataFrame([("s", "u1", "nav", "a.com", 1, 1), ("s", "u1", "nav", "a.com", 1, 2), ("s", "u2", "nav", "www.a.com", 3, 3), ("s", "u3", "nav", "b.com", 1, 4), ("s", "k1", "nav", "a.com", 1, 5), ("s", "k2", "nav", "b.com", 1, 6), ("s", "u5", "nav", "b.com", 1, 7)],
                                "source_id string, url string, kind string, host string, depth int, ordinal int").withColumn("allowed_hosts", F.array(F.lit("a.com"))).withColumn("found_on", F.lit("page"))
    known = spark.createDataFrame([("s", "k1"), ("t", "k2")], "source_id string, url string")
    got = {r["ordinal"]: r["decision"] for r in pages.reference_decisions(ref, known, external=True).collect()}
    assert got == {1: "queued", 2: "known", 3: "depth_limit", 4: "source_proposed", 5: "known", 6: "known_external", 7: "source_proposed"}
    assert rows(pages.proposed_sources(pages.reference_decisions(ref, known, external=True)), "host", "url", "rank") == {("b.com", "u3", 1)}
    child = pages.child_documents(ref.withColumn("child_id", F.lit(None).cast("string")), spark.createDataFrame([("s", "u1", "d2"), ("s", "u1", "d1")], "source_id string, url string, document_id string"))
    assert rows(child.where("child_id is not null"), "url", "child_id") == {("u1", "d1")}
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 30, 20)
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0" + struct.pack(">HBHH", 8, 8, 20, 30)
    assert pages.image_of(png) == ("succeeded", "png", 30, 20) and pages.image_of(jpeg) == ("succeeded", "jpeg", 30, 20) and pages.image_of(b"GIF89a\x1e\0\x14\0")[1:] == ("gif", 30, 20)
    assert pages.image_of(png, 100)[0] == "quarantined" and pages.image_of(png[:18])[0] == "corrupt" and pages.image_of(None)[0] == "unsupported"


def test_names_beyond_latin(spark):
    df = spark.createDataFrame([("ﬁne Ｗｉｄｅ Ltd", "fine wide"), ("Ǆ ½", "dz 12"), ("Acmé™ Co", "acmetm co"), ("日本", ""), (None, None)], "n string, w string")
    assert df.where(~text.name_key(F.col("n")).eqNullSafe(F.col("w"))).count() == 0


def test_social_profiles_match(spark):
    org = spark.createDataFrame([("a", "Acme Access", None, [], None), ("b", "Unrelated Trading Name", None, [], None)], "org_id string, canonical_name string, legal_name string, trading_names array<string>, merged_into_id string")
    idn = spark.createDataFrame([], "org_id string, scheme string, value string, value_normalised string, is_current boolean")
    loc = spark.createDataFrame([], "location_id string, org_id string, address_lines array<string>, locality string, region string, postal_code string, country string")
    obs = spark.createDataFrame([("a", "social_profile", "https://www.facebook.com/acme", "raw"), ("b", "social_profile", "facebook.com/Acme/", "raw")], "org_id string, predicate string, object_value string, normalisation_status string")
    got = matching.duplicate_candidates(org, idn, loc, obs).collect()
    assert [(r["a"], r["b"], r["score"], r["match_state"]) for r in got] == [("a", "b", 0.75, "possible_review")]


# --- artefacts

def test_artefacts_and_audit(spark, tmp_path):
    from ledgerloom.sources import artefacts, datasets

    folder = f"file://{tmp_path}/a"
    mk = lambda *r: spark.createDataFrame(list(r), "content_hash string, text string")
    artefacts.write_artefacts(mk(("aa1", "old"), ("bb1", "x" * 50)), folder, "text/1", {"b": 1, "a": 2})
    artefacts.write_artefacts(mk(("aa1", "new")), folder, "text/1", {"a": 2, "b": 1})
    artefacts.write_artefacts(mk(("aa1", "other")), folder, "text/2")
    got = artefacts.read_artefacts(spark, folder, "text/1", {"a": 2, "b": 1}, most=10)
    assert rows(got, "content_hash", "text", "too_large") == {("aa1", "new", False), ("bb1", None, True)}
    assert rows(artefacts.read_artefacts(spark, folder, "text/2", hashes=["aa1", "zz"]), "text") == {("other",)}
    assert rows(artefacts.stored(mk(("aa1", ""), ("q", "")), mk(("aa1", ""))), "content_hash", "exists") == {("aa1", True), ("q", False)}
    docs = spark.createDataFrame([("h1", "text/html", "<title>T</title><nav>x</nav><p>a  b</p>"), ("h1", "text/html", "<title>T</title><nav>x</nav><p>a  b</p>"), ("h2", "text/plain", " a \n b "), ("h3", "image/png", "z")], "content_hash string, content_type string, body string")
    assert rows(artefacts.distilled(docs), "content_hash", "text") == {("h1", "# T\na b"), ("h2", "a b")}
    known = spark.createDataFrame([("d1", "v", artefacts.config_hash({}))], "document_id string, pipeline_version string, config_hash string")
    assert rows(artefacts.new_runs(spark.createDataFrame([("d1",), ("d2",)], "document_id string"), known, "v", {}), "document_id") == {("d2",)}
    files = spark.createDataFrame([("s", "b.txt", bytearray(b"x")), ("s", "a.txt", bytearray(b"x")), ("s", "c.txt", bytearray(b"y"))], "source_id string, filename string, content binary")
    had = files.where("filename = 'c.txt'").select("source_id", F.sha2("content", 256).alias("content_hash"))
    assert rows(artefacts.manual_evidence(files, had), "filename") == {("a.txt",)}
    m = spark.createDataFrame([({" k ": " v ", "": "x", "e": " ", "z": "long" * 9},)], "m map<string,string>").select(artefacts.safe_metadata(F.col("m"), 9, 8).alias("m")).first()["m"]
    assert m == {"k": "v", "z": "longlong"}
    (tmp_path / "packs/b").mkdir(parents=True)
    (tmp_path / "packs/b/manifest.json").write_text("{}")
    (tmp_path / "packs/c").mkdir()
    assert [p.name for p in artefacts.packs_under(f"{tmp_path}/packs")] == ["b"] and artefacts.packs_under("/nowhere") == [] and len(artefacts.pack_hash(tmp_path / "packs/b")) == 64
    log = spark.createDataFrame([(T(1), "u", "made", "job", "1", {"n": "1"})], "at timestamp, actor string, action string, subject_type string, subject_id string, detail map<string,string>")
    artefacts.record_audit(log, f"file://{tmp_path}/log")
    artefacts.record_audit(log, f"file://{tmp_path}/log")
    assert spark.read.parquet(f"file://{tmp_path}/log").count() == 2
    new = spark.createDataFrame([("s", "u", bytearray(b"x")), ("s", "u", bytearray(b"x")), ("s", "v", bytearray(b"x"))], "source_id string, url string, content binary")
    assert datasets.store_content(new, f"file://{tmp_path}/raw") == 2 and datasets.store_content(new, f"file://{tmp_path}/raw") == 0


# --- verification and search

def test_websites_are_verified(spark):
    from ledgerloom.operators import verification as v

    org = spark.createDataFrame([("o", "Acme Scaffolding Pty Ltd", ["Acme Scaffolding Pty Ltd"], ["51 824 753 556"], ["Brisbane", "Q", None]), ("p", "Bare", None, None, None)], "org_id string, name string, names array<string>, identifiers array<string>, places array<string>")
    page = spark.createDataFrame([("o", "a.com", "acme scaffolding of Brisbane, ABN 51824753556"), ("o", "b.com", "Acme  Scaffolding Pty Ltd. mail x@b.com"), ("o", "c.com", "Acme-Scaffolding everywhere x@c.com"), ("o", "d.com", None), ("p", "e.com", "nothing")], "org_id string, host string, text string")
    out = v.verified(page, org)
    got = {r["host"]: (r["score"], r["accepted"]) for r in out.collect()}
    assert got == {"a.com": (1.0, True), "b.com": (0.9, True), "c.com": (0.7, False), "d.com": (0.0, False), "e.com": (0.0, False)}
    tries = spark.createDataFrame([("o", "c.com", 1), ("o", "b.com", 2), ("o", "a.com", 3)], "org_id string, host string, rank int")
    assert rows(v.discovered(tries, out), "org_id", "host") == {("o", "b.com")}


def test_searches_and_lists(spark):
    from ledgerloom.operators import verification as v

    org = spark.createDataFrame([("1", "Acme", None, None), ("2", "Beta", "ACME Beta", None), ("3", "Gone acme", None, "1"), ("4", "Delta", None, " ")], "org_id string, canonical_name string, legal_name string, merged_into_id string")
    ids = spark.createDataFrame([("4", "ac-me 1")], "org_id string, value string")
    dom = spark.createDataFrame([("2", "acme.com"), (None, None)], "org_id string, domain string")
    assert [r["org_id"] for r in v.entity_search(org, ids, dom, "acme").collect()] == ["1", "2", "4"] and v.entity_search(org, ids, dom, "acme", merged=True).count() == 4 and v.entity_search(org, ids, dom, "acme", most=1).count() == 1
    o = spark.createDataFrame([("1", "phone", T(2), "b"), ("1", "phone", T(1), "a"), ("1", "email", T(1), "c"), ("9", "phone", T(1), "d")], "org_id string, predicate string, observed_at timestamp, observation_id string")
    assert [r["observation_id"] for r in v.observations_for(o, org, "phone").collect()] == ["a", "b"]
    assert rows(v.newest_of_each(o, "predicate", "observed_at", "observation_id", 1), "predicate", "observation_id") == {("phone", "b"), ("email", "c")} and v.newest(o, "observed_at", "observation_id", 1).first()["observation_id"] == "b"
    assert v.collection_scope_problems(None) == [] and v.collection_scope_problems({"Token": 1, "endpoint_url": "https://u:p@x.com", "allowed_origins": ["https://x.com/", "https://x.com/path", "ftp://x"]}) == [
        "secret token", "endpoint", "origin https://x.com/path", "origin ftp://x"] and v.collection_scope_problems({"allowed_origins": ["https://x.com"] * 21}) == ["origins"]
    steps = spark.createDataFrame([("a", 1, "done"), ("b", 2, "todo"), ("c", 3, "attention")], "step string, place int, state string")
    assert v.next_step(steps).first()["step"] == "c" and rows(v.state_counts(steps, {"done": F.col("state") == "done", "none": F.lit(None).cast("boolean")}), "step", "n") == {("done", 1), ("none", 0)}
