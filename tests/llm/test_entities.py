import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import addresses, entity_match, groups, spelling

LST = "listing_id string, listing_name string, town string, state_name string, postcode string, phone string, registration_hint string, org_id string"
ORG = "org_id string, canonical_name string, legal_name string, trading_names array<string>, stem string"
IDN = "org_id string, value string, value_normalised string"
LOC = "location_id string, org_id string, address_lines array<string>, locality string, region string, postal_code string, box int"
OBS = "org_id string, predicate string, object_value string, normalisation_status string"


@pytest.mark.parametrize("name, want", [
    ("The Vomapplin Demolition Proj. (PTY) LTD", ("vomapplin", "demolition proj")), ("Props by Fapladim", ("fapladim", "props")), ("Miwudin t/a Miwudin Steelfixing Proj.", ("miwudin", "steelfixing proj")),
    ("Fosiwam, Water Proofing", ("fosiwam", "water proofing")), ("Kudrafal P. Hire P/L", ("kudrafal", "p hire")), ("Nusrimom Access Pty Limited", ("nusrimom", "access")),
    ("Vizâmor Shore'g and F/work PTY. LTD.", ("vizamor", "shoreg fwork")), ("A B Smith Joinery", ("absmith", "joinery")), ("By", ("by", "")), ("Ltd", ("", "")), (None, ("", "")), ("", ("", ""))])
def test_names(name, want):
    assert spelling.parse_name(name) == want


@pytest.mark.parametrize("a, b, fits", [
    ("roofing", "roofs services", True), ("p hire", "plant hre group", True), ("p hire", "propping", False), ("fwork", "form work", True), ("water proofing", "waterproofing", True),
    ("joinery", "joiners group", True), ("joinery", "plumbing", False), ("conc pumps", "concrete pumping", True), ("insul", "industrial access", False), ("roofing", "proofing", False),
    ("", "roofing", True), ("shorign", "shoring", True), ("access", "edge protection", False)])
def test_trades(a, b, fits):
    assert spelling.trades_fit(a, b) is fits and spelling.trades_fit(b, a) is fits


A = lambda **k: {**dict.fromkeys(spelling.PARTS, ""), **k}


@pytest.mark.parametrize("args, want", [
    ((["275 Braplimun Drive, NORTH BIUMUDALE South Australia 2442"], None, None, None), A(number="275", street="braplimun", type="drive", town="north biumudale", state="sa", postcode="2442")),
    ((["P.O. Box 1700"], "Keheridge", "TAS", "8073"), A(box="1700", town="keheridge", state="tas", postcode="8073")),
    ((["18/212 gegerurn cres"], "Luweford", "Queensland", None), A(unit="18", number="212", street="gegerurn", type="crescent", town="luweford", state="qld")),
    ((["unit 3 no 205 dokruzern crt", "mt. gekraby vic 8616"], None, None, None), A(unit="3", number="205", street="dokruzern", type="court", town="mount gekraby", state="vic", postcode="8616")),
    ((["Vawamix Terrace Nth No. 33B"], "Vebrucombe S.", None, None), A(number="33b", street="vawamix", type="terrace", direction="north", town="south vebrucombe")),
    ((["4685 DRUBUBOUNE", "24/207 Brigroke Av"], None, "NT", None), A(unit="24", number="207", street="brigroke", type="avenue", town="drububoune", state="nt", postcode="4685")),
    ((["Rogdern Tower", "U7, 5 Leredrald Rd."], "Dremaby", None, None), A(unit="7", number="5", street="leredrald", type="road", town="dremaby")),
    ((None, None, None, None), A()), ((["", None], "", " ", ""), A())])
def test_addresses(args, want):
    assert spelling.parse_address(*args) == want


def test_one_edit_keys(spark):
    r = random.Random(5)
    pairs = []
    for _ in range(400):
        w = "".join(r.choice("abc") for _ in range(r.randrange(3, 11)))
        i = r.randrange(len(w))
        pairs.append((w, r.choice([w[:i] + w[i + 1:], w[:i] + r.choice("abc") + w[i:], w[:i] + r.choice("abc") + w[i + 1:], w[:i] + w[i:i + 2][::-1] + w[i + 2:]])))
    df = spark.createDataFrame(pairs, "a string, b string")
    a, b = F.col("a"), F.col("b")
    assert df.where(~spelling.one_edit(a, b)).count() == 0
    assert df.where(~F.arrays_overlap(spelling.affixes(a), spelling.affixes(b)) & (F.least(F.length(a), F.length(b)) >= 3)).count() == 0
    assert df.where(~F.arrays_overlap(spelling.shortened(a), spelling.shortened(b))).count() == 0


def test_swaps_of_distant_letters_are_other_names(spark):
    df = spark.createDataFrame([("zifidrus", "fizidrus", False), ("gisewim", "sigewim", False), ("abcd", "abdc", True), ("abcd", "bacd", True), ("ab", "ba", True), ("", "", True), ("a", "b", True), ("abc", "xyz", False)], "a string, b string, w boolean")
    assert df.where(spelling.one_edit(F.col("a"), F.col("b")) != F.col("w")).count() == 0


def matched(spark, lst, org, idn=(), loc=(), obs=()):
    make = spark.createDataFrame
    rows = entity_match.match(make(list(lst), LST), make(list(org), ORG), make(list(idn), IDN), make(list(loc), LOC), make(list(obs), OBS)).collect()
    return {(r["org_id"], r["listing_id"]): (r["rule"], r["confidence"]) for r in rows}


def test_match_rules_and_decoys(spark):
    org = [("o1", "Rabrulan Temporary Works Pty Ltd", None, [], "x"), ("o2", "Rabrulan Temporary Works Ltd", None, None, "x"), ("o3", "Rabrulan Rigging", None, [], "x"),
           ("o4", "Kukesal Earthworks Ltd", None, [], "x"), ("o5", None, None, None, None), ("o6", "Nowhere Cladding", None, [], "x"), ("o1", "Rabrulan Temporary Works Pty Ltd", None, [], "x")]
    loc = [("l1", "o1", ["1 A Street"], "Tusubourne", "QLD", "9644", 1), ("l2", "o2", ["1 B Street"], "Winoford", "TAS", "6854", 1), ("l3", "o3", ["1 A Street"], "Tusubourne", "QLD", "9644", 1),
           ("l4", "o4", ["2 C Road", "Nekrifield NSW 1029"], None, None, None, 1), (None, None, None, None, None, None, None)]
    lst = [("a", "RABRULAN TEMP. WKS", "TUSUBOURNE", "QLD", "9644", None, None, "z"), ("b", "Rabbrulan Temporary Works", None, "QLD", "9644", None, "9999", "z"),
           ("c", "Kukeal t/a Kukeal Earthworks", "Nekrifeild", None, None, None, None, "z"), ("d", "Rabrulan Temporary Works", "Elsewhere", "QLD", None, None, None, "z"),
           ("e", "Nowhere Claddings", None, "NT", None, None, "ends 12345", "z"), ("f", None, None, None, None, None, None, None), ("g", "Nowhere Cladding", "Town", None, None, "(06) 1234 5678", None, "z")]
    idn = [("o6", "98 765 412 345", None), ("o1", "11111119999", "11111119999"), (None, None, None)]
    got = matched(spark, lst * 2, org, idn, loc, [("o6", "phone", "+61 6 1234 5678", "raw"), (None, "phone", None, None)])
    assert {k: v[0] for k, v in got.items()} == {
        ("o1", "a"): "name_trade_town", ("o1", "b"): "near_name_trade_town", ("o4", "c"): "near_name_trade_near_town", ("o6", "e"): "near_name_trade_hint", ("o6", "g"): "trade_phone"}
    assert all(0 < c <= 1 for _, c in got.values())


def test_match_any_trade_and_short_names(spark):
    org = [("o1", "Zifidrus Joinery Pty Ltd", None, [], "x"), ("o2", "Zifidrus Plumbing", None, [], "x"), ("o3", "Abe Roofs", None, [], "x"), ("o4", "Bea Roofs", None, [], "x")]
    loc = [(f"l{i}", f"o{i}", None, "Tusubourne", "QLD", "9644", 1) for i in (1, 2, 3, 4)]
    lst = [("a", "Zifidrus Joinery", "Tusubourne", "QLD", "9644", None, None, "z"), ("b", "Zifidruss Joinery Co", "Tusubourne", None, None, None, None, "z"), ("c", "Aeb Roofing", "Tusubourne", None, None, None, None, "z"),
           ("d", "Zifidrus", "Tusubourne", None, None, None, None, "z")]
    assert set(matched(spark, lst, org, (), loc)) == {("o1", "a"), ("o1", "b"), ("o3", "c"), ("o1", "d"), ("o2", "d")}


def test_hints(spark):
    rows = [("9123", "51824759123", True), ("ends 59123", "51824759123", True), ("…759123", "51824759123", True), ("518 247 ***", "51824759123", True), ("Q1 234 ***", "Q1234567", True),
            ("ends ***", "51824759123", False), ("", "51824759123", False), ("12", "51824759112", False), ("518 247", "51824759123", False)]
    df = spark.createDataFrame(rows, "h string, v string, w boolean")
    assert df.where(entity_match.hint_fits(F.col("h"), F.col("v")) != F.col("w")).count() == 0


def test_hint_rule_is_labelled_by_phone(spark):
    org = [(f"o{i}", f"Name{'abcdefgh'[i] * 4} Roofing", None, [], "x") for i in range(8)]
    idn = [(f"o{i}", f"1000000{i}0{i}0", None) for i in range(8)]
    lst = [(f"l{i}", f"Name{'abcdefgh'[i] * 4} Roofs", None, None, None, f"07 1234 567{i}", f"{i}0{i}0".rjust(4, "0"), "z") for i in range(8)]
    got = matched(spark, lst, org, idn, (), [(f"o{i}", "phone", "07 9999 9999", "raw") for i in range(8)])
    assert set(got) == {(f"o{i}", f"l{i}") for i in range(8)} and {c for _, c in got.values()} == {0.0}


def test_match_empty(spark):
    assert matched(spark, [], []) == {} and matched(spark, [("a", "Acme Cladding", "T", None, None, None, None, None)], []) == {}


def test_same_places(spark):
    loc = lambda i, lines, town, code=None: (i, "o", lines, town, None, code, 1)
    rows = [loc("a", ["Unit 3, 2A Fagreturn St,"], "Hugramere", "8227"), loc("b", ["3/2A FAGRETURN ST"], "Hugramree", "8227"), loc("c", ["Unit 3", "2A Fagretrun Street"], None, "8227"),
            loc("d", ["2A Fagreturn Street"], "Hugramere", "8227"), loc("e", ["3/2 Fagreturn Street"], "Hugramere", "8227"), loc("f", ["3/2A Fagreturn Road"], "Hugramere", "8227"),
            loc("g", ["3/2A Fagreturn Street"], "Rasoby", "4582"), loc("h", ["3/2A Fagreturn Street North"], "Hugramere", "8227"), loc("p", ["PO Box 12"], "Hugramere", "8227"),
            loc("q", ["p.o box 12", "hugramere qld 8227"], None), loc("r", ["PO Box 12"], "Rasoby", "4582"), loc("x", None, None), loc(None, ["1 A St"], "T"), loc("y", ["Some Tower"], "Hugramere")]
    extra = [loc(f"n{i}", [f"{i} Other Lane"], "Hugramere", "8227") for i in range(5)]
    got = {tuple(r) for r in addresses.same_places(spark.createDataFrame(rows + extra + rows[:3], LOC)).collect()}
    assert got == {("a", "b"), ("a", "c"), ("b", "c"), ("p", "q")}
    assert addresses.same_places(spark.createDataFrame([], LOC)).count() == 0


def test_short_streets_with_like_beginnings(spark):
    rows = [(x, "o", [f"7 {x} Street"], "Hugramere", None, "8227", 1) for x in ("Mary", "Mall", "Mons", "Bary", "Bank", "Bess")]
    assert [tuple(r) for r in addresses.same_places(spark.createDataFrame(rows, LOC)).collect()] == [("Bary", "Mary")]


def same(spark, rows):
    return {tuple(r) for r in addresses.same_places(spark.createDataFrame([(i, "o", lines, town, None, None, 1) for i, lines, town in rows], LOC)).collect()}


def test_missing_parts(spark):
    box, street, both = ("a", ["PO Box 12"], "Hugramere"), ("b", ["5 Smith Street"], "Hugramere"), ("c", ["PO Box 12, 5 Smith Street"], "Hugramere")
    assert same(spark, [box, street, both]) == {("a", "c"), ("b", "c")}
    assert same(spark, [box, street, both, ("d", ["PO Box 12, 7 Jones Road"], "Hugramere")]) == {("a", "c"), ("b", "c"), ("a", "d")}  # c and d contradict each other
    assert same(spark, [street, ("e", ["5 Smith Street"], None), ("f", ["5 Smiht Street"], None)]) == {("b", "e"), ("b", "f"), ("e", "f")}
    assert same(spark, [street, ("e", ["5 Smith Street"], None), ("g", ["5 Smith Street"], "Rasoby")]) == set()  # two places hold e


def test_containment(spark):
    form = lambda name, **k: (name, *[k.get(c, "") for c in addresses.FORM])
    forms = [form("full", box="9", number="5", street="smith", type="street", town="rasoby"), form("street", number="5", street="smith", type="street", town="rasoby"), form("box", box="9", town="rasoby"),
             form("no town", number="5", street="smith", type="street"), form("other box", box="8", number="5", street="smith"), form("unit", unit="3", number="5", street="smith", type="street", town="rasoby")]
    df = spark.createDataFrame(forms, "form string, " + ", ".join(f"{c} string" for c in addresses.FORM))
    got = {(r["x"]["form"], r["y"]["form"], r["kind"]) for r in addresses.containments(df, addresses.Stash(spark)).collect()}
    # 'other box' shares its street token with 'street' but holds too little of its weight; with 'full' it contradicts
    assert got == {("street", "full", "street"), ("box", "full", "box"), ("no town", "full", "street"), ("no town", "street", "street")}


def test_chains_of_errors_do_not_join_streets(spark):
    rows = [("a1", ["7 Gabolen Street"], "T"), ("a2", ["7 Gabolen Street"], "T"), ("b", ["7 Gabolem Street"], "T"), ("c1", ["7 Cabolem Street"], "T"), ("c2", ["7 Cabbolem Street"], "T")]
    assert ("a1", "b") in same(spark, rows) and ("a1", "c2") not in same(spark, rows)


def test_pairs_of_a_hot_place_and_members(spark):
    from ledgerloom.session import pairs_within

    df = spark.createDataFrame([("g", f"m{i:03d}", "x") for i in range(60)] + [("h", "m001", "y"), ("h", "m002", "y"), ("k", "m003", "z")], "place string, location_id string, other string")
    want = {("g", f"m{i:03d}", f"m{j:03d}") for i in range(60) for j in range(i + 1, 60)} | {("h", "m001", "m002")}
    for block in (7, 512):
        got = [(r["place"], r["location_id_a"], r["location_id_b"]) for r in pairs_within(df, "place", "location_id", ["other"], block).collect()]
        assert len(got) == len(want) and set(got) == want
    rows = [("a", "o", ["PO Box 12, 5 Smith Street"], "T", None, None, 1), ("b", "o", ["5 Smith St"], "T", None, None, 1), ("c", "o", None, None, None, None, 1)]
    got = {tuple(r) for r in addresses.place_members(spark.createDataFrame(rows, LOC)).collect()}
    assert got == {("a", "box", "a"), ("a", "street", "a"), ("b", "street", "a")}


CND = "candidate_id string, organisation_a_id string, organisation_b_id string, match_state string, updated_at timestamp, u string"
T = lambda d: datetime(2024, 1, d)


def test_links(spark):
    rows = [("1", "a", "b", "exact", T(1), ""), ("2", "b", "a", "Confirmed Distinct", T(2), ""), ("3", "c", "b", " EXACT", T(1), ""), ("4", "c", "d", "high confidence-probable", T(1), ""),
            ("5", "e", "e", "exact", T(1), ""), ("6", "e", None, "exact", T(1), ""), ("7", "e", " ", "exact", T(1), ""), ("8", "f", "g", None, T(1), ""), ("9", "x", "y", "unresolved", None, ""), ("A", "y", "x", "exact", None, "")]
    got = {tuple(r) for r in groups.groups(spark.createDataFrame(rows + rows[:4], CND)).collect()}
    assert got == {("b", "b"), ("c", "b"), ("d", "b"), ("x", "x"), ("y", "x")}
    assert groups.groups(spark.createDataFrame([], CND)).count() == 0


@pytest.mark.parametrize("rounds", [12, 2])
def test_group_ids_against_brute_force(spark, rounds):
    r = random.Random(rounds)
    edges = [(f"h{i:02d}", "hub") for i in range(30)] + [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(40)] + [("c40", "hub")] + [(f"v{r.randrange(60):02d}", f"v{r.randrange(60):02d}") for _ in range(40)]
    want, adj = {}, {}
    for a, b in edges:
        if a != b:
            adj.setdefault(a, set()).add(b)
            adj.setdefault(b, set()).add(a)
    for v in adj:
        seen, todo = {v}, [v]
        while todo:
            for w in adj[todo.pop()] - seen:
                seen.add(w)
                todo.append(w)
        want[v] = min(seen)
    got = groups.group_ids(spark.createDataFrame(edges, "a string, b string"), rounds)
    assert {x["id"]: x["group_id"] for x in got.collect()} == want


def test_group_ids_where_the_last_round_ends_the_component(spark):
    links = spark.createDataFrame([("h", "a"), ("h", "b"), ("h", "c"), ("c", "d"), ("x", "y")], "a string, b string")
    for rounds in (1, 2, 3):
        assert {tuple(r) for r in groups.group_ids(links, rounds).collect()} == {*((v, "a") for v in "abcdh"), ("x", "x"), ("y", "x")}


def test_mark_dominated_against_brute_force(spark):
    r = random.Random(9)
    rows = [(f"g{r.randrange(3)}", i, r.choice([None, 0.1, 0.5, 0.9]), r.choice([None, 1.0, 2.0, 3.0]), r.choice([None, 0, 1, 2])) for i in range(150)]
    low = lambda v: float("-inf") if v is None else v
    vec = {i: (g, low(x), low(y), z or 0) for g, i, x, y, z in rows}
    want = {i for i, a in vec.items() if any(a[0] == b[0] and a != b and all(p >= q for p, q in zip(b[1:], a[1:])) for b in vec.values())}
    df = spark.createDataFrame(rows, "g string, i int, x double, y double, z int")
    for salts in (1, 8):
        got = groups.mark_dominated(df, ["g"], "x", "y", "z", 3, salts)
        assert got.count() == 150 and {v["i"] for v in got.where("dominated").collect()} == want


def test_surviving_facts_and_records(spark):
    org = spark.createDataFrame([("a", None, "Acme", None, None, "AU", None, T(1), 0.5), ("b", "a", "n/a", "Acme Ltd", "company", None, None, T(3), 0.9), ("c", "b", "Acme Co", "Old", None, "NZ", None, T(2), None),
                                 ("x", "y", "X", None, None, None, None, T(1), None), ("y", "x", "Y", None, None, None, None, T(1), None), ("z", "", "Z", None, None, None, None, T(1), None)],
                                "org_id string, merged_into_id string, canonical_name string, legal_name string, organisation_type string, country_of_registration string, parent_organisation_id string, last_observed_at timestamp, entity_confidence double")
    members = groups.merge_sets(org)
    assert {tuple(sorted((r["org_id"], r["root_org_id"]))) for r in members.collect()} == {("a", "a"), ("a", "b"), ("a", "c")}
    f = lambda i, o, p, v, s="probable", a=0.5, t=T(1): (i, o, p, v, s, a, t)
    facts = [f("1", "a", "phone", "07"), f("2", "b", "phone", "08", a=0.9), f("3", "c", "phone", "09", "Disproven ", a=1.0), f("4", "c", "phone", " TBC ", a=1.0), f("5", "b", "email", "--"),
             f("6", "a", "web", "w", a=None), f("7", "b", "web", "v", a=None, t=T(2)), f("8", "c", "name", "n", t=None), f("9", "a", "name", "m", t=None), f("A", "x", "phone", "1"), f("B", "z", "phone", "1"),
             f(None, "a", "q", "1"), f("C", None, "q", "1"), f("D", "a", None, "1"), f("E", "a", "fax", "00 0000")]
    df = spark.createDataFrame(facts * 2, "assertion_id string, org_id string, predicate string, value string, status string, authority_score double, last_observed_at timestamp")
    assert {tuple(r) for r in groups.surviving_facts(df, members).collect()} == {("a", "phone", "2"), ("a", "web", "7"), ("a", "name", "8")}
    rec = groups.golden_records(org, members).collect()
    assert len(rec) == 1 and (rec[0]["survivor_id"], rec[0]["canonical_name"], rec[0]["legal_name"], rec[0]["organisation_type"]) == ("c", "Acme Co", "Old", "company") and rec[0]["country_of_registration"] == "NZ"
    assert groups.surviving_facts(df.limit(0), members).count() == 0 and groups.golden_records(org, members.limit(0)).count() == 0


def test_layers_in_one_task_equal_those_by_windows(spark):
    r = random.Random(12)
    fields = groups.GOLDEN_FIELDS
    org = [(f"o{i:03d}", *[r.choice([None, None, None, f"v{i}"]) for _ in fields], r.choice([None, T(1), T(2), T(3)]), r.choice([None, 0.2, 0.8]), f"s{r.randrange(9)}") for i in range(160)]
    org += [(f"c{i:03d}", *(["name", "legal", None, None, None] if i < 30 else [None] * 4 + ["last"]), T(max(1, 28 - i)), 0.9 - i / 100, "chain") for i in range(31)]
    schema = "org_id string, " + ", ".join(f"{f} string" for f in fields) + ", last_observed_at timestamp, entity_confidence double"
    df = spark.createDataFrame([x[:-1] for x in org] + [("o000", *[None] * 5, None, None)], schema)
    members = spark.createDataFrame([(x[0], x[-1]) for x in org], "org_id string, root_org_id string")
    whole, cut = ({x["root_org_id"]: x.asDict() for x in groups.golden_records(df, members, small=n).collect()} for n in (512, 3))
    assert whole == cut and len(whole) == 10 and whole["chain"]["parent_organisation_id"] == "last" and whole["chain"]["layers"] == 31
