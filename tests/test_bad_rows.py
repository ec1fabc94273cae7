import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.operators.bad_rows import diagnose, parse_block, parse_records, strict_fields

AT = {"name": 0, "email": 1, "phone": 2}


@pytest.mark.parametrize("raw, want", [
    ('a,b', ["a", "b"]), ('"a,b",c', ["a,b", "c"]), ('"a""b",c', ['a"b', "c"]), ('a"b,c', None), ('"a"b,c', None), ('"a,c', None),
    ('', [""]), (',', ["", ""]), ('"",""', ["", ""]), ('a,"x\ny"', ["a", "x\ny"]), (' "a",b', None)])
def test_strict_fields(raw, want):
    assert strict_fields(raw, ",") == want


@pytest.mark.parametrize("raw, want", [
    ("Acme,a@b.example,06 1234 5678", None), ("Acme,,", None), ("--,,", "missing_name"), ("Acme,a@b,", "invalid_email"), ("Acme,a b@c.example,", "invalid_email"),
    ("Acme,a@b@c.example,", "invalid_email"), ("Acme,, 0612345678 ext. 20", None), ("Acme,,0612345678 x4", None), ("Acme,,12", "invalid_phone"), ("Acme,,tel:", "invalid_phone"),
    ("Acme,,0612345678 or 0612345679", "invalid_phone"), ("Acme,a@b.example", "column_count"), ('A"c,x,', "broken_quoting"), ("É,,", None)])
def test_reasons(raw, want):
    assert diagnose(raw, ",", 3, AT)[0] == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet='ab"@., \nx0123456789é-', max_size=24), min_size=1, max_size=60), st.sampled_from([",", "|", ";"]))
def test_blocks_equal_strict_reading(records, sep):
    got = parse_block(records, sep, 3, AT)
    assert got == [(lambda r, f: (r, f))(*diagnose(x, sep, 3, AT)) for x in records]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.text(alphabet='ab"x, \né', max_size=9), min_size=3, max_size=3), min_size=1, max_size=80))
def test_good_blocks_round_trip(rows):
    rows = [["N" + r[0], "", ""] for r in rows]
    records = [",".join('"' + f.replace('"', '""') + '"' for f in r) for r in rows]
    assert parse_block(records, ",", 3, AT) == [(None, r) for r in rows]


def test_table(spark):
    runs = spark.createDataFrame([("r1", ";", "Tel;Company", json.dumps({"columns": {"phone": "Tel", "name": "Company"}}), "x"), ("r2", None, None, None, "x")],
                                 "run_id string, field_sep string, header_line string, mapping string, raw_record string")
    recs = spark.createDataFrame([("r1", 2, "0612345678;Acme", 1), ("r1", 2, "0612345678;Acme", 1), ("r1", 3, None, 1), ("r2", 2, "a", 1), ("r9", 2, "a", 1), ("r1", 4, "x" * 300_000, 1)],
                                 "run_id string, line_no int, raw_record string, reason int")
    got = {(r["run_id"], r["line_no"]): (r["reason"], r["name"]) for r in parse_records(recs, runs).collect()}
    assert got == {("r1", 2): (None, "Acme"), ("r1", 3): ("column_count", None), ("r2", 2): ("unknown_format", None), ("r9", 2): ("unknown_format", None), ("r1", 4): ("column_count", None)}
    assert parse_records(recs.limit(0), runs).count() == 0 and parse_records(recs, runs.limit(0)).where("reason <> 'unknown_format'").count() == 0


def test_few_records_are_read_strictly():
    records = [f"Name {i},n{i}@b.example,061234567{i % 10}" for i in range(2000)]
    for i in range(0, 2000, 9):
        records[i] = ("--,,", "Acme,a@b,", "Acme,,12", "Acme,x", 'A"c,x,')[i // 9 % 5]
    read: list[int] = []
    got = parse_block(records, ",", 3, AT, read)
    assert got == [diagnose(x, ",", 3, AT) for x in records]
    assert sorted(read) == [i for i in range(0, 2000, 9) if i // 9 % 5 > 2]


def test_refused_blocks_are_bisected():
    records = [f"N{i},," for i in range(300)]
    records[77], records[150] = "N\n77,,", "N\r150,,"
    read: list[int] = []
    assert parse_block(records, ",", 3, AT, read) == [diagnose(x, ",", 3, AT) for x in records] and sorted(read) == [77, 150]


def test_no_record_vanishes(spark):
    from ledgerloom.plans import catalogue

    path = "/root/testdata/sf0.001"
    if not __import__("os").path.isdir(path):
        pytest.skip("no test data")
    whole = spark.read.parquet(f"{path}/import_record.parquet").distinct().count()
    assert sum(catalogue.QUERIES[q](spark, path).count() for q in ("p6_found", "p6_loaded", "p6_unknown")) == whole
