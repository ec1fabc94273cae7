"""Every query runs on the smallest tables and equals its SQL where there is one."""

import glob
import os

import pytest

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")

from ledgerloom.plans import catalogue  # noqa: E402


def cell(v):
    if v is None or v != v if not hasattr(v, "__len__") else False:
        return "NULL"
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, db, name):
    got = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    rows = sorted(tuple(cell(r[c]) for c in columns) for r in got.collect())
    if name in catalogue.SQL:
        want = db.execute(catalogue.SQL[name])
        names = [x[0] for x in want.description]
        assert sorted(names) == columns
        assert rows == sorted(tuple(cell(dict(zip(names, r))[c]) for c in columns) for r in want.fetchall())


@pytest.mark.parametrize("name, starts", [
    ("shared_documents", "SELECT DISTINCT a.org_id FROM observation a JOIN observation b USING (document_id) WHERE a.org_id <> b.org_id"),
    ("graph_neighbourhood", "WITH l AS (SELECT org_id AS a, unnest([parent_organisation_id, merged_into_id]) AS b FROM organisation) "
                                "SELECT unnest([a, b]) FROM l WHERE trim(b) <> '' AND a <> b")])
def test_whole_queries_start_everywhere(spark, db, name, starts):
    got = {r["start"] for r in catalogue.QUERIES[name](spark, DATA).select("start").distinct().collect()}
    assert got == {x for x, in db.execute(starts).fetchall()}


def test_sql_has_queries():
    assert set(catalogue.SQL) <= set(catalogue.QUERIES)


def test_entry_and_shipping(spark):
    import __spark_entry__ as entry
    from ledgerloom.session import ship

    ship(spark)
    includes = list(spark.sparkContext._python_includes)
    ship(spark)
    assert includes == spark.sparkContext._python_includes and "ledgerloom.zip" in includes
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
