"""Every query of the subpackage runs on the smallest tables and equals its SQL where there is one."""

import glob
import os

import pytest

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")

from ledgerloom.llm import queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    got = queries.QUERIES[name](spark, DATA)
    columns, rows = sorted(got.columns), got.collect()
    assert len(set(map(str, rows))) == len(rows)
    if name in queries.SQL:
        con = duckdb.connect()
        for p in glob.glob(f"{DATA}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
        want = con.execute(queries.SQL[name])
        names = [x[0] for x in want.description]
        assert sorted(names) == columns
        assert sorted(str([r[c] for c in columns]) for r in rows) == sorted(str([dict(zip(names, r))[c] for c in columns]) for r in want.fetchall())
