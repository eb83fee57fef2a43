"""The registered queries of the jobs against SQL on the smallest tables."""

import duckdb
import pytest

from jobs import queries

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, DIR), con.execute(queries.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(d[0] for d in want.description)
    names = [d[0] for d in want.description]
    rows = sorted((tuple(r[names.index(c)] for c in columns) for r in want.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str) == rows and rows


def test_each_call_has_a_folder_of_its_own(spark):
    files = {name: {f for _ in range(2) for f in queries.QUERIES[name](spark, DIR).inputFiles()} for name in queries.QUERIES}
    assert all(len({f.split("/ledger/")[0].split("/report/")[0] for f in found}) == 2 for found in files.values())
