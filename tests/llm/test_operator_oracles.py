"""Every query of the operators with SQL gives the rows of that SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

from lodestone.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    want = con.execute(Q.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = Q.queries()[name](spark, SF)
    assert sorted(names) == sorted(got.columns)
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=repr) == sorted(want.fetchall(), key=repr)
