"""The queries that SQL can express, against DuckDB over the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

from rillspark.llm import queries

SF_DIR = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.mark.skipif(not SF_DIR.is_dir(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for file in SF_DIR.glob("*.parquet"):
        con.execute(f"create view {file.stem} as select * from '{file}'")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, str(SF_DIR))
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want.fetchall()))
