"""Every registered query against its SQL oracle in DuckDB, at the smallest scale."""

import datetime as dt
import math
import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from rillspark.catalog import load

SF_DIR = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
LIBRARY = {name: e.sql for name, e in load().items()}
ORACLES = {name: sql for name, sql in LIBRARY.items() if sql}
pytestmark = pytest.mark.skipif(not SF_DIR.is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for file in SF_DIR.glob("*.parquet"):
        con.execute(f"create view {file.stem} as select * from '{file}'")
    return con


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, dt.date):
        return pd.Timestamp(x).isoformat()
    if hasattr(x, "item"):
        x = x.item()
    return float(x) if isinstance(x, int) and not isinstance(x, bool) else x


def rows(df):
    made = [tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)]
    return sorted(made, key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, con, name):
    got = entry.queries()[name](spark, str(SF_DIR)).toPandas()
    want = con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_only_fitted_models_lack_an_oracle():
    without = set(LIBRARY) - set(ORACLES)
    assert all(name.startswith("m") for name in without)
