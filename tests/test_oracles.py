"""Every query with an SQL twin gives the same rows on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def cell(x):
    if x is None or (not isinstance(x, (list, str)) and not hasattr(x, "tolist") and pd.isna(x)) or x != x:
        return "NULL"
    if isinstance(x, bool):
        return str(x)
    if hasattr(x, "__index__") or isinstance(x, float):
        return repr(round(float(x), 6))
    return str(x)


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(cell(x) for x in r) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, sf, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
