"""Every registered query with oracle SQL gives the rows that DuckDB gives."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from geojobs.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{small}/{t}.parquet"):
            con.execute(f"create view {t} as select * from read_parquet('{small}/{t}.parquet')")
    return con


def rows(df: pd.DataFrame) -> list:
    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v) or v is pd.NaT or v is pd.NA:
            return ""
        if isinstance(v, (bool, str)):
            return str(v)
        try:
            return f"{float(v):.6g}"
        except (TypeError, ValueError):
            return str(v)

    df = df.reindex(sorted(df.columns), axis=1)
    return sorted([tuple(cell(v) for v in r) for r in df.itertuples(index=False)])


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, small, duck, name):
    ours = registry.QUERIES[name](spark, small).toPandas()
    theirs = duck.execute(registry.ORACLES[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, small, name):
    assert registry.QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
