"""Every query with a SQL statement gives what DuckDB gives for it."""

import math

import duckdb
import pandas as pd
import pytest

from orrery import registry_runs

registry = registry_runs.R  # with the runs in it

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def canon(df):
    def cell(v):
        if v is None or v is pd.NaT or isinstance(v, float) and math.isnan(v):
            return "NULL"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(map(cell, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_rows(spark, sf, con, name):
    got, want = registry.QUERIES[name](spark, sf).toPandas(), con.execute(registry.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)
