"""Every registered query against its SQL in DuckDB on the smallest data; those without SQL must run."""

import decimal
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from rasterlake.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{DATA}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def cell(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return "NULL"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, np.integer)):
        return f"{int(v)}.000000"
    if isinstance(v, (float, np.floating, decimal.Decimal)):
        return "NULL" if v != v else f"{float(v):.6f}".replace("-0.000000", "0.000000")
    return str(v)


def rows(df):
    df = df.reindex(sorted(df.columns), axis=1)
    return sorted(tuple(map(cell, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_as_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, DATA).toPandas(), duck.execute(catalog.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0
