"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from convrecall.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if pd.isna(x):
        return "null"
    return f"{float(x):.6g}" if isinstance(x, (bool, int, float, np.number)) else str(x)


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(plain(x) for x in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equal(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = registry.queries()[name](spark, SF).toPandas(), db.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
