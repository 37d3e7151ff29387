"""Every query against the SQL given for it, on the smallest data."""

import duckdb
import pandas as pd
import pytest
from conftest import SMALL

import __spark_entry__ as entry

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def comparable(df):
    def cell(v):
        if v is None or v is pd.NaT or v != v:
            return None
        return round(v, 9) if isinstance(v, float) else str(v)
    return sorted((tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SMALL).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert comparable(got) == comparable(want)


def test_queries_without_sql_run(spark):
    for name in sorted(set(entry.queries()) - set(entry.oracle_sql())):
        assert entry.queries()[name](spark, SMALL).columns


def test_entry(spark):
    assert entry.entry(spark).count() > 0
