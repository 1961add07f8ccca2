"""Every registered query with SQL against DuckDB on the smallest tables, and the entry."""

import duckdb
import pandas as pd
import pytest
from conftest import SF

import __spark_entry__ as entry_module
from tessella.plans.registry import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].astype(object)
    cell = lambda x: "null" if x is None or x is pd.NaT or isinstance(x, float) and x != x else str(round(x, 6)) if isinstance(x, float) else str(x)
    return sorted(tuple(map(cell, r)) for r in df.values.tolist())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    got, expected = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


def test_entry(spark):
    out = entry_module.entry(spark)
    assert out.count() > 0 and "released" in out.columns


def test_every_query_has_a_name_once():
    assert set(ORACLE_SQL) <= set(QUERIES) <= set(entry_module.queries())
