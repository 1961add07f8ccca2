"""Each query with SQL against DuckDB on the smallest tables, and that all are registered."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_module
from tessella.llm.registry import ORACLE_SQL, PARTS, PARTS_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple("null" if pd.isna(x) else str(int(x)) if isinstance(x, float) else str(x) for x in r) for r in df.values.tolist())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL | PARTS_SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert rows((QUERIES | PARTS)[name](spark, SF).toPandas()) == rows(con.sql((ORACLE_SQL | PARTS_SQL)[name]).df())


def test_registered():
    names = entry_module.queries()
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert QUERIES.keys() | {"pipeline"} <= names.keys()


SECRETS = ["", None, "token=abcdef TOKEN : 'xyzxyz' password=short", "AKIA" + "B7" * 10 + " AKIAB7", "deadbeef" * 4 + " \U0001f642\ue000 api-key api_key=abcdefg ſecret=abcdefg", "secret=secret=abcdef " + "0" * 23]
PEOPLE = ["", None, "a.b@c.de x@y 1.2.3.4 1.2.3.256 001.002.003.0255 1.2.3.4.5", "4111 1111-1111 1111 and 4111111111111112 +49 (30) 1234-567 +1 2 3", "\ue000é\U0001f642 me@b.org 4111111111111111000 +123456789012345678", "x" * 50 + "@y.z 300.1.1.1 1.1.1"]
URLS = ["https://A.example.COM/en/7?x#y", "http://example.com/en/8", "x://com/en/", "ftp://sub.net/de/8", "http://example.net/de/8#/", "example.com/en/", None, "", "http://a?/en/", "http://ORG/es/://b/"]


def test_parts_on_edges(spark, tmp_path):
    spark.createDataFrame(list(enumerate(SECRETS + PEOPLE)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name, query in PARTS.items():
        assert rows(query(spark, str(tmp_path)).toPandas()) == rows(con.sql(PARTS_SQL[name]).df()), name
