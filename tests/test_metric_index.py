import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import metric_index
from tessella.operators.metric_index import NoIndex

SCHEMA = "vec_id long, embedding array<float>"


def vectors(spark, rows, first=0):
    return spark.createDataFrame([(first + k, [float(x) for x in r]) for k, r in enumerate(rows)], SCHEMA)


def clustered(n, seed):
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(0).normal(size=(12, 4)) * 20
    out = np.round(centres[rng.integers(0, 12, n)] + rng.normal(size=(n, 4)), 2).astype(np.float32)
    out[n // 2 : n // 2 + n // 3] = out[0]  # a third of all are copies
    return out


def plain(queries, rows, k):
    out = []
    for q, x in enumerate(queries):
        d = ((rows.astype(float) - x.astype(float)) ** 2).sum(1)
        out += [(q, int(v), r + 1, round(float(d[v]), 6)) for r, v in enumerate(np.lexsort((np.arange(len(d)), d))[:k])]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("query_id", "vec_id", "rank", F.round("dist2", 6)).collect())


def test_same_as_all_distances(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(metric_index, "BLOCK", 50)  # parts of several blocks
    rows, queries = clustered(600, 1), clustered(80, 2)
    metric_index.build(vectors(spark, rows), f"{tmp_path}/index", 4, 16)
    asked = vectors(spark, queries).withColumnRenamed("vec_id", "query_id")
    assert found(metric_index.search(asked, f"{tmp_path}/index", 4, 7)) == plain(queries, rows, 7)
    few = metric_index.parts_read(asked, f"{tmp_path}/index", 4, 1).agg(F.avg("parts"), F.max("of")).first()
    assert few[0] < few[1] / 2


def test_fewer_rows_than_asked_for(spark, tmp_path):
    rows = clustered(3, 3)
    metric_index.build(vectors(spark, rows), f"{tmp_path}/index", 4)
    asked = vectors(spark, rows).withColumnRenamed("vec_id", "query_id")
    assert found(metric_index.search(asked, f"{tmp_path}/index", 4, 5)) == plain(rows, rows, 5)
    assert metric_index.search(asked.limit(0), f"{tmp_path}/index", 4).collect() == []


def test_missing_empty_and_other_dimensions(spark, tmp_path):
    rows = clustered(30, 4)
    asked = vectors(spark, rows).withColumnRenamed("vec_id", "query_id")
    with pytest.raises(NoIndex):
        metric_index.search(asked, f"{tmp_path}/none", 4)
    assert metric_index.search(asked, f"{tmp_path}/none", 4, missing="empty").collect() == []
    metric_index.build(vectors(spark, rows), f"{tmp_path}/index", 4)
    with pytest.raises(NoIndex):
        metric_index.search(asked, f"{tmp_path}/index", 5)
    with pytest.raises(Exception, match="hasn't 4 numbers"):
        metric_index.search(vectors(spark, [[1.0, 2.0]]).withColumnRenamed("vec_id", "query_id"), f"{tmp_path}/index", 4).collect()
    metric_index.build(vectors(spark, rows).limit(0), f"{tmp_path}/empty", 4)
    with pytest.raises(NoIndex):
        metric_index.search(asked, f"{tmp_path}/empty", 4)
