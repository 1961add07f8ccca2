import glob
import os

import pytest
from pyspark.sql import functions as F

from tessella.sources.versioned import Keyed, Taken, latest_of
from tessella.streaming import progress

SCHEMA = "id long, at long, value string"


@pytest.fixture
def keyed(spark, tmp_path):
    return Keyed(spark, f"file://{tmp_path}/t", spark.createDataFrame([], SCHEMA).schema, "id", 8)


def files(keyed):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(keyed.path.removeprefix("file://") + "/data/**/*.parquet", recursive=True)}


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_changes_touch_their_buckets_only(spark, keyed):
    assert keyed.read().collect() == [] and keyed.version() == 0
    merge = latest_of("id", ["at"])
    assert keyed.change(spark.range(100).select("id", F.lit(1).cast("long").alias("at"), F.lit("a").alias("value")), merge) == list(range(8))
    before, folders = files(keyed), keyed.commit_of(1)["folders"]
    changes = spark.createDataFrame([(5, 2, "b"), (5, 3, "c"), (5, 0, "old"), (1000, 1, "new")], SCHEMA)
    touched = keyed.change(changes, merge)
    assert 1 <= len(touched) <= 2
    now = keyed.commit_of(2)["folders"]
    assert {k for k in folders if now[k] != folders[k]} <= {str(k) for k in touched} and {f: t for f, t in files(keyed).items() if f in before} == before
    want = sorted([(k, 1, "a") for k in range(100) if k != 5] + [(5, 3, "c"), (1000, 1, "new")])
    assert rows(keyed.read()) == want
    assert rows(keyed.read(1)) == [(k, 1, "a") for k in range(100)]
    keyed.change(spark.createDataFrame([(5, 1, "late")], SCHEMA), merge)
    assert rows(keyed.read()) == want
    keyed.clean(keep=1)
    assert rows(keyed.read()) == want and len(glob.glob(keyed.path.removeprefix("file://") + "/commits/0*")) == 1


def test_a_repeated_batch_changes_nothing(spark, keyed):
    count = lambda old, new: old.unionByName(new).groupBy("id").agg(F.sum("at").alias("at"), F.max("value").alias("value"))
    one = spark.createDataFrame([(1, 1, "x"), (2, 1, "x")], SCHEMA)
    assert keyed.change(one, count, "s", 0) and keyed.change(one, count, "s", 1)
    version = keyed.version()
    assert keyed.change(one, count, "s", 1) == [] == keyed.change(one, count, "s", 0) and keyed.version() == version
    assert keyed.change(one, count, "other", 0)
    assert rows(keyed.read()) == [(1, 3, "x"), (2, 3, "x")]
    assert keyed.change(one.limit(0), count, "s", 2) == [] and rows(keyed.read()) == [(1, 3, "x"), (2, 3, "x")]


def test_of_two_writers_one_fails(spark, keyed):
    one = spark.createDataFrame([(1, 1, "x")], SCHEMA)

    def slow(old, new):
        if keyed.version() == 0:
            keyed.change(one.withColumn("value", F.lit("first")), latest_of("id", []))
        return latest_of("id", [])(old, new)

    with pytest.raises(Taken):
        keyed.change(one, slow)
    assert rows(keyed.read()) == [(1, 1, "first")] and keyed.version() == 1


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    schema = "user_id long, ts long, event_id long, value double"
    events = [(i % 5, i, i, i / 2) for i in range(40)]

    def run():
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        states = progress.latest_states(stream, "user_id", "ts", "event_id", ["event_id", "value"])
        return rows(progress.run_to_table(states, "latest", "user_id", f"file://{tmp_path}/run"))

    for upto in (20, 40):
        spark.createDataFrame(events[upto - 20 : upto], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        assert run() == sorted({u: (u, e, v) for u, _, e, v in events[:upto]}.values())
