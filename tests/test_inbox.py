"""What users keep: the stream, cut in any way, against the table."""

import random

import pytest

from tessella.session import shared_path
from tessella.streaming import inbox, progress

SCHEMA = "user string, seq long, ts timestamp"


def made(spark, n: int, seed: int):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "a", "b", None]), k, 1_700_000_000 + k * 3600 + rng.randrange(7200)) for k in range(n)]
    rows += [("idle", n, 1_700_000_000), (None, None, 1_700_000_000), ("a", n + 1, None), rows[-1]]
    return spark.createDataFrame(rows, "user string, seq long, s long").selectExpr("user", "seq", "timestamp_seconds(s) AS ts")


@pytest.mark.parametrize("batches", [1, 3])
def test_stream_keeps_what_the_table_does(spark, batches):
    rows, path = made(spark, 600, batches), shared_path(spark, "notifications")
    rows.cache()
    for k in range(batches):
        part = rows.filter(f"coalesce(seq, 0) >= {200 * k} AND coalesce(seq, 0) < {200 * (k + 1) if k + 1 < batches else 10**9}")
        part.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    changed = progress.run_to_rows(inbox.changes(stream, 5, 40, "3 hours"), "inbox")
    got = sorted((str(r["user"]), r["seq"], r["s"]) for r in inbox.current(changed).selectExpr("user", "seq", "unix_seconds(ts) AS s").collect())
    # a user's clock is the newest own notification, or the watermark, three hours behind the newest of all
    data = {(str(r["user"]), r["seq"], r["s"]) for r in rows.filter("seq is not null AND ts is not null").selectExpr("user", "seq", "unix_seconds(ts) AS s").collect()}
    newest, want = max(s for _, _, s in data), []
    for user in {u for u, _, _ in data}:
        own = sorted((s, k) for u, k, s in data if u == user)
        now = max(own[-1][0], newest - 3 * 3600)
        want += [(user, k, s) for s, k in own[-40:] if s > now - 5 * 86400]
    assert got == sorted(want) and len(want) > 80 and "idle" not in {u for u, _, _ in got}
    table = {(str(r["user"]), r["seq"]) for r in inbox.retained_by_user(rows, 5, 40).collect()}
    assert table <= {(u, k) for u, k, _ in got}
    rows.unpersist()


def test_last_ones_of_equal_times(spark):
    rows = spark.sql("SELECT 'u' AS user, id AS seq, timestamp_seconds(1700000000) AS ts FROM range(10)")
    assert sorted(r["seq"] for r in inbox.retained_by_user(rows, 1, 3).collect()) == [7, 8, 9]
    assert inbox.retained_by_user(rows.limit(0)).collect() == []
