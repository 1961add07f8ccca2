"""What the operators of this subpackage share: tables, the shared folder, row keys."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.session import shared_path as fresh_path
from tessella.session import ship_package

__all__ = ["fresh_path", "ship_package"]

#: White space between words, as a Java and Python character class.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: While a table is written: its query's shuffle files go as soon as the query has ended, and tasks get rows in small batches.
WHILE_WRITTEN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


#: For tasks that get whole texts: batches of rows are bounded in bytes, however long the texts.
LONG_TEXTS = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def written(df: DataFrame, name: str, path: str | None = None, more: dict[str, str] | None = None) -> DataFrame:
    """df as a table in the shared folder, read back: cuts the lineage and survives lost executors. What the write shuffled is removed at once. more: settings for the write."""
    spark, path = df.sparkSession, path or fresh_path(df.sparkSession, name)
    settings = WHILE_WRITTEN | (more or {})
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


#: What a worker keeps from task to task, by its owner: functions that forget it.
_kept: dict[str, Callable[[], None]] = {}


def keeps(owner: str, forget: Callable[[], None]) -> None:
    """Says within a task that owner keeps something in the worker for its next tasks; forget drops it before a task of someone else."""
    _kept[owner] = forget


def releasing(run, owner: str | None = None):
    """run, a function of a task's batches, giving free memory back to the machine when the task ends: a worker outlives its tasks and keeps what it once needed.
    Before it, what others than owner keep in the worker is forgotten."""

    def wrapped(batches: Iterator) -> Iterator:
        for other in [k for k in _kept if k != owner]:
            _kept.pop(other)()
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return wrapped


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table in the shared folder, through Spark's own access to it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables of one run: ``written``, and removed by ``drop`` or, all but those kept, by ``close``."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh_path(self.spark, name)
        out = written(df, name, path)
        self.paths[id(out)] = path, out
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            if t is not None and id(t) in self.paths:
                remove(self.spark, self.paths.pop(id(t))[0])

    def close(self, *kept: DataFrame) -> None:
        for _, t in list(self.paths.values()):
            if not any(t is k for k in kept):
                self.drop(t)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


#: Rows of up to a few numbers each that may be sent whole to every executor (at most some 64 MB there).
BROADCAST_ROWS = 1_000_000


def small_or_shuffled(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, a written table of a few numbers a row, marked for broadcast if it has at most so many rows; else it is left to a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


#: Items of a list that are gone through at once; see running.
BLOCK = 512


def running(items: Column, op, kind: str = "bigint") -> Column:
    """The results of op over all leading parts of a list, such as running sums. A list that grows by one item at a time is
    copied each time, so this is done for blocks and then for the blocks' ends."""
    none = F.array().cast(f"array<{kind}>")

    def grown(values: Column) -> Column:
        return F.aggregate(values, none, lambda acc, x: F.concat(acc, F.array(F.coalesce(op(F.get(acc, F.size(acc) - 1), x), x))))

    def whole(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: grown(F.slice(v, b * BLOCK + 1, BLOCK)))
        ends = lambda parts: grown(F.transform(parts, lambda p: F.get(p, F.size(p) - 1)))
        return let(blocks, lambda parts: let(ends(parts), lambda e: F.flatten(F.transform(parts, lambda p, b: F.transform(p, lambda x: F.coalesce(op(F.get(e, b - 1), x), x))))))

    return let(items.cast(f"array<{kind}>"), lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(none))
