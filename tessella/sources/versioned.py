"""Keyed tables that change in place: rows lie in buckets of their key's hash, a change rewrites the buckets it touches.

A table is a folder: ``data/<version>/_bucket=<k>`` has files of rows, ``commits/<version>`` says which folder holds each bucket. A
change writes new folders for its buckets beside the old ones and then a commit, which appears as a whole, under a number
that must not be taken yet: a reader sees one version or the next, never a part, and of two writers one fails
(``Taken``). Files of untouched buckets stay as they are. A change can have a source and a batch number; a number of that source that is there already
changes nothing, so a stream's repeated batch does no harm.

Only bucket numbers and a commit's text, bounded by the number of buckets, pass through the driver. Old folders stay for readers of
older versions until ``clean`` removes those that no recent commit names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Merge = Callable[[DataFrame, DataFrame], DataFrame]


class Taken(Exception):
    """Another writer made this version meanwhile: read again and repeat the change."""


def latest_of(key: str, order: list[str]) -> Merge:
    """Of the rows of a key, old and new, the one with the highest order stays; a new row with the same order replaces the old one."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
        best = rows.groupBy(key).agg(F.max_by(F.struct(*old.columns), F.struct(*order, "_new")).alias("_s"))
        return best.select("_s.*")

    return merge


class Keyed:
    """A table in path with the given schema; rows are found by the column key."""

    def __init__(self, spark: SparkSession, path: str, schema, key: str, buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._fs = hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._context = hadoop.FileContext.getFileContext(self._fs.getUri(), spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The last commit's number; 0 for a table without any."""
        folder = self._path(f"{self.path}/commits")
        if not self._fs.exists(folder):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return max([int(n) for n in names if n.isdigit()], default=0)

    def commit_of(self, version: int) -> dict:
        if not version:
            return {"folders": {}, "batches": {}}
        return json.loads(self.spark.read.text(f"{self.path}/commits/{version:012d}", wholetext=True).first()[0])

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The table, or those of its buckets, as of a version or the last."""
        folders = self.commit_of(self.version() if version is None else version)["folders"]
        names = [f for k, f in folders.items() if buckets is None or int(k) in buckets]
        if not names:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{f}" for f in names])

    def _bucket(self):
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def change(self, changes: DataFrame, merge: Merge, source: str | None = None, batch: int | None = None) -> list[int]:
        """Merges changes, a table that is read twice, into the buckets of their keys; the buckets that were rewritten."""
        version = self.version()
        commit = self.commit_of(version)
        if source is not None and commit["batches"].get(source, -1) >= batch:
            return []
        touched = sorted(r[0] for r in changes.select(self._bucket()).distinct().collect())
        name = f"{version + 1:012d}-{uuid.uuid4().hex}"
        if touched:
            names = [f.name for f in self.schema]
            rows = merge(self.read(version, touched), changes.select(*names)).select(*names).withColumn("_bucket", self._bucket())
            rows.repartition(min(len(touched), self.buckets), "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/data/{name}")
        kept = {k: f for k, f in commit["folders"].items() if int(k) not in touched}
        made = {str(k): f"{name}/_bucket={k}" for k in touched if self._fs.exists(self._path(f"{self.path}/data/{name}/_bucket={k}"))}
        batches = commit["batches"] | ({source: batch} if source is not None else {})
        self._commit(version + 1, {"folders": kept | made, "batches": batches})
        return touched

    def _commit(self, version: int, what: dict) -> None:
        written = self._path(f"{self.path}/commits/.{uuid.uuid4().hex}")
        stream = self._fs.create(written, False)
        stream.write(json.dumps(what).encode())
        stream.close()
        try:
            self._context.rename(written, self._path(f"{self.path}/commits/{version:012d}"), self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:  # noqa: BLE001 - the gateway wraps what the file system says
            self._fs.delete(written, False)
            raise Taken(f"version {version} of {self.path} is there already") from e

    def clean(self, keep: int = 2) -> None:
        """Removes folders of data and commits that none of the last keep versions needs."""
        last = self.version()
        recent = range(max(1, last - keep + 1), last + 1)
        needed = {f.split("/")[0] for v in recent for f in self.commit_of(v)["folders"].values()}
        for f in self._fs.listStatus(self._path(f"{self.path}/data")) if last else []:
            if f.getPath().getName() not in needed and int(f.getPath().getName().split("-")[0]) <= last:
                self._fs.delete(f.getPath(), True)
        for v in range(1, last - keep + 1):
            self._fs.delete(self._path(f"{self.path}/commits/{v:012d}"), False)
