"""Pages of a sorted table without sorting it for each: ranges on disk, and a directory of how many rows each holds.

``build`` sorts the table once, dealt out over tasks by ranges of the order, and writes each row with its range and its
place there. ``PageIndex.page`` looks up which ranges a page falls into, by their counts, and reads these folders
alone, and in them the row groups that have the places. So the last page costs what the first one does. The directory has a row for each
range, and only that passes through the driver.

The order must be total, or else equal rows may change places between two builds (never between two pages of one). A page
beyond the last one is empty, as is every page of an empty table; pages are 1-based.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

_SHIFT = 33  # of the task's number in monotonically_increasing_id


class PageIndex:
    """A sorted table in path; schema is that of its rows."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        self.spark, self.path, self.schema = spark, path, schema
        self._directory: list[tuple[int, int, int]] | None = None

    def directory(self) -> list[tuple[int, int, int]]:
        """(range, rows before it, rows in it), in order; ranges without rows are left out."""
        if self._directory is None:
            counts = sorted((r["_range"], r["n"]) for r in self.spark.read.schema("_range long, n long").parquet(f"{self.path}/directory").collect())
            self._directory, before = [], 0
            for k, n in counts:
                self._directory.append((k, before, n))
                before += n
        return self._directory

    def rows(self) -> int:
        return sum(n for _, _, n in self.directory())

    def pages(self, size: int = 10) -> int:
        return -(-self.rows() // size)

    def ranges(self, page: int, size: int = 10) -> list[tuple[int, int, int]]:
        """(range, first place, last place) of the ranges that a page falls into."""
        if page < 1 or size < 1:
            raise ValueError("pages are counted from 1 and have rows")
        low, high = (page - 1) * size, page * size
        return [(k, max(low - before, 0), min(high - before, n) - 1) for k, before, n in self.directory() if before < high and low < before + n]

    def page(self, page: int, size: int = 10) -> DataFrame:
        """The page's rows with ``place``, their 0-based place in the whole order."""
        wanted, before = self.ranges(page, size), {k: b for k, b, _ in self.directory()}
        full = StructType([*self.schema.fields, StructField("_place", LongType())])
        out = None
        for k, first, last in wanted:
            rows = self.spark.read.schema(full).parquet(f"{self.path}/rows/_range={k}").filter(F.col("_place").between(first, last))
            rows = rows.select(*self.schema.names, (F.col("_place") + before[k]).alias("place"))
            out = rows if out is None else out.unionByName(rows)
        return self.spark.createDataFrame([], StructType([*self.schema.fields, StructField("place", LongType())])) if out is None else out


def build(df: DataFrame, order: list[Column], path: str, ranges: int = 200) -> PageIndex:
    """df's rows in path, sorted by order in about so many ranges; each range must fit a task's sort, which may spill."""
    spark = df.sparkSession
    numbered = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    rows = numbered.select(*df.columns, F.col("_id").bitwiseAND((1 << _SHIFT) - 1).alias("_place"), F.shiftright("_id", _SHIFT).alias("_range"))
    rows.write.mode("overwrite").partitionBy("_range").parquet(f"{path}/rows")
    kept = spark.read.schema("_place long, _range long").parquet(f"{path}/rows")
    kept.groupBy("_range").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/directory")
    return PageIndex(spark, path, df.schema)
