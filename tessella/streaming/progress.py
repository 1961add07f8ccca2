"""Progress events as streams: latest state of each document, and what processes come to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.values import stage_of
from tessella.session import shared_path
from tessella.sources.versioned import Keyed, latest_of


def latest_states(events: DataFrame, by: str, ts: str, tie: str, columns: list[str]) -> DataFrame:
    """The columns of each key's last event by (ts, tie); the same for batches and, in update or complete mode, streams."""
    return events.groupBy(by).agg(F.max_by(F.struct(*columns), F.struct(ts, tie)).alias("s")).select(by, *[f"s.{c}" for c in columns])


def run_to_table(states: DataFrame, name: str, key: str, path: str | None = None, buckets: int = 16) -> DataFrame:
    """The streaming aggregate run over all there is, as a keyed table in the shared folder, read back: each batch passes on the keys that changed,
    and only their buckets are rewritten. With a path that a former run used, the stream goes on where that stopped."""
    spark, path = states.sparkSession, path or shared_path(states.sparkSession, name)
    keyed = lambda session: Keyed(session, f"{path}/table", states.schema, key, buckets)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/changes")
        keyed(spark).change(spark.read.schema(states.schema).parquet(f"{path}/changes"), latest_of(key, []), name, number)

    states.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return keyed(spark).read()


def run_to_rows(rows: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """An append stream run over all there is, as a table in the shared folder, read back: each batch has its folder, so a repeated batch replaces itself."""
    spark, path = rows.sparkSession, path or shared_path(rows.sparkSession, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    spark.createDataFrame([], rows.schema).write.mode("overwrite").parquet(f"{path}/rows/batch=-1")
    rows.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/rows/batch=*")


def staged(events: DataFrame) -> DataFrame:
    """With stage and failed; progress -1 is an error and keeps the stage."""
    return events.withColumns({"stage": stage_of(F.col("progress")), "failed": F.col("progress") == -1})


def daily(events: DataFrame, ts: str, late: str = "1 day") -> DataFrame:
    """Events of each day, for streams with a watermark."""
    source = events.withWatermark(ts, late) if events.isStreaming else events
    return source.groupBy(F.window(ts, "1 day").alias("day")).agg(F.count("*").alias("n")).select(F.col("day.start").alias("day"), "n")


def process_states(events: DataFrame) -> DataFrame:
    """(process_id, status, progress, stage, n_events) of events (process_id, seq, progress): progress only grows, an error (-1) or completion is final. By aggregates only."""
    end = F.min(F.when((F.col("progress") == -1) | (F.col("progress") >= 100), F.col("seq")))
    ends = events.groupBy("process_id").agg(end.alias("end"), F.count("*").alias("n_events"))
    rows = events.join(ends, "process_id").filter(F.col("end").isNull() | (F.col("seq") <= F.col("end")))
    out = rows.groupBy("process_id").agg(F.greatest(F.max("progress"), F.lit(0)).alias("progress"), F.max_by("progress", "seq").alias("last"), F.max("n_events").alias("n_events"))
    status = F.when(F.col("last") == -1, "error").when(F.col("last") >= 100, "completed").otherwise("processing")
    return out.select("process_id", status.alias("status"), "progress", stage_of(F.col("progress")).alias("stage"), "n_events")


def display_order(notifications: DataFrame, by: str, arrival: str, tie: str) -> DataFrame:
    """With turn: the place of each in its queue, first come first shown, one at a time."""
    return notifications.withColumn("turn", F.row_number().over(Window.partitionBy(by).orderBy(arrival, tie)))


def display_times(notifications: DataFrame, by: str, arrival: str, tie: str, duration: str, block: int = 3_600_000_000) -> DataFrame:
    """With start and end: each queue shows one at a time, first come first shown, so a notification starts when it has arrived and the one before has ended.

    arrival and duration are integers of one unit (microseconds by default), durations not negative. start_i = max(arrival_i, end_(i-1)) unrolls to the greatest, over
    j up to i, of arrival_j plus the durations from j to i - 1: a running sum and a running maximum. A queue is cut into blocks of arrival times, each one group of the
    window; what a block does to those after it is two numbers, its sum and its maximum, so a queue that has a third of all rows is as many groups
    as it has blocks. Null arrivals and durations count as 0; null queues are one queue; rows with equal arrival and tie may come in either order.
    """
    rows = notifications.withColumns({"_a": F.coalesce(F.col(arrival).cast("long"), F.lit(0)), "_d": F.coalesce(F.col(duration).cast("long"), F.lit(0))})
    rows = rows.withColumn("_b", F.floor(F.col("_a") / block))
    inner = Window.partitionBy(by, "_b").orderBy("_a", tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_sum", F.sum("_d").over(inner))  # durations of the block up to this one
    rows = rows.withColumn("_most", F.max(F.col("_a") - F.col("_sum") + F.col("_d")).over(inner))
    blocks = rows.groupBy(by, "_b").agg(F.max("_sum").alias("_total"), F.max("_most").alias("_top"))
    earlier = Window.partitionBy(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_total").over(earlier), F.lit(0)))
    blocks = blocks.withColumn("_top", F.max(F.col("_top") - F.col("_before")).over(earlier))  # as times less all durations from the queue's beginning
    blocks = blocks.select(F.col(by).alias("_by"), F.col("_b").alias("_block"), "_before", "_top")
    both = rows.join(blocks, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_b") == F.col("_block")))
    end = F.greatest(F.col("_most"), F.col("_top") + F.col("_before")) + F.col("_sum")
    return both.select(*notifications.columns, (end - F.col("_d")).alias("start"), end.alias("end"))


def write_events(events: DataFrame, path: str):
    """A stream of events as server-sent lines ``data: {...}``, appended to text files in path batch by batch; each batch has its folder, so a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.select(F.concat(F.lit("data: "), F.to_json(F.struct("*")), F.lit("\n")).alias("value")).write.mode("overwrite").text(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", shared_path(events.sparkSession, "events")).trigger(availableNow=True).start()
