"""Notifications that each user keeps, as state: those not older than so many days, and of them the last so many.

A stream of notifications (user, seq, ts) becomes a stream of changes (user, seq, ts, kept): a row with ``kept`` true for one that
is taken in, one with false when it has to go, through age or through newer ones. ``current`` makes of all changes what is there now. What
comes too late to be among the last is never taken in. The clock is event time: a user without further notifications
loses old ones as the watermark passes, by timers, to the millisecond. The order of arrival and the cut into batches don't change
what is there at the end.

The state of a user is a list of at most ``most`` entries. Nulls: a null user is a user; rows without ts or seq are left out.
A (ts, seq) that comes again is one notification.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessella.session import keyed_state, ship_package

# as in machine: the process that sets up keyed state beside the driver doesn't get shipped files
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: What a user keeps.
DAYS, MOST = 30, 100
OUT = "user string, seq bigint, at bigint, kept boolean"


class Kept(StatefulProcessor):
    def __init__(self, days: float, most: int):
        self.age, self.most = round(days * 86_400_000_000), most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getListState("kept", "at bigint, seq bigint")

    def _entries(self) -> list[tuple[int, int]]:
        return [(int(at), int(seq)) for at, seq in self.state.get()] if self.state.exists() else []

    def _changed(self, key: tuple, before: list, now: list) -> pd.DataFrame:
        """Stores what is kept now, with a timer for the oldest entry; the rows that say what changed."""
        if now:
            self.state.put(now)
            self.handle.registerTimer(-(-(now[0][0] + self.age) // 1000))
        else:
            self.state.clear()
        old, new = set(before), set(now)
        rows = [(key[0], seq, at, True) for at, seq in now if (at, seq) not in old] + [(key[0], seq, at, False) for at, seq in before if (at, seq) not in new]
        return pd.DataFrame(rows, columns=["user", "seq", "at", "kept"], dtype=object).astype({"seq": "int64", "at": "int64", "kept": "bool"})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = self._entries()
        last = set(before)
        for pdf in rows:  # batch by batch, so a user's rows needn't fit in memory
            last.update(zip(pdf["at"].tolist(), pdf["seq"].tolist()))
            last = set(sorted(last)[-self.most :])
        newest = max(at for at, _ in last)
        yield self._changed(key, before, sorted(e for e in last if e[0] + self.age > newest))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # all that the watermark has passed: a timer set here for the next entry would only fire in a later batch
        before, now = self._entries(), max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        yield self._changed(key, before, [e for e in before if e[0] + self.age > now])

    def close(self) -> None:
        pass


def changes(notifications: DataFrame, days: float = DAYS, most: int = MOST, late: str = "0 seconds") -> DataFrame:
    """The stream of changes of a stream of notifications (user, seq, ts); those later than the watermark are dropped."""
    ship_package(notifications.sparkSession)
    keyed_state(notifications.sparkSession)
    rows = notifications.filter("ts is not null AND seq is not null").withWatermark("ts", late)
    rows = rows.select(F.col("user").cast("string").alias("user"), F.col("seq").cast("long").alias("seq"), "ts", F.unix_micros("ts").alias("at"))
    out = rows.groupBy("user").transformWithStateInPandas(Kept(days, most), OUT, "append", "EventTime")
    return out.select("user", "seq", F.timestamp_micros("at").alias("ts"), "kept")


def current(changes: DataFrame) -> DataFrame:
    """(user, seq, ts) of what is there after all changes of a table: an entry is taken in once and goes once."""
    return changes.groupBy("user", "seq", "ts").agg(F.bool_and("kept").alias("kept")).filter("kept").drop("kept")


def retained_by_user(notifications: DataFrame, days: float = DAYS, most: int = MOST) -> DataFrame:
    """The same of a table of (user, seq, ts) at the time of its newest notification, by window functions."""
    rows = notifications.filter("ts is not null AND seq is not null").select(F.col("user").cast("string").alias("user"), F.col("seq").cast("long").alias("seq"), "ts").distinct()
    newest = rows.agg(F.max("ts").alias("now"))
    rows = rows.join(F.broadcast(newest), F.col("ts") > F.col("now") - F.expr(f"INTERVAL {round(days * 86_400_000)} MILLISECOND"))
    place = F.row_number().over(Window.partitionBy("user").orderBy(F.desc("ts"), F.desc("seq")))
    return rows.withColumn("_n", place).filter(F.col("_n") <= most).select("user", "seq", "ts")
