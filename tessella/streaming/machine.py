"""The process on display of each session, as a state machine with timers.

Commands (session, seq, ts, kind, process_id, progress) come in the order of (ts, seq): ``start`` makes a process the one
on display, at progress 0, whatever was there; ``update``, ``complete`` and ``fail`` of another process than that are ignored.
Complete and fail end the process and set a timer: ``kept`` after it, what is on display then is cleared, be it the
ended process or one started meanwhile. A timer that is due at a command's time fires before it. Timers are event-time timers, so
sessions without further commands are cleared when the watermark passes; between commands they fire where the
commands' times say so, and the result doesn't depend on how the stream is cut into batches.

A row for each command says what is on display after it and whether it was taken; one of kind ``clear`` tells of a cleared process.
Null kinds and unknown ones are ignored; a null session is a session.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessella.functions.values import stage_of
from tessella.session import keyed_state, ship_package

# the process that sets up keyed state beside the driver doesn't get shipped files, so what it needs goes along as it is
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Seconds after its end in which a process stays on display.
KEPT = 5.0
OUT = "session string, seq bigint, at bigint, kind string, taken boolean, process_id string, status string, progress int"
STATE = "process_id string, status string, progress int, timers array<bigint>"


class Display:
    """What one session shows: (process_id, status, progress) or None, and the times at which it is cleared, in microseconds."""

    def __init__(self, shown: tuple | None = None, timers: list[int] = ()):
        self.shown, self.timers = shown, sorted(timers)

    def cleared(self, now: int) -> list[tuple]:
        """Fires the timers due by now; what was on display at each, with its time."""
        out = []
        while self.timers and self.timers[0] <= now:
            at = self.timers.pop(0)
            if self.shown:
                out.append((at, *self.shown))
                self.shown = None
        return out

    def take(self, kind: str | None, process_id: str, progress: int, now: int, kept: int) -> bool:
        if kind == "start":
            self.shown = (process_id, "processing", 0)
            return True
        if kind not in ("update", "complete", "fail") or not self.shown or self.shown[0] != process_id:
            return False
        if kind == "update":
            self.shown = (process_id, self.shown[1], progress)
        else:
            self.shown = (process_id, "completed", 100) if kind == "complete" else (process_id, "error", self.shown[2])
            self.timers.append(now + kept)
        return True


class Machine(StatefulProcessor):
    def __init__(self, kept: float):
        self.kept = round(kept * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("display", STATE)

    def _load(self) -> Display:
        if not self.state.exists():
            return Display()
        process_id, status, progress, timers = self.state.get()
        return Display((process_id, status, progress) if status is not None else None, [int(t) for t in timers])

    def _save(self, d: Display) -> None:
        if d.shown or d.timers:
            self.state.update((*(d.shown or (None, None, None)), d.timers))
        else:
            self.state.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        display, out = self._load(), []
        before = set(display.timers)
        for r in pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable").itertuples():
            out += [(key[0], None, at, "clear", True, *was) for at, *was in display.cleared(r.at)]
            progress = None if pd.isna(r.progress) else int(r.progress)
            taken = display.take(r.kind, r.process_id, progress, r.at, self.kept)
            out.append((key[0], r.seq, r.at, r.kind, taken, *(display.shown or (None, None, None))))
        for at in set(display.timers) - before:
            self.handle.registerTimer(-(-at // 1000))
        self._save(display)
        yield frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        display = self._load()
        out = [(key[0], None, at, "clear", True, *was) for at, *was in display.cleared(expiredTimerInfo.getExpiryTimeInMs() * 1000)]
        self._save(display)
        yield frame(out)

    def close(self) -> None:
        pass


def frame(rows: list[tuple]) -> pd.DataFrame:
    names = ["session", "seq", "at", "kind", "taken", "process_id", "status", "progress"]
    return pd.DataFrame(rows, columns=names, dtype=object).astype({"seq": "Int64", "at": "int64", "progress": "Int32", "taken": "bool"})


def displays(commands: DataFrame, kept: float = KEPT, late: str = "0 seconds") -> DataFrame:
    """The stream of rows (OUT's columns, ts in place of at, stage) for a stream of commands; commands later than the watermark are dropped."""
    ship_package(commands.sparkSession)
    keyed_state(commands.sparkSession)
    rows = commands.withWatermark("ts", late).select(F.col("session").cast("string").alias("session"), F.col("seq").cast("long").alias("seq"), "ts", F.unix_micros("ts").alias("at"), "kind", F.col("process_id").cast("string").alias("process_id"), F.col("progress").cast("int").alias("progress"))
    out = rows.groupBy("session").transformWithStateInPandas(Machine(kept), OUT, "append", "EventTime")
    return out.select("session", "seq", F.timestamp_micros("at").alias("ts"), "kind", "taken", "process_id", "status", "progress", F.when(F.col("status").isNotNull(), stage_of(F.col("progress"))).alias("stage"))
