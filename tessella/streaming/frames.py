"""Frames of byte streams that arrive in chunks cut anywhere, also within a separator or a character.

Chunks (connection, number, chunk) of a connection are joined in the order of their numbers, from 0 on, and cut at
``\\n\\n``, ``\\r\\n\\r\\n`` and ``\\r\\r``. What follows the last separator is kept until more comes, and is no frame if
nothing does. A chunk that comes before its turn waits, one that comes again is ignored, and so chunks after a missing
one give nothing. A null chunk is empty, a chunk without connection or number is dropped. Bytes that are no UTF-8 become
U+FFFD in the frame where they stand.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessella.session import keyed_state, ship_package

# the process that sets up keyed state beside the driver doesn't get shipped files, so what it needs goes along as it is
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEPARATOR = re.compile(rb"\n\n|\r\n\r\n|\r\r")
OUT = "connection string, position bigint, frame string"
#: Groups of connections of a stream, the same for as long as its state lives.
BUCKETS = 8192
#: What is saved of a framer: apart counts the chunks that wait in entries of their own.
FRAMER = {"following": "bigint", "position": "bigint", "tail": "binary", "numbers": "array<bigint>", "chunks": "array<binary>", "apart": "bigint"}
#: Bytes above which what waits is saved apart; connections and chunks count as some more than they hold.
HEAVY = 4_000_000


def weight(entry: tuple) -> int:
    return 500 + len(entry[2]) + sum(len(c) + 50 for c in entry[4])


class Framer:
    """One connection: the bytes since the last separator, the number of the next chunk and of the next frame."""

    def __init__(self, following: int = 0, position: int = 0, tail: bytes = b""):
        self.following, self.position, self.tail = following, position, bytearray(tail)

    def feed(self, chunk: bytes) -> list[tuple[int, str]]:
        """The frames, with their positions, that the next chunk ends. Of the tail only the last bytes are searched again."""
        out, start, seen = [], 0, max(0, len(self.tail) - 3)
        self.tail += chunk
        self.following += 1
        for m in SEPARATOR.finditer(self.tail, seen):
            out.append((self.position, self.tail[start : m.start()].decode("utf-8", "replace")))
            self.position += 1
            start = m.end()
        del self.tail[:start]
        return out


def frame(found: list[tuple[str, int, str]]) -> pd.DataFrame:
    connections, positions, texts = zip(*found) if found else ((), (), ())
    return pd.DataFrame({"connection": pd.Series(connections, dtype=object), "position": pd.Series(positions, dtype="int64"), "frame": pd.Series(texts, dtype=object)})


class Carry(StatefulProcessor):
    """The framers of a bucket's connections as state, each with its tail and the chunks that wait for their turn.

    They are in one value of the bucket, which is read and written once for all chunks that came together: a call for each connection or chunk costs more
    than the work on it. When the value gets too large they go to entries of their own, and chunks that are too many for one entry likewise."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.near = handle.getValueState("near", "connection array<string>, " + ", ".join(f"{c} array<{kind}>" for c, kind in FRAMER.items()) + ", more boolean")
        self.framers = handle.getMapState("framers", "connection string", ", ".join(f"{c} {kind}" for c, kind in FRAMER.items()))
        self.waiting = handle.getMapState("waiting", "connection string, number bigint", "chunk binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        connections, *columns, more = self.near.get() or (*[[]] * (1 + len(FRAMER)), False)
        near = dict(zip(connections, zip(*columns)))
        for pdf in rows:
            came: dict[str, dict[int, bytes]] = {}
            for connection, n, chunk in zip(pdf["connection"], pdf["number"], pdf["chunk"]):
                came.setdefault(connection, {}).setdefault(int(n), bytes(chunk or b""))
            found: list[tuple[str, int, str]] = []
            for connection, chunks in came.items():
                entry = near.get(connection) or more and self.framers.getValue((connection,)) or (0, 0, b"", [], [], 0)
                near[connection] = self.fed(connection, entry, chunks, found)
            if sum(map(weight, near.values())) > HEAVY:
                self.put_apart(near)
                near, more = {}, True
            if found:
                yield frame(found)
        columns = [list(c) for c in zip(*near.values())] or [[]] * len(FRAMER)
        self.near.update(([*near], *columns, more))

    def fed(self, connection: str, entry: tuple, came: dict[int, bytes], found: list[tuple[str, int, str]]) -> tuple:
        """The entry after a connection's chunks; found gets the frames that they end."""
        following, position, tail, numbers, chunks, apart = entry
        framer, waits = Framer(following, position, tail), dict(zip(numbers, chunks))
        for n, chunk in came.items():
            if n >= following and n not in waits and not (apart and self.waiting.containsKey((connection, n))):
                waits[n] = chunk
        while True:
            n = framer.following
            if n in waits:
                chunk = waits.pop(n)
            elif apart and (saved := self.waiting.getValue((connection, n))):
                chunk, apart = saved[0], apart - 1
                self.waiting.removeKey((connection, n))
            else:
                break
            found += [(connection, *f) for f in framer.feed(bytes(chunk))]
        return framer.following, framer.position, bytes(framer.tail), [*waits], [bytes(c) for c in waits.values()], apart

    def put_apart(self, near: dict[str, tuple]) -> None:
        for connection, entry in near.items():
            following, position, tail, numbers, chunks, apart = entry
            if weight(entry) > HEAVY:
                for n, chunk in zip(numbers, chunks):
                    self.waiting.updateValue((connection, n), (bytes(chunk),))
                numbers, chunks, apart = [], [], apart + len(numbers)
            self.framers.updateValue((connection,), (following, position, bytes(tail), list(numbers), [bytes(c) for c in chunks], apart))

    def close(self) -> None:
        pass


def chunk_rows(chunks: DataFrame) -> DataFrame:
    rows = chunks.select(F.col("connection").cast("string").alias("connection"), F.col("number").cast("long").alias("number"), F.col("chunk").cast("binary").alias("chunk"))
    return rows.filter("connection is not null and number >= 0")


def framed_stream(chunks: DataFrame) -> DataFrame:
    """(connection, position, frame) of a stream of chunks, in append mode."""
    ship_package(chunks.sparkSession)
    keyed_state(chunks.sparkSession)
    rows = chunk_rows(chunks).withColumn("bucket", F.pmod(F.xxhash64("connection"), F.lit(BUCKETS)))
    return rows.groupBy("bucket").transformWithStateInPandas(Carry(), OUT, "append", "None")


def framed(chunks: DataFrame) -> DataFrame:
    """The same of a table of chunks. A task goes through its connections chunk by chunk and holds one tail at a time."""
    ship_package(chunks.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, framer = None, Framer()
        for pdf in batches:
            for connection, rows in pdf.groupby("connection", sort=False):
                if connection != at:
                    at, framer = connection, Framer()
                found = []
                for n, chunk in zip(rows["number"], rows["chunk"]):
                    if n == framer.following:
                        found += framer.feed(bytes(chunk or b""))
                yield frame([(connection, *f) for f in found])

    return chunk_rows(chunks).repartition("connection").sortWithinPartitions("connection", "number").mapInPandas(run, OUT)


def cut_in_chunks(texts: DataFrame, connection: str, text: str, size) -> DataFrame:
    """(connection, number, chunk): the texts' bytes in UTF-8 in chunks of size bytes, a column."""
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    rows = texts.select(F.col(connection).cast("string").alias("connection"), body.alias("body"), size.cast("int").alias("size"))
    numbers = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.octet_length("body") / F.col("size")).cast("int") - 1))
    rows = rows.withColumn("number", F.explode(numbers))
    return rows.select("connection", F.col("number").cast("long").alias("number"), F.substr("body", F.col("number") * F.col("size") + 1, F.col("size")).alias("chunk"))
