import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF

from tessella.plans import registry
from tessella.sources import tables
from tessella.streaming import frames, machine, progress


def test_process_states(spark):
    rows = [("a", i, p) for i, p in enumerate((0, 10, 30, 40, 60, 70, 90, 100))] + [("b", i, p) for i, p in enumerate((0, 45, 50, -1, 100))] + [("c", 0, 65), ("c", 1, 60)]
    got = progress.process_states(spark.createDataFrame(rows, "process_id string, seq bigint, progress int")).collect()
    want = {"a": ("completed", 100, "completed", 8), "b": ("error", 50, "brnet", 5), "c": ("processing", 65, "validation", 2)}
    assert {r["process_id"]: (r["status"], r["progress"], r["stage"], r["n_events"]) for r in got} == want


def commands(spark, path, batches):
    """Files of commands (session, seq, seconds, kind, process, progress), one for each batch, read as a stream file by file."""
    schema = "session string, seq long, ts timestamp, kind string, process_id string, progress int"
    for number, rows in enumerate(batches):
        df = spark.createDataFrame([(s, n, t, k, p, g) for s, n, t, k, p, g in rows], schema.replace("ts timestamp", "ts long"))
        df.withColumn("ts", F.timestamp_seconds("ts")).coalesce(1).write.mode("append").parquet(f"{path}/{number}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(f"{path}/*")


def shown(rows):
    return sorted(((r["session"], r["ts"].timestamp() % 1000, r["seq"] if r["seq"] is not None else -1, r["kind"], r["taken"], r["process_id"], r["status"], r["progress"]) for r in rows.collect()), key=str)


STEPS = [
    ("s", 1, 10, "update", "p", 30), ("s", 2, 11, "start", "p", None), ("s", 3, 12, "update", "q", 50), ("s", 4, 13, "update", "p", 50), ("s", 5, 14, "complete", "q", None), ("s", 6, 15, "complete", "p", None),
    ("s", 7, 17, "start", "q", None), ("s", 8, 21, "update", "q", 70), ("s", 9, 22, "start", "r", None), ("s", 10, 23, "fail", "r", None), ("s", 11, 23, None, "r", 5), ("t", 12, 24, "start", "p", None), ("t", 13, 40, "update", "p", 10),
]
#: By hand: the timer of 15 + 5 s clears q, which was started meanwhile; r is cleared 5 s after its failure.
SHOWN = [
    ("s", 10, 1, "update", False, None, None, None), ("s", 11, 2, "start", True, "p", "processing", 0), ("s", 12, 3, "update", False, "p", "processing", 0), ("s", 13, 4, "update", True, "p", "processing", 50),
    ("s", 14, 5, "complete", False, "p", "processing", 50), ("s", 15, 6, "complete", True, "p", "completed", 100), ("s", 17, 7, "start", True, "q", "processing", 0), ("s", 20, -1, "clear", True, "q", "processing", 0),
    ("s", 21, 8, "update", False, None, None, None), ("s", 22, 9, "start", True, "r", "processing", 0), ("s", 23, 10, "fail", True, "r", "error", 0), ("s", 23, 11, None, False, "r", "error", 0),
    ("s", 28, -1, "clear", True, "r", "error", 0), ("t", 24, 12, "start", True, "p", "processing", 0), ("t", 40, 13, "update", True, "p", "processing", 10),
]


@pytest.mark.parametrize("cuts", [[], [6, 8], [5, 9]])
def test_what_a_session_shows(spark, tmp_path, cuts):
    """The same rows however the commands are cut into batches; the session without more commands is cleared by the watermark."""
    ends = [0, *cuts, len(STEPS)]
    stream = commands(spark, tmp_path / "in", [STEPS[a:b] for a, b in zip(ends, ends[1:])])
    assert shown(progress.run_to_rows(machine.displays(stream), "shown")) == sorted(SHOWN, key=str)


def events_text(k):
    body = "".join(f'data: {{"seq": {i}, "message": "é\U0001f642 {k} {i}"}}' + ("\n\n", "\r\n\r\n", "\r\r")[i % 3] for i in range(k))
    return body + ': note\n\ndata: {"seq": 99, "message": "without an end"}'


def plain_frames(text):
    parts = re.split("\n\n|\r\n\r\n|\r\r", text)[:-1]
    return list(enumerate(parts))


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_frames_of_chunks_cut_anywhere(spark, size):
    texts = {f"c{k}": events_text(k) for k in range(6)} | {"empty": ""}
    chunks = frames.cut_in_chunks(spark.createDataFrame(list(texts.items()), "connection string, text string"), "connection", "text", F.lit(size))
    again = chunks.union(chunks.filter("number % 3 = 1"))  # some come twice
    got = frames.framed(again.repartition(3)).collect()
    assert sorted((r["connection"], r["position"], r["frame"]) for r in got) == sorted((c, i, f) for c, t in texts.items() for i, f in plain_frames(t))


def test_frames_over_batches_and_gaps(spark, tmp_path):
    """Chunks in any order over several batches; after a missing chunk a connection gives nothing more."""
    texts = {f"c{k}": events_text(k) for k in range(5)}
    rows = [(c, n, t.encode()[n * 5 : n * 5 + 5]) for c, t in texts.items() for n in range(-(-len(t.encode()) // 5))]
    rows = [r for r in rows if r[:2] != ("c4", 20)] + [(None, 0, b"x\n\n"), ("odd", 0, b"\xff\n"), ("odd", 1, None), ("odd", 2, b"\n")]
    for k in range(3):
        spark.createDataFrame([r for i, r in enumerate(rows) if i * 7 % 3 == k], "connection string, number long, chunk binary").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("connection string, number long, chunk binary").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = sorted((r["connection"], r["position"], r["frame"]) for r in progress.run_to_rows(frames.framed_stream(stream), "frames").collect())
    want = [(c, i, f) for c in ("c0", "c1", "c2", "c3") for i, f in plain_frames(texts[c])] + [("odd", 0, "\ufffd")]
    kept = texts["c4"].encode()[:100].decode("utf-8", "ignore")
    assert got == sorted(want + [("c4", i, f) for i, f in plain_frames(kept)])
    table = spark.read.parquet(str(tmp_path / "in"))
    assert sorted((r["connection"], r["position"], r["frame"]) for r in frames.framed(table).collect()) == got


class Values:
    """A state variable in plain Python; calls counts what would be calls to the store."""

    def __init__(self, calls):
        self.kept, self.calls = {}, calls

    def getValue(self, key=()):  # noqa: N802
        self.calls.append(key)
        return self.kept.get(key)

    def updateValue(self, key, value):  # noqa: N802
        self.calls.append(key)
        self.kept[key] = value

    def containsKey(self, key):  # noqa: N802
        return self.getValue(key) is not None

    def removeKey(self, key):  # noqa: N802
        self.calls.append(key)
        del self.kept[key]

    get, exists = getValue, containsKey

    def update(self, value):
        self.updateValue((), value)


class Handle:
    def __init__(self):
        self.calls, self.made = [], {}

    def getValueState(self, name, *_):  # noqa: N802
        return self.made.setdefault(name, Values(self.calls))

    getMapState = getValueState  # noqa: N815


@pytest.mark.parametrize("heavy", [None, 3000, 600])
def test_a_bucket_is_read_and_written_once(monkeypatch, heavy):
    """Sixty connections of one bucket come in four batches, each with every fourth chunk: two calls to the store a batch, however many connections
    and chunks; with a low limit what waits is saved apart and the frames are the same. A chunk that comes again with other bytes is ignored."""
    monkeypatch.setattr(frames, "HEAVY", heavy or frames.HEAVY)
    texts = {f"c{k}": events_text(k % 9) for k in range(60)}
    rows = [(c, n, t.encode()[n * 5 : n * 5 + 5]) for c, t in texts.items() for n in range(-(-len(t.encode()) // 5))]
    handle, carry, got = Handle(), frames.Carry(), []
    carry.init(handle)
    for k in (3, 2, 1, 0):
        handle.calls.clear()
        some = [r for r in rows if r[1] % 4 == k] + [(c, n, b"other") for c, n, _ in rows if n % 4 > k]
        for part in (some,) if heavy is None else (some[::2], some[1::2]):
            for pdf in carry.handleInputRows((0,), iter([pd.DataFrame(part, columns=["connection", "number", "chunk"])]), None):
                got += pdf.itertuples(index=False, name=None)
        assert heavy or len(handle.calls) <= 2
    assert sorted(got) == sorted((c, i, f) for c, t in texts.items() for i, f in plain_frames(t))
    assert bool(handle.made["framers"].kept) == bool(heavy) and not handle.made["waiting"].kept


def test_frames_that_wait_apart(spark, tmp_path, monkeypatch):
    """With a low limit framers and chunks go to entries of their own in the store, and come back over several batches."""
    monkeypatch.setattr(frames, "HEAVY", 800)
    monkeypatch.setattr(frames, "BUCKETS", 2)
    texts = {f"c{k}": events_text(k) for k in range(6)}
    rows = [(c, n, t.encode()[n * 9 : n * 9 + 9]) for c, t in texts.items() for n in range(-(-len(t.encode()) // 9))]
    for k in (2, 1, 0):
        spark.createDataFrame([r for r in rows if r[1] % 3 == k], "connection string, number long, chunk binary").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("connection string, number long, chunk binary").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = progress.run_to_rows(frames.framed_stream(stream), "frames").collect()
    assert sorted((r["connection"], r["position"], r["frame"]) for r in got) == sorted((c, i, f) for c, t in texts.items() for i, f in plain_frames(t))


def test_events_are_written_batch_by_batch(spark, tmp_path):
    df = spark.createDataFrame([("d", k, 10 * k) for k in range(5)], "doc_id string, seq bigint, progress int")
    df.repartition(2).write.json(str(tmp_path / "in"))
    progress.write_events(spark.readStream.schema(df.schema).json(str(tmp_path / "in")), str(tmp_path / "out")).awaitTermination()
    lines = spark.read.text(str(tmp_path / "out")).select("value")
    assert sorted(tables.event_lines(lines).select("doc_id", "seq", "progress").collect()) == sorted(df.collect())


def test_latest_and_staged(spark):
    df = spark.createDataFrame([("d", 1, 10), ("d", 3, -1), ("d", 2, 60)], "doc_id string, seq bigint, progress int")
    assert progress.latest_states(df, "doc_id", "seq", "seq", ["progress"]).first()["progress"] == -1
    assert [(r["stage"], r["failed"]) for r in progress.staged(df).orderBy("seq").collect()] == [("ocr", False), ("validation", False), (None, True)]
    days = progress.daily(df.select(F.timestamp_seconds(F.col("seq") * 50000).alias("ts")), "ts")
    assert sorted(r["n"] for r in days.collect()) == [1, 2]


def test_latest_states_go_to_storage(spark, tmp_path):
    """Rows of the result are in the shared folder, not with the driver, whatever the number of batches."""
    schema = "user_id long, ts long, event_id long, value double"
    rows = [(i % 7, i * 13 % 50, i, i / 2) for i in range(60)]
    for k in range(3):
        spark.createDataFrame(rows[k::3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    (tmp_path / "none").mkdir()
    stream = lambda name: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    states = lambda name: progress.latest_states(stream(name), "user_id", "ts", "event_id", ["event_id", "value"])
    got = progress.run_to_table(states("in"), "latest", "user_id")
    want = {u: max((t, e, v) for w, t, e, v in rows if w == u)[1:] for u in range(7)}
    assert sorted((r["user_id"], (r["event_id"], r["value"])) for r in got.collect()) == sorted(want.items())
    assert progress.run_to_table(states("none"), "latest", "user_id").count() == 0


def test_stream_progress_reads_the_shared_folder(spark):
    got = registry.stream_progress(spark, SF)
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    assert got.inputFiles() and all(shared in f for f in got.inputFiles())
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, registry.latest_state(spark, SF).select(got.columns).collect()))


def test_stream_of_frames_writes_chunks_where_texts_are(spark, tmp_path, monkeypatch):
    """A table of three files is cut by three tasks in each of the four quarters, and each quarter is one batch of the stream."""
    spark.read.parquet(f"{SF}/documents.parquet").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    paths, shared_path = {}, registry.shared_path
    monkeypatch.setattr(registry, "shared_path", lambda session, name: paths.setdefault(name, shared_path(session, name)))
    got = registry.framed_stream(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, registry.framed_events(spark, SF).select(got.columns).collect()))
    assert len(spark.read.parquet(paths["chunks"]).inputFiles()) == 12
    assert [r["batch"] for r in spark.read.parquet(f"{paths['frames']}/rows").select("batch").distinct().orderBy("batch").collect()] == [3]
