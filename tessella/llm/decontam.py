"""Benchmark decontamination by template windows.

Words are runs of characters other than ASCII white space and punctuation. A benchmark item and a document are both
written twice: literally (lower case), and as a template, in which numbers (with a unit word right after them),
capitalised names and unit words become typed placeholders, so that a question with other values or names has the
same template. Windows of ``size`` words of both forms are hashed and joined; a template window counts only with
``least_literal`` literal words and a placeholder, and only if slots are consistent: along one alignment of the
item with the document, an item's value always stands for the same value in the document, and two names never for
one. An item of fewer words than a window (but at least ``least_words``) is one window of its own length.

A document is contaminated by an item if, of one form, at least ``coverage`` of the item's windows are found in it, or
windows that together span ``words_covered`` of the item's words (an edited word breaks the windows over it, but not
those on both sides), or if ``run`` consecutive words of the item stand in it literally.

Where the benchmark's windows are at most ``known_limit``, their hashes are sent to the tasks, which look up every
window of every document there and pass on the hits; beyond that all windows go through a shuffled join. Both ways
give the same rows.

Edge cases: null and empty texts have no windows; items of fewer than ``least_words`` words are never found; equal
items are each reported; rows repeated under one id are one document; a null id is reported as null; columns other
than the named ones are ignored; whole texts are read whatever their length. Windows are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import releasing, ship_package, small_or_shuffled, table, text_or_empty, written
from tessella.llm.shingles import U, mix, pieces, windows, words

SIZE, LEAST_LITERAL, LEAST_WORDS, COVERAGE, WORDS_COVERED, RUN = 8, 4, 5, 0.5, 0.7, 13
KNOWN_LIMIT = 4_000_000
LITERAL, TEMPLATE = 0, 1
UNITS = "mm cm m km kg g mg t l ml s h min ms inch inches foot feet mile miles yard yards pound pounds ounce ounces gram grams kilogram kilograms meter meters metre metres kilometer kilometers kilometre kilometres liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros percent degree degrees watt watts volt volts"
NUMBER, NAME, UNIT = (mix(np.array([k], np.uint64))[0] for k in (101, 102, 103))
#: Bytes as word bytes: ASCII white space, control characters and punctuation separate.
BYTES = np.array([32 if b < 48 or 58 <= b < 65 or 91 <= b < 97 or 123 <= b < 128 else b for b in range(256)], np.uint8)
_known_units: list[np.ndarray] = []


def unit_hashes() -> np.ndarray:
    if not _known_units:
        data = np.frombuffer(UNITS.encode(), np.uint8)
        _known_units.append(np.sort(words(data, np.array([0, len(data)]))[2]))
    return _known_units[0]


class Forms:
    """Both forms of a piece of texts: for each, token hashes, literal flags, starts, ends and each text's first token."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.raw = raw
        data = BYTES[raw]
        start, end, hashes = words(data, offsets)
        owner = np.searchsorted(offsets, start, "right") - 1
        n = len(start)
        first = data[start] if n else data[:0]
        second = data[np.minimum(start + 1, len(data) - 1)] if n else data[:0]
        number = (first >= 48) & (first <= 57)
        unit = np.isin(hashes, unit_hashes()) & ~number
        name = ((first >= 65) & (first <= 90) | (first == 0xC3) & (second >= 0x80) & (second <= 0x9E)) & ~unit
        self.forms = {LITERAL: (hashes, np.ones(n, bool), start, end, owner)}
        drop = np.zeros(n, bool)  # numbers and units that follow a number belong to it
        if n:
            joined = (number | unit)[1:] & number[:-1] & (owner[1:] == owner[:-1])
            drop[1:] = joined
            drop[2:] |= unit[2:] & joined[:-1] & number[1:-1] & (owner[2:] == owner[1:-1])
        keep = ~drop
        slots = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, hashes)))
        self.forms[TEMPLATE] = (slots[keep], ~(number | unit | name)[keep], start[keep], end[keep], owner[keep])
        self.slots = slots[keep]

    def windows(self, form: int, size: int, least_literal: int) -> tuple[np.ndarray, np.ndarray]:
        """First token and hash of each window that counts."""
        tokens, literal, _, _, owner = self.forms[form]
        n = len(tokens) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        ok = owner[:n] == owner[size - 1 :]
        if form == TEMPLATE:
            sums = np.concatenate([[0], np.cumsum(literal)])
            literals = sums[size:] - sums[:n]
            ok &= (literals >= min(least_literal, size - 1)) & (literals < size)
        at = np.flatnonzero(ok)
        return at, (windows(tokens, size) + U(form))[at]

    def values(self, form: int, at: int, size: int) -> list[str]:
        """Slots of a window, as kind and value."""
        if form == LITERAL:
            return []
        _, literal, start, end, _ = self.forms[form]
        kind = {int(NUMBER): "#", int(NAME): "N", int(UNIT): "U"}
        return [kind[int(self.slots[k])] + bytes(self.raw[start[k] : end[k]]).decode("utf-8", "replace") for k in range(at, at + size) if not literal[k]]


def window_rows(texts: DataFrame, sizes: list[int], least_literal: int, known: np.ndarray | None) -> DataFrame:
    """texts (id, text) -> (id, form, size, pos, hash, slots, tokens), of all windows or of those in known; tokens is the text's number of tokens in the form."""
    id_field = texts.schema[0]
    spark = ship_package(texts.sparkSession)
    shared = spark.sparkContext.broadcast(known)
    arrow = pa.schema([("form", pa.int32()), ("size", pa.int32()), ("pos", pa.int64()), ("hash", pa.int64()), ("slots", pa.list_(pa.string())), ("tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        if known is not None:
            maybe = np.zeros(1 << 20, bool)
            maybe[(known >> U(44)).astype(np.int64)] = True
        for batch in batches:
            ids = batch.column(0)
            for row, raw, offsets in pieces(batch.column(1)):
                forms, out = Forms(raw, offsets), []
                for form in (LITERAL, TEMPLATE):
                    owner = forms.forms[form][4]
                    begins = np.searchsorted(owner, np.arange(len(offsets)))
                    for size in sizes:
                        at, hashes = forms.windows(form, size, least_literal)
                        if known is not None:
                            hit = np.flatnonzero(maybe[(hashes >> U(44)).astype(np.int64)])
                            hit = hit[np.isin(hashes[hit], known)]
                            at, hashes = at[hit], hashes[hit]
                        out += [(row + int(o), form, size, int(a - begins[o]), int(h), forms.values(form, int(a), size), int(begins[o + 1] - begins[o])) for a, h, o in zip(at, hashes.view(np.int64), owner[at])]
                if out:
                    columns = list(zip(*out))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(columns[0]))] + [pa.array(c, f.type) for c, f in zip(columns[1:], arrow)], names=["id", *arrow.names])

    return texts.mapInArrow(releasing(run), f"id {id_field.dataType.simpleString()}, form int, size int, pos long, hash long, slots array<string>, tokens long")


def contaminated(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = SIZE,
                 least_literal: int = LEAST_LITERAL, least_words: int = LEAST_WORDS, coverage: float = COVERAGE, words_covered: float = WORDS_COVERED, run: int = RUN, known_limit: int = KNOWN_LIMIT) -> DataFrame:
    """doc_id, item_id, n_windows found (of the form that is found best) and item_windows, for each document and item that contaminates it."""
    items = benchmark.select(F.col(item_id).alias("id"), text_or_empty(item_text).alias("text"))
    docs = documents.select(F.col(doc_id).alias("id"), text_or_empty(text).alias("text"))
    sizes = list(range(least_words, size + 1))
    own = window_rows(items, sizes, least_literal, None)
    own = written(own.filter((F.col("size") == size) | (F.col("size") == F.col("tokens")) & (F.col("tokens") < size)), "items")
    used = sorted(r["size"] for r in own.select("size").distinct().collect())
    few = own.select("hash").distinct().limit(known_limit + 1).count() <= known_limit
    known = np.sort(own.select("hash").distinct().toArrow()["hash"].to_numpy().view(np.uint64)) if few else None
    hits = window_rows(docs, used, least_literal, known).drop("tokens")

    theirs = own.select("hash", "form", "size", F.col("id").alias("item"), F.col("pos").alias("at"), F.col("slots").alias("wanted"))
    found = hits.join(F.broadcast(theirs) if own.limit(known_limit // 8 + 1).count() <= known_limit // 8 else theirs, ["hash", "form", "size"])
    found = found.select("id", "item", "form", "at", (F.col("pos") - F.col("at")).alias("shift"), F.arrays_zip("wanted", "slots").alias("pairs"))
    # an alignment is one item at one place of a document: no more rows than the item has windows
    aligned = found.groupBy("id", "item", "form", "shift").agg(F.collect_set("at").alias("ats"), F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs"))
    same = lambda p, q: (p["wanted"] == q["wanted"]) & (p["slots"] != q["slots"])
    merged = lambda p, q: (p["wanted"] != q["wanted"]) & (p["slots"] == q["slots"]) & p["wanted"].startswith("N")
    aligned = aligned.filter(~F.exists("pairs", lambda p: F.exists("pairs", lambda q: same(p, q) | merged(p, q))))
    # lists of places of an item: no longer than the item
    straight = lambda v: F.size(F.filter(v, lambda x, k: F.get(v, k + run - size) == x + run - size)) > 0
    aligned = aligned.withColumn("ats", F.array_sort("ats"))
    aligned = aligned.withColumn("straight", (F.col("form") == LITERAL) & straight(F.col("ats")))
    whole = own.groupBy(F.col("id").alias("item"), "form").agg(F.countDistinct("pos").alias("item_windows"), F.max("tokens").alias("item_words"))
    counted = aligned.groupBy("id", "item", "form").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("ats")))).alias("ats"), F.max("straight").alias("straight"))
    spans = F.transform("ats", lambda x, k: F.coalesce(F.least(F.get("ats", k + 1) - x, F.lit(size)), F.lit(size)))
    counted = counted.select("id", "item", "form", "straight", F.size("ats").cast("long").alias("n_windows"), F.aggregate(spans, F.lit(0).cast("long"), lambda s, x: s + x).alias("covered"))
    counted = counted.join(whole, [counted["item"].eqNullSafe(whole["item"]), counted["form"] == whole["form"]]).select("id", counted["item"], "n_windows", "item_windows", "straight", F.least("covered", "item_words").alias("covered"), "item_words")
    over = counted.filter((F.col("n_windows") >= coverage * F.col("item_windows")) | (F.col("covered") >= words_covered * F.col("item_words")) | F.col("straight"))
    best = over.groupBy("id", "item").agg(F.max(F.struct((F.col("n_windows") / F.col("item_windows")).alias("share"), "n_windows", "item_windows")).alias("b"))
    return best.select(F.col("id").alias(doc_id), F.col("item").alias(item_id), "b.n_windows", "b.item_windows")


def without_leaks(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of documents that no item contaminates; a row without an id stays."""
    gone = written(contaminated(documents, benchmark, doc_id, text).select(F.col(doc_id).alias("_id")).distinct(), "leaks")
    return documents.join(small_or_shuffled(gone), documents[doc_id] == gone["_id"], "left_anti")


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
