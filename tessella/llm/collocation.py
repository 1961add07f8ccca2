"""Phrase collocation mining: phrases whose words stand together more often than their parts' counts let expect.

Texts are lower-cased (A to Z), cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those at blanks and tabs into words. All
counts are for a language: ``n`` of word occurrences, f of a phrase's occurrences within pieces, overlaps included.
Candidates are phrases of two to ``longest`` words seen ``least`` times or more. A cut after the first k words gives
l = f(first part) and r = f(rest) and the score floor(2000000 * a / (l + r)); the lowest cut counts, the smallest k on
ties. A candidate inside a longer one with 100 * f(longer) >= ``share`` * a goes; the best of each language are ranked.

Method: n-grams are exploded into rows (lang, phrase, words) and hash-aggregated for each language, shortest first. A phrase
seen ``least`` times has only parts seen as often, so of longer n-grams only those are exploded whose parts one word
shorter may be that frequent: that leaves out only n-grams which can't be candidates, and the counts that are joined later. What may be
frequent is a bitmap of hashes of the frequent phrases one level down: a collision lets an n-gram through, never keeps one back, and
its size is bounded (``BITS``), so beyond it the pruning gets weaker and the result stays the same. A task counts
equal n-grams of a batch before they become rows. Prefix and suffix counts are joined to candidates, scores are
divided in Decimal without rounding, the one-word extensions are looked up by an anti-join (an extension by two words implies
one by one word, as counts can only fall), and ranks come from a window over the best of each salted share of a language.

Edge cases: null text counts as empty; a null language is ``und``; an empty table or language gives no rows; repeated rows
count each; texts are read whole; other columns are ignored; equal scores are ordered by a descending, then by phrase.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, releasing, ship_package, table

LEAST, LONGEST, SHARE, BEST = 30, 4, 80, 2000
#: Bits of the map of frequent phrases (8 MB), whatever their number.
BITS = 1 << 26
#: Words of a batch that are counted together; bounds a task's memory.
WORDS = 1_000_000
#: Shares into which a language's candidates are dealt before the best are ranked.
SALTS = 64
#: Bytes as they are counted: letters lower-cased, cuts as a byte that no UTF-8 text has.
CUT = b"\xff"
AS_COUNTED = bytes(b + 32 if 65 <= b <= 90 else 0xFF if chr(b) in ".,;:!?\n\x0b\x0c\r" else b for b in range(256))
ROWS = "lang string, phrase string, n bigint"
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def bits_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Places in a map of so many bits of 64-bit hashes."""
    mixed = hashes * FACTOR
    return (mixed ^ (mixed >> np.uint64(29))) % np.uint64(bits)


def word_hash(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words that are the same in every task."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def joined_hash(first: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those of their first parts and last words."""
    return (first * np.uint64(0x100000001B3) + np.uint64(7)) ^ (rest * FACTOR)


def in_map(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    spots = bits_of(hashes, 8 * len(bitmap))
    return (bitmap[spots >> np.uint64(3)] >> (spots & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def distinct(columns: list[np.ndarray], base: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of columns of numbers below base, and how often each occurs: rows are packed into a number, by
    way of their numbers among the distinct leading parts where 63 bits don't suffice."""
    key, bound, parts = columns[0], base, [None]
    for c in columns[1:]:
        leading = None
        if bound * base >= 1 << 63:
            leading = np.unique(key)
            key, bound = np.searchsorted(leading, key), len(leading)
        parts.append(leading)
        key, bound = key * base + c, bound * base
    key = np.sort(key)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    seen, key = np.diff(np.append(first, len(key))), key[first]
    out = []
    for leading in reversed(parts[1:]):
        key, c = np.divmod(key, base)
        out.append(c)
        key = key if leading is None else leading[key]
    return [key, *reversed(out)], seen


class Ids(dict):
    """Numbers of words from 1 on, in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Grams:
    """Words of one language in a row, as numbers; a 0 stands between pieces, so no n-gram goes over a cut."""

    def __init__(self):
        self.ids: list[int] = []
        self.known = Ids({CUT: 0})

    def add(self, text: str) -> None:
        self.ids.extend(map(self.known.__getitem__, text.encode().translate(AS_COUNTED).replace(CUT, b" \xff ").split()))
        self.ids.append(0)

    def counts(self, words: int, frequent: np.ndarray | None) -> tuple[pa.Array, np.ndarray]:
        """Phrases of so many words and their counts; if there is a map, only those whose parts one word shorter are both in it."""
        ids, names = np.array(self.ids, np.int64), list(self.known)
        size = len(ids) - words + 1
        if size <= 0:
            return pa.array([], pa.binary()), np.zeros(0, np.int64)
        good = ids > 0
        if frequent is not None:
            hashes = word_hash(names)[ids]
            part = hashes
            for k in range(1, words - 1):
                part, good = joined_hash(part[:-1], hashes[k:]), good[:-1] & (ids[k:] > 0)
            good &= in_map(frequent, part)
            good = good[:size] & good[1 : size + 1]
        at = np.flatnonzero(good)
        columns, seen = distinct([ids[at + k] for k in range(words)], len(names))
        names = pa.array(names, pa.binary())
        return pc.binary_join_element_wise(*[names.take(pa.array(c)) for c in columns], b" "), seen


def exploded(docs: DataFrame, words: int, batch_words: int, frequent=None) -> DataFrame:
    """(lang, phrase, n): the n-grams of docs (lang, text) with their counts, summed up for each batch of words already."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = None if frequent is None else frequent.value
        grams: dict[str, Grams] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, g in grams.items():
                phrases, seen = g.counts(words, bitmap)
                if len(phrases):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases)), phrases.cast(pa.string()), pa.array(seen, pa.int64())], names=["lang", "phrase", "n"])
            grams.clear()

        held = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                g = grams.setdefault(lang, Grams())
                held -= len(g.ids)
                g.add(text.as_py())
                held += len(g.ids)
                if held >= batch_words:
                    yield from out()
                    held = 0
        yield from out()

    return docs.mapInArrow(releasing(run), ROWS)


def counted(docs: DataFrame, words: int, batch_words: int, frequent=None) -> DataFrame:
    """(lang, phrase, words, a): f of the n-grams that may be frequent."""
    return exploded(docs, words, batch_words, frequent).groupBy("lang", "phrase").agg(F.sum("n").alias("a")).withColumn("words", F.lit(words))


def bitmap_of(phrases: DataFrame, n_bits: int) -> np.ndarray:
    """The map of phrases of equally many words: parts made by tasks, put together by their place, n_bits / 8 bytes in all."""
    slices = 64
    size = n_bits // 8 // slices

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(n_bits // 8, np.uint8)
        for batch in batches:
            columns = list(zip(*[phrase.encode().split(b" ") for phrase in batch.column(0).to_pylist()]))
            hashes = [word_hash(c) for c in columns]
            for k in range(1, len(hashes)):
                hashes[0] = joined_hash(hashes[0], hashes[k])
            if hashes:
                spots = bits_of(hashes[0], n_bits)
                np.bitwise_or.at(bits, spots >> np.uint64(3), np.uint8(1) << (spots & np.uint64(7)).astype(np.uint8))
        used = [k for k in range(slices) if bits[k * size : (k + 1) * size].any()]
        if used:
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([bits[k * size : (k + 1) * size].tobytes() for k in used], pa.binary())], names=["k", "bits"])

    def together(key, pdf):
        whole = np.zeros(size, np.uint8)
        for b in pdf["bits"]:
            whole |= np.frombuffer(b, np.uint8)
        return pd.DataFrame({"k": [key[0]], "bits": [whole.tobytes()]})

    done = phrases.mapInArrow(part, "k int, bits binary").groupBy("k").applyInPandas(together, "k int, bits binary").toArrow()
    out = np.zeros(n_bits // 8, np.uint8)
    for k, b in zip(done["k"].to_pylist(), done["bits"].to_pylist()):
        out[k * size : (k + 1) * size] = np.frombuffer(b, np.uint8)
    return out


def frequent_phrases(docs: DataFrame, scratch: Scratch, least: int, longest: int, n_bits: int = BITS, batch_words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, a) of all phrases seen ``least`` times or more, and (lang, n), for docs (lang, text)."""
    spark = docs.sparkSession
    singles = scratch.written(counted(docs, 1, batch_words), "singles")
    totals = singles.groupBy("lang").agg(F.sum("a").alias("n"))
    levels = [singles.filter(F.col("a") >= least)]
    for words in range(2, longest + 1):
        last = levels[-1]
        shared = spark.sparkContext.broadcast(bitmap_of(last.select("phrase"), n_bits))
        levels.append(scratch.written(counted(docs, words, batch_words, shared).filter(F.col("a") >= least), "phrases"))
        shared.unpersist()
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out, totals


def scored(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of the candidates: prefix and suffix counts joined, the lowest cut taken."""
    cuts = phrases.filter("words > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    parts = F.split("phrase", " ")
    cuts = cuts.withColumns({"first": F.array_join(F.slice(parts, F.lit(1), F.col("k")), " "), "rest": F.array_join(F.slice(parts, F.col("k") + 1, F.col("words") - F.col("k")), " ")})
    side = lambda part, n: phrases.select("lang", F.col("phrase").alias(part), F.col("a").alias(n))
    cuts = cuts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"])
    exact = F.expr("(2000000 * CAST(a AS DECIMAL(20, 0))) DIV (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))")
    lowest = F.min(F.struct(exact.cast("long").alias("score"), "k", "l", "r")).alias("cut")
    return cuts.groupBy("lang", "phrase", "words", "a").agg(lowest).select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def outermost(candidates: DataFrame, share: int) -> DataFrame:
    """candidates without those that a phrase one word longer nearly always holds."""
    parts = F.split("phrase", " ")
    longer = candidates.filter("words > 2").select("lang", F.col("a").alias("whole"), F.explode(F.array_distinct(F.array(*[F.array_join(F.slice(parts, F.lit(at), F.col("words") - 1), " ") for at in (1, 2)]))).alias("phrase"))
    most = longer.groupBy("lang", "phrase").agg(F.max("whole").alias("whole"))
    holds = 100 * F.col("whole").cast("decimal(20,0)") >= share * F.col("a").cast("decimal(20,0)")
    gone = candidates.join(most, ["lang", "phrase"]).filter(holds).select("lang", "phrase")
    return candidates.join(gone, ["lang", "phrase"], "left_anti")


def ranked(candidates: DataFrame, best: int) -> DataFrame:
    """The best of each language with their rank; a language's candidates are dealt into shares, so no task gets all of them."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = candidates.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= best)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= best).drop("salt")


def collocations(documents: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, share: int = SHARE, best: int = BEST,
                 n_bits: int = BITS, batch_words: int = WORDS) -> DataFrame:
    """lang, rank, phrase, words, a, l, r, n, score of the best phrases of each language."""
    scratch = Scratch(documents.sparkSession)
    docs = documents.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text")).filter("text is not null")
    phrases, totals = frequent_phrases(docs, scratch, least, longest, n_bits, batch_words)
    candidates = scratch.written(scored(phrases), "candidates")
    out = ranked(outermost(candidates, share), best).join(totals, "lang")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "words", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("text", "lang")).drop("words")


OP13_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM p),
g AS (SELECT lang, k, array_to_string(list_slice(words, i, i + k - 1), ' ') AS phrase FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM w, range(1, 5) t(k) WHERE len(words) >= k)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY lang, k, phrase),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS parts FROM f WHERE k > 1 AND a >= 30),
u AS MATERIALIZED (SELECT lang, phrase, k, a, cut, array_to_string(list_slice(parts, 1, cut), ' ') AS p1, array_to_string(list_slice(parts, cut + 1, k), ' ') AS p2 FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)),
s AS (SELECT u.lang, u.phrase, u.k, u.a, x.a AS l, y.a AS r, cut, CAST(2000000::HUGEINT * u.a // (x.a + y.a) AS BIGINT) AS score FROM u JOIN f x ON x.lang = u.lang AND x.phrase = p1 JOIN f y ON y.lang = u.lang AND y.phrase = p2),
b AS (SELECT lang, phrase, k, a, l, r, score FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS o FROM s) WHERE o = 1),
i AS (SELECT lang, array_to_string(list_slice(parts, first, first + size - 1), ' ') AS inner_phrase, max(a) AS whole
  FROM (SELECT lang, parts, a, k, size, unnest(range(1, k - size + 2)) AS first FROM c, range(2, 4) t(size) WHERE size < k) GROUP BY 1, 2),
o AS (SELECT b.* FROM b LEFT JOIN i ON i.lang = b.lang AND i.inner_phrase = b.phrase WHERE NOT coalesce(100::HUGEINT * whole >= 80::HUGEINT * a, false)),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT q.lang, rank, phrase, a, l, r, n, score FROM q JOIN n ON n.lang = q.lang WHERE rank <= 2000
"""
