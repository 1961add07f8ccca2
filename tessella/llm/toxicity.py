"""Toxicity: a bidirectional gated recurrent network with attention pooling over overlapping windows of words.

A text's words are runs of characters other than ASCII white space and punctuation, A to Z lower-cased. A word enters the network
twice: as itself (an embedding, if the training rows have it in ``LEAST_DOCS`` documents, else that of an unknown word) and by its
characters (the mean of the embeddings of its byte trigrams, hashed). Windows of ``WINDOW`` words start every ``STRIDE`` words and at
the last full one, so every word stands in one or two of them, whatever the text's length. A gated recurrent unit runs over
a window in each direction; attention weighs both states of each word, and a logistic unit scores the weighted mean.
A text scores as its highest window.

Training, in numpy: labels are known for texts, not windows. The first passes give each window its text's label, the later ones
train each text's highest window, so what is learnt fits the score's use. The sample is bounded: ``SAMPLE`` labelled texts of
at most ``SAMPLE_WORDS`` words, those of the lowest hashes of doc_id, in the proportion of labels that they have, and never a row
that is held out. Only the network (some hundred kilobytes, bounded by the sample) goes to the tasks, which score all windows
of all texts, batch by batch. Labels, language, source and id are not inputs.

Edge cases: a text without words (or null) scores 0; a null doc_id or a label without one trains nothing; of several labels of an id the
highest counts; without any labelled row the scores are those of an untrained network; repeated rows score alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import releasing, ship_package, table

WINDOW, STRIDE = 24, 12
#: Bounds of the training sample, texts and words of each.
SAMPLE, SAMPLE_WORDS = 6000, 400
LEAST_DOCS, TRIGRAMS = 3, 4096
WIDE, HIDDEN = 8, 8
#: Batches of so many texts: those that train all windows, then those that train the highest ones; small samples are gone through more often.
BATCH, STEPS, TOP_STEPS, RATE, DROPPED = 64, 150, 200, 0.01, 0.3
HELD_OUT, THRESHOLD = 2, 0.3
#: Words whose inputs a task keeps, and windows that it scores at once.
KEPT_WORDS, AT_ONCE = 200_000, 2048
#: Bytes of words; white space and punctuation become blanks.
AS_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(AS_WORDS).split()


def windows_of(n: int) -> np.ndarray:
    """Starts of the windows over n words."""
    last = max(0, n - WINDOW)
    return np.append(np.arange(0, last, STRIDE), last)


def trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of all words, one after the other, and where each word's start; a word has at least one."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    raw = np.frombuffer(b"^" + b"$^".join(words) + b"$", np.uint8).astype(np.int64)
    codes = (raw[:-2] * 961 + raw[1:-1] * 31 + raw[2:]) * 2654435761 % 2**32 % TRIGRAMS
    starts = np.concatenate([[0], np.cumsum(sizes + 2)[:-1]])
    inside = np.ones(len(codes) + 2, bool)
    inside[starts + sizes] = inside[starts + sizes + 1] = False
    return codes[inside[: len(codes)]], np.concatenate([[0], np.cumsum(sizes)[:-1]])


class Network:
    """Parameters and passes of the network. Row 0 of a batch's words is padding, which attention doesn't see."""

    def __init__(self, vocabulary: list[bytes], seed: int = 12):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        self.known = {w: k for k, w in enumerate(vocabulary, 1)}
        self.p = {
            "words": draw(len(vocabulary) + 1, WIDE), "chars": draw(TRIGRAMS, WIDE), "bias": np.zeros(6 * HIDDEN, np.float32), "in": draw(2 * WIDE, 6 * HIDDEN),
            "forth": draw(HIDDEN, 3 * HIDDEN), "back": draw(HIDDEN, 3 * HIDDEN), "look": np.zeros(2 * HIDDEN, np.float32), "out": draw(2 * HIDDEN), "rest": np.zeros(1, np.float32),
        }

    def inputs(self, words: list[bytes], ids: np.ndarray | None = None) -> tuple[np.ndarray, tuple]:
        """Vectors of words, by embedding and characters, and what their gradient needs."""
        ids = np.array([self.known.get(w, 0) for w in words], np.int64) if ids is None else ids
        codes, starts = trigrams(words)
        sizes = np.diff(np.append(starts, len(codes)))[:, None].astype(np.float32)
        chars = np.add.reduceat(self.p["chars"][codes], starts) / sizes
        return np.concatenate([self.p["words"][ids], chars], 1), (ids, codes, sizes)

    def projected(self, x: np.ndarray) -> np.ndarray:
        """What the gates of both directions get from word vectors; row 0 is padding."""
        out = np.empty((len(x) + 1, 6 * HIDDEN), np.float32)
        out[0] = self.p["bias"]
        out[1:] = x @ self.p["in"] + self.p["bias"]
        return out

    def run(self, gates: np.ndarray, at: np.ndarray, which: str, keep: list | None = None) -> np.ndarray:
        """States (steps, windows, hidden) of one direction over rows at (windows, steps) of gates."""
        u, h, half = self.p[which], np.zeros((len(at), HIDDEN), np.float32), np.float32(0.5)
        states = np.empty((at.shape[1], len(at), HIDDEN), np.float32)
        for t in range(at.shape[1]) if which == "forth" else reversed(range(at.shape[1])):
            x, s = gates[at[:, t]], h @ u
            zr = np.tanh((x[:, : 2 * HIDDEN] + s[:, : 2 * HIDDEN]) * half) * half + half
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(x[:, 2 * HIDDEN :] + r * s[:, 2 * HIDDEN :])
            if keep is not None:
                keep.append((t, h, z, r, n, s[:, 2 * HIDDEN :]))
            states[t] = h = n + z * (h - n)
        return states

    def scores(self, gates: np.ndarray, at: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """The logit of each window."""
        forth, back = ([], []) if keep is not None else (None, None)
        h = np.concatenate([self.run(gates[:, : 3 * HIDDEN], at, "forth", forth), self.run(gates[:, 3 * HIDDEN :], at, "back", back)], 2)
        e = np.where(at.T > 0, h @ self.p["look"], np.float32(-1e9))
        a = np.exp(e - e.max(0))
        a /= a.sum(0)
        pooled = np.einsum("tb,tbh->bh", a, h)
        if keep is not None:
            keep.update(h=h, a=a, pooled=pooled, forth=forth, back=back)
        return pooled @ self.p["out"] + self.p["rest"]

    def gradients(self, x: np.ndarray, made: tuple, at: np.ndarray, keep: dict, d: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of all parameters, for those d of the logits."""
        p, g = self.p, {}
        h, a = keep["h"], keep["a"]
        g["out"], g["rest"] = d @ keep["pooled"], d.sum(keepdims=True)
        dpool = d[:, None] * p["out"]
        da = np.einsum("tbh,bh->tb", h, dpool)
        de = np.where(at.T > 0, a * (da - (a * da).sum(0)), 0).astype(np.float32)
        g["look"] = np.einsum("tb,tbh->h", de, h)
        dh = a[:, :, None] * dpool + de[:, :, None] * p["look"]
        dgates = np.zeros((at.shape[1], len(at), 6 * HIDDEN), np.float32)
        for k, which in enumerate(("forth", "back")):
            u, gu, carried = p[which], np.zeros_like(p[which]), np.zeros((len(at), HIDDEN), np.float32)
            for t, before, z, r, n, s in reversed(keep[which]):
                dnew = dh[t, :, k * HIDDEN : (k + 1) * HIDDEN] + carried
                dn = dnew * (1 - z) * (1 - n * n)
                dz, dr = dnew * (before - n) * z * (1 - z), dn * s * r * (1 - r)
                ds = np.concatenate([dz, dr, dn * r], 1)
                dgates[t, :, 3 * HIDDEN * k : 3 * HIDDEN * (k + 1)] = np.concatenate([dz, dr, dn], 1)
                gu += before.T @ ds
                carried = dnew * z + ds @ u.T
            g[which] = gu
        rows, flat = len(x) + 1, dgates.reshape(-1, 6 * HIDDEN)
        dx = np.stack([np.bincount(at.T.ravel(), flat[:, c], rows) for c in range(6 * HIDDEN)], 1).astype(np.float32)
        g["bias"], g["in"] = dx.sum(0), x.T @ dx[1:]
        dv = dx[1:] @ p["in"].T
        ids, codes, sizes = made
        dc = np.repeat(dv[:, WIDE:] / sizes, sizes[:, 0].astype(np.int64), 0)
        g["words"] = np.stack([np.bincount(ids, dv[:, c], len(p["words"])) for c in range(WIDE)], 1)
        g["chars"] = np.stack([np.bincount(codes, dc[:, c], TRIGRAMS) for c in range(WIDE)], 1)
        return g


def laid_out(texts: list[list[bytes]], rows: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of texts that have words, as row numbers of their words (0 where a text is shorter), and the text of each."""
    flat = np.fromiter((rows[w] for t in texts for w in t), np.int64)
    ends = np.cumsum([len(t) for t in texts])
    starts = [windows_of(len(t)) for t in texts]
    of = np.repeat(np.arange(len(texts)), [len(s) for s in starts])
    first = np.concatenate(starts) + (ends - [len(t) for t in texts])[of]
    at = first[:, None] + np.arange(WINDOW)
    return np.where(at < ends[of][:, None], np.append(flat, 0)[np.minimum(at, len(flat))], 0), of


def fit(texts: list[str], toxic: list[int], seed: int = 12) -> Network:
    """A network trained on texts and their labels, by Adam."""
    split = [words_of(t) for t in texts]
    seen: dict[bytes, int] = {}
    for t in split:
        for w in set(t):
            seen[w] = seen.get(w, 0) + 1
    net = Network(sorted(w for w, n in seen.items() if n >= LEAST_DOCS), seed)
    rng = np.random.default_rng(seed)
    docs, y = [k for k, t in enumerate(split) if t], np.array(toxic, np.float32)
    net.p["rest"][0] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    mean, square = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    turn = STEPS + TOP_STEPS if not docs else 0
    while turn < STEPS + TOP_STEPS:
        order = rng.permutation(docs)
        for batch in (order[k : k + BATCH] for k in range(0, len(order), BATCH)):
            words = sorted({w for k in batch for w in split[k]})
            at, of = laid_out([split[k] for k in batch], {w: k for k, w in enumerate(words, 1)})
            ids = np.array([net.known.get(w, 0) for w in words], np.int64) * (rng.random(len(words)) >= DROPPED)
            x, made = net.inputs(words, ids)
            gates, keep = net.projected(x), {}
            weight = 1.0 / np.bincount(of)[of]
            if turn >= STEPS:  # only each text's highest window
                by = np.lexsort((net.scores(gates, at), of))
                top = by[np.append(np.diff(of[by]) > 0, True)]
                at, of, weight = at[top], of[top], np.ones(len(top))
            logits = net.scores(gates, at, keep)
            d = ((1 / (1 + np.exp(-logits)) - y[batch][of]) * weight / weight.sum()).astype(np.float32)
            turn += 1
            rate = RATE * max(0.1, 1 - 0.9 * turn / (STEPS + TOP_STEPS))
            for k, g in net.gradients(x, made, at, keep, d).items():
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                net.p[k] = (net.p[k] * (1 - 1e-4) - rate * (mean[k] / (1 - 0.9**turn)) / (np.sqrt(square[k] / (1 - 0.99**turn)) + 1e-8)).astype(np.float32)
    return net


class Scorer:
    """Scores texts in batches; keeps the gates' inputs of words that it has met, up to a number."""

    def __init__(self, net: Network):
        self.net = net
        self._forget()

    def _forget(self) -> None:
        self.rows, self.gates = {}, self.net.projected(np.zeros((0, 2 * WIDE), np.float32))

    def __call__(self, texts: list[str]) -> np.ndarray:
        split = [words_of(t) for t in texts]
        some = [k for k, t in enumerate(split) if t]
        out = np.zeros(len(texts))
        if not some:
            return out
        if len(self.rows) > KEPT_WORDS:
            self._forget()
        new = list({w for t in split for w in t} - self.rows.keys())
        if new:
            self.rows.update((w, k) for k, w in enumerate(new, len(self.gates)))
            self.gates = np.concatenate([self.gates, self.net.projected(self.net.inputs(new)[0])[1:]])
        at, of = laid_out([split[k] for k in some], self.rows)
        logits = np.concatenate([self.net.scores(self.gates, at[k : k + AT_ONCE]) for k in range(0, len(at), AT_ONCE)])
        highest = np.maximum.reduceat(logits, np.append(0, np.flatnonzero(np.diff(of)) + 1))
        out[some] = 1 / (1 + np.exp(-highest.astype(float)))
        return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def sample(documents: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[list[str], list[int]]:
    """Texts and labels of the bounded training sample; documents (doc_id, text), labels (doc_id, toxic)."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    few = known.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(4 * most)
    rows = documents.filter("text is not null").join(F.broadcast(few), "doc_id").filter(F.size(F.split("text", r"[\s\p{Punct}]+")) <= SAMPLE_WORDS)
    got = rows.orderBy("h", "doc_id", "text").limit(most).select("text", F.col("toxic").cast("int").alias("toxic")).toArrow()
    return got["text"].to_pylist(), [int(y > 0) for y in got["toxic"].to_pylist()]


def scored(documents: DataFrame, net: Network, text: str = "text", out: str = "score") -> DataFrame:
    """documents with out, the score of each whole text."""
    ship_package(documents.sparkSession)
    place = documents.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net)
        for batch in batches:
            texts, found, k = batch.column(place), [], 0
            while k < len(texts):  # as many texts at once as have some hundred thousand characters
                some, held = [], 0
                while k < len(texts) and held < 400_000:
                    some.append(texts[k].as_py() or "")
                    held, k = held + len(some[-1]), k + 1
                found.append(scorer(some))
            columns = [c for j, c in enumerate(batch.columns) if j != place]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(found) if found else [], pa.float64())], names=names)

    others = [f for f in documents.schema if f.name != text]
    names = [f.name for f in others] + [out]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in others] + [f"`{out}` double"])
    return documents.mapInArrow(releasing(run), schema)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    net = fit(*sample(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))
    return scored(docs, net).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
