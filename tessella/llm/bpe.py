"""Byte-level BPE encoding and decoding.

Text is cut by the vocabulary's pattern into pre-tokens. A pre-token that is a vocabulary entry is its own id;
any other is merged by a rank queue: a bucket for each merge rank holds positions of a linked list of parts, a
two-level bitmap over the ranks gives the lowest rank in use by find-first-set, and entries whose pair has
changed meanwhile are skipped. Long pre-tokens are merged one at a time, a few word operations a merge whatever their
length; all short ones of a piece of text stand in one linked list with breaks between them, so that one queue serves
them all and a bucket's positions are merged together.

Edge cases: null text counts as empty and has no ids; control strings such as ``<|endoftext|>`` are ordinary
text; whole texts are encoded whatever their length; ids outside the vocabulary raise KeyError when decoded.
Other columns pass through unchanged, whatever their names; an output name that clashes with one of them replaces it.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import keeps, releasing, ship_package, table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: A worker keeps up to twice so many pre-tokens with their ids, those in use lately, from task to task.
CACHE_ENTRIES = 40_000
#: Pre-tokens of up to so many bytes are merged together.
SHORT = 64
#: Characters of text that are encoded, and whose ids are passed on, at once; a longer text alone is one piece.
PIECE_CHARS = 500_000


class RankQueue:
    """Items by merge rank, in buckets under a two-level bitmap: ``words`` has a bit for each rank in use, WORD bits
    to a word, and ``top`` a bit for each word in use; the lowest bit set in each gives the lowest rank."""

    WORD = 8  # bits of a rank that a word spans: 2**8

    def __init__(self):
        self.top, self.words, self.buckets = 0, {}, {}

    def push(self, rank: int, item) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(item)
            return
        self.buckets[rank] = [item]
        word, bit = rank >> self.WORD, 1 << (rank & 255)
        was = self.words.get(word, 0)
        self.words[word] = was | bit
        if not was:
            self.top |= 1 << word

    def pop_rank(self) -> tuple[int, list] | None:
        """The lowest rank in use and its items; they leave the queue."""
        top = self.top
        if not top:
            return None
        word = (top & -top).bit_length() - 1
        bits = self.words[word]
        low = bits & -bits
        self.words[word] = bits ^ low
        if bits == low:
            self.top = top & (top - 1)
        rank = word << self.WORD | low.bit_length() - 1
        return rank, self.buckets.pop(rank)


class Vocabulary:
    """Ids of texts, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.bytes_of = {b: a for a, b in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.pattern = regex.compile(pattern)
        self.lately: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        # every way to put an entry together from two, as one number, and the entry's rank
        rank_of, pairs = self.ranks.get, []
        for entry, rank in self.ranks.items():
            for k in range(1, len(entry)):
                left, right = rank_of(entry[:k]), rank_of(entry[k:])
                if left is not None and right is not None:
                    pairs.append((left << 20 | right, rank))
        pairs.sort()
        self.pair_keys, self.pair_ranks = (np.array(c, np.int64) for c in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
        self.byte_ids = np.array([self.ranks.get(bytes([b]), self.NONE) for b in range(256)], np.int64)

    #: Id of a break between pre-tokens: no pair has it.
    NONE = (1 << 20) - 1

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, or -1."""
        if not len(self.pair_keys):
            return np.full(len(left), -1)
        keys = left << 20 | right
        at = np.minimum(self.pair_keys.searchsorted(keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)

    def merge_short(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece: all pieces stand in one linked list with a break before each, and one queue serves them."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        starts = np.cumsum(sizes + 1) - sizes  # of each piece, after its break
        n = int(sizes.sum()) + len(pieces)
        ids = np.full(n + 1, self.NONE)
        inside = np.ones(n, bool)
        inside[starts - 1] = False
        ids[:n][inside] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.cumsum(~inside)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        pair = np.append(self.pair_rank(ids[:n], ids[1:]), -1)
        alive = np.append(inside, False)
        queue = RankQueue()

        def push(ranks: np.ndarray, positions: np.ndarray) -> None:
            if len(ranks) == 1:
                queue.push(int(ranks[0]), positions)
                return
            order = ranks.argsort(kind="stable")
            ranks, positions = ranks[order], positions[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            low = 0
            for rank, high in zip(ranks[np.append(0, cuts)].tolist(), [*cuts.tolist(), len(ranks)]):
                queue.push(rank, positions[low:high])
                low = high

        first = np.flatnonzero(pair >= 0)
        if len(first):
            push(pair[first], first)
        while (head := queue.pop_rank()) is not None:
            rank, bucket = head
            at = bucket[0] if len(bucket) == 1 else np.concatenate(bucket)
            at = at[pair[at] == rank]  # others are stale: the pair was merged or has changed
            if not len(at):
                continue
            if len(at) > 1:  # of each piece the leftmost; what it brings up may have a lower rank and goes first
                at = np.sort(at)
                whose = owner[at]
                again = np.append(False, whose[1:] == whose[:-1])
                if again.any():
                    queue.push(rank, at[again])
                    at = at[~again]
            gone = after[at]
            last = after[gone]
            after[at] = last
            before[last] = at
            alive[gone] = False
            pair[gone] = -1
            ids[at] = rank
            changed = np.concatenate([at, before[at]])
            ranks = self.pair_rank(ids[changed], ids[after[changed]])
            pair[changed] = ranks
            new = ranks >= 0
            if new.any():
                push(ranks[new], changed[new])
        left = np.flatnonzero(alive)
        cuts = (4 * left.searchsorted(np.append(starts, n))).tolist()
        flat = ids[left].astype("<u4").tobytes()
        return [flat[a:b] for a, b in zip(cuts, cuts[1:])]

    def merge_long(self, piece: bytes) -> bytes:
        ranks, n, longest = self.ranks, len(piece), self.longest
        rank_of, queue = ranks.get, RankQueue()
        push = queue.push
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = [rank_of(piece[i : i + 2], -1) for i in range(n - 1)] + [-1]
        for i, rank in enumerate(pair):
            if rank >= 0:
                push(rank, i)
        while (head := queue.pop_rank()) is not None:
            now, bucket = head
            bucket.sort()
            for at, i in enumerate(bucket):
                if pair[i] != now:
                    continue  # stale: the pair was merged or has changed
                j = end[i]
                last = end[i] = end[j]
                pair[j] = -1
                lowest = now
                if last < n:
                    before[last] = i
                    stop = end[last]
                    pair[i] = rank = rank_of(piece[i:stop], -1) if stop - i <= longest else -1
                    if rank >= 0:
                        push(rank, i)
                        lowest = min(lowest, rank)
                else:
                    pair[i] = -1
                if (h := before[i]) >= 0:
                    pair[h] = rank = rank_of(piece[h:last], -1) if last - h <= longest else -1
                    if rank >= 0:
                        push(rank, h)
                        lowest = min(lowest, rank)
                if lowest < now:  # a lower rank came up: it goes first
                    for k in bucket[at + 1 :]:
                        push(now, k)
                    break
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return struct.pack(f"<{len(out)}I", *out)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        found = [self.pattern.findall(t) for t in texts]
        known: dict[str, bytes] = {}
        unseen = []
        for piece in set().union(*found):
            ids = self.lately.get(piece) or self.before.get(piece)
            if ids is not None:
                known[piece] = ids
                continue
            raw = piece.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                known[piece] = whole.to_bytes(4, "little")
            elif len(raw) > SHORT:
                known[piece] = self.merge_long(raw)
            else:
                unseen.append(piece)
        if unseen:
            known.update(zip(unseen, self.merge_short([p.encode() for p in unseen])))
        if len(self.lately) + len(known) > CACHE_ENTRIES:
            self.before, self.lately = self.lately, {}
        room = CACHE_ENTRIES - len(self.lately)
        self.lately.update(kept for kept, _ in zip(((p, x) for p, x in known.items() if len(p) <= SHORT), range(room)))
        return [b"".join(map(known.__getitem__, pieces)) for pieces in found]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def runs(texts: list[str]) -> Iterator[tuple[int, int]]:
    """First and end row of runs of texts of up to PIECE_CHARS characters together."""
    begin, held = 0, 0
    for k, t in enumerate(texts):
        if held and held + len(t) > PIECE_CHARS:
            yield begin, k
            begin, held = k, 0
        held += len(t)
    if begin < len(texts):
        yield begin, len(texts)


@functools.lru_cache(maxsize=4)
def vocabulary(name: str = VOCABULARY, pattern: str | None = None) -> Vocabulary:
    """name: a file of public_tokenizers, or a path."""
    import public_tokenizers

    return Vocabulary(name if "/" in name else public_tokenizers.path(name), pattern or public_tokenizers.PATTERN)


def ids_of(text: Column, name: str = VOCABULARY) -> Column:
    """Ids of a text column as array<int>."""

    ship_package(SparkSession.active())

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        v, plain = vocabulary(name), [t or "" for t in texts]
        return pd.Series([np.frombuffer(x, "<i4") for a, b in runs(plain) for x in v.encode_all(plain[a:b])], dtype=object)

    return encode(text)


def bytes_of(ids: Column, name: str = VOCABULARY) -> Column:
    """Bytes that an array<int> of ids stands for."""

    ship_package(SparkSession.active())

    @F.pandas_udf("binary")
    def decode(column: pd.Series) -> pd.Series:
        v = vocabulary(name)
        return column.map(lambda x: b"" if x is None else v.decode(x))

    return decode(ids)


def encode(df: DataFrame, text: str = "text", out: str = "ids", name: str = VOCABULARY) -> DataFrame:
    return df.withColumn(out, ids_of(F.col(text), name))


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", name: str = VOCABULARY) -> DataFrame:
    """out: the bytes, as binary."""
    return df.withColumn(out, bytes_of(F.col(ids), name))


def round_trip(df: DataFrame, text: str = "text", ids: bool = True, name: str = VOCABULARY) -> DataFrame:
    """The columns of df but text, then ids (array<int>, if wanted), n_tokens, ids_sha256 and decoded_sha256, the digest of the bytes
    that the ids decode to. Rows go on in pieces of up to PIECE_CHARS characters, so a worker holds one batch of texts and one piece of ids."""
    ship_package(df.sparkSession)
    kept = [f for f in df.schema.fields if f.name not in (text, "ids", "n_tokens", "ids_sha256", "decoded_sha256")]
    more = [T.StructField("ids", T.ArrayType(T.IntegerType()))] * ids + [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    schema = T.StructType([*kept, *more])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(name)
        keeps("bpe", vocabulary.cache_clear)
        for batch in batches:
            texts = [t or "" for t in batch.column(len(kept)).to_pylist()]
            for begin, end in runs(texts):
                found = v.encode_all(texts[begin:end])
                decoded = [v.decode(np.frombuffer(x, "<u4").tolist()) for x in found]
                columns = [batch.column(c).slice(begin, end - begin) for c in range(len(kept))]
                ends = np.append(0, np.cumsum([len(x) // 4 for x in found]))
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), "<i4"))))
                digests = [pa.array([hashlib.sha256(x).hexdigest() for x in side], pa.string()) for side in (found, decoded)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(ends), pa.int64()), *digests], names=names)

    return df.select(*[F.col(f"`{f.name}`").alias(f"_{k}") for k, f in enumerate(kept)], F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(releasing(run, "bpe"), schema)


def op3_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), ids=False)
