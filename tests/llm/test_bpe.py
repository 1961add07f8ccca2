import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import bpe

ODD = ["", " ", "\n\n \t", "a" * 5000, "ab" * 3000, "<|endoftext|> x", "don't I'll", "日本語🙂 ß ﬁ é", " x\x00y", "x" * 70 + " " + "7" * 90]


def test_same_as_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for r in bpe.round_trip(docs).join(docs, "doc_id").collect():
        ids, ids_sha, text_sha = brute.tokens(r["text"])
        assert (r["ids"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (ids, len(ids), ids_sha, text_sha)


def test_merges_of_random_bytes():
    v, rng = bpe.vocabulary(), random.Random(3)
    for alphabet in ("ab", "the ", "étè ", "0123456789", "日本語"):
        for n in (1, 2, 3, 17, 400, 20_000):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            ids = np.frombuffer(v.encode(text), "<u4").tolist()
            assert ids == brute.encoding().encode_ordinary(text)
            assert v.decode(ids) == text.encode()


def test_small_cache_gives_the_same(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 3)
    v = bpe.Vocabulary(__import__("public_tokenizers").path(bpe.VOCABULARY), __import__("public_tokenizers").PATTERN)
    text = "one two three four five six one two three zyzzyva zyzzyva"
    assert np.frombuffer(v.encode(text), "<u4").tolist() == brute.encoding().encode_ordinary(text)


def test_rank_queue_gives_ranks_in_order():
    q, rng = bpe.RankQueue(), random.Random(1)
    ranks = [rng.randrange(50_000) for _ in range(2000)]
    for k, rank in enumerate(ranks):
        q.push(rank, k)
    out = []
    while (head := q.pop_rank()) is not None:
        out += [head[0]] * len(head[1])
    assert out == sorted(ranks)


def test_edges(spark):
    rows = [(k, t, "x") for k, t in enumerate([*ODD, None])] + [(0, "", "x"), (None, "again", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe.round_trip(df)
    assert got.columns == ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = sorted(((i, *(lambda x: (x[0], len(x[0]), *x[1:]))(brute.tokens(t))) for i, t, _ in rows), key=str)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert bpe.round_trip(df.limit(0)).count() == 0
    assert bpe.round_trip(df.withColumnRenamed("doc_id", "a.b"), ids=False).first()["a.b"] is not None
    both = bpe.decode(bpe.encode(df)).select("text", F.decode("decoded", "utf-8").alias("back")).collect()
    assert all((r["text"] or "") == r["back"] for r in both)
    with pytest.raises(Exception, match="KeyError"):
        bpe.decode(spark.createDataFrame([([60_000],)], "ids array<int>")).collect()


def test_pieces_of_batches(spark, monkeypatch):
    rows = [(k, "word " * k) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(bpe, "PIECE_CHARS", 100)
    got = {r["doc_id"]: r["n_tokens"] for r in bpe.round_trip(df, ids=False).collect()}
    assert got == {k: len(brute.encoding().encode_ordinary(t)) for k, t in rows}


def test_workers_forget_the_vocabulary_for_others():
    from tessella.llm import common

    run = common.releasing(lambda batches: iter(batches), "bpe")
    v = bpe.vocabulary()
    common.keeps("bpe", bpe.vocabulary.cache_clear)
    assert list(run(iter([1, 2]))) == [1, 2] and bpe.vocabulary() is v
    assert list(common.releasing(lambda batches: iter(batches))(iter([3]))) == [3]
    assert bpe.vocabulary.cache_info().currsize == 0
