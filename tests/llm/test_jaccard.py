import random

import brute
import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import jaccard, shingles
from tessella.llm.components import components


def compare(spark, docs):
    got = jaccard.near_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    return sorted(((r["id"], r["n_shingles"], r["component_id"]) for r in got.collect()), key=str), brute.near_components(docs)


def varied(rng: random.Random, words: list[str], changes: int) -> list[str]:
    out = list(words)
    for _ in range(changes):
        k = rng.randrange(len(out) + 1)
        roll = rng.random()
        if roll < 0.4 and k < len(out):
            out[k] = f"w{rng.randrange(60)}"
        elif roll < 0.7 and k < len(out):
            del out[k]
        else:
            out.insert(k, f"w{rng.randrange(60)}")
    return out


@pytest.mark.parametrize("seed", range(3))
def test_brute_force(spark, seed):
    rng, docs = random.Random(seed), []
    for family in range(9):
        base = [f"w{rng.randrange(60)}" for _ in range(rng.choice((3, 4, 5, 6, 9, 30, 90, 200)))]
        for _ in range(rng.choice((1, 2, 5, 14))):
            docs.append((len(docs), " ".join(varied(rng, base, rng.choice((0, 0, 1, 2, 4, 9))))))
    common = " ".join(f"c{k}" for k in range(40))
    docs += [(len(docs) + k, f"{common} " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(20))) for k in range(25)]  # a passage that many share
    rng.shuffle(docs)
    got, want = compare(spark, docs)
    assert got == want


def test_chain_of_links(spark):
    """Each document is similar to the next only: one component over many links."""
    words = [f"k{k}" for k in range(400)]
    docs = [(k, " ".join(words[3 * k : 3 * k + 60])) for k in range(60)]
    got, want = compare(spark, docs)
    assert got == want and {c for *_, c in got} == {0}


def test_edges(spark):
    docs = [(5, None), (6, ""), (7, " \t\n"), (8, "a b"), (9, "A  B\n"), (10, "a b c"), (11, "a b c d e"), (12, "a b c d e"), (12, "a b c d e"), (13, "É e x y z"), (14, "é e x y z"), (15, "word " * 5000), (16, "word " * 9)]
    got, want = compare(spark, docs)
    assert got == want
    odd = spark.createDataFrame([(None, "p q r s t", 1, "x"), (3, "p q r s t", 2, "y"), (3, "p q r s t", 2, "y")], "doc_id long, text string, node int, th string")
    assert sorted(((r["id"], r["component_id"]) for r in jaccard.near_components(odd).collect()), key=str) == [(3, 3), (3, 3), (None, 3)]
    assert jaccard.near_components(odd.limit(0)).count() == 0
    named = spark.createDataFrame([("b", "p q r s t"), ("a", "p q r s t")], "doc_id string, text string")
    assert {tuple(r) for r in jaccard.near_components(named).collect()} == {("a", 1, "a"), ("b", 1, "a")}


def test_one_of_each(spark):
    rows = [(2, "p q r s t", "x", 1), (1, "p q r s t", "y", 2), (3, None, "z", 3), (4, None, "z", 3), (None, "p q r s t", "n", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id string, component_id int")
    got = jaccard.one_of_each(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[1], rows[2], rows[3], rows[4]], key=str)


def test_all_links_at_the_limit():
    """Sets of 5 and 4 tokens, four shared: exactly 0.8."""
    a, b = np.arange(5, dtype=np.uint64), np.arange(4, dtype=np.uint64)
    assert jaccard.similar(a, b, 80) and not jaccard.similar(a, b, 81)


def test_shingles_follow_words():
    texts = ["one Two three four five six", "", None, "x", "a b c d e " * 3, "ＦＵＬＬ wide é\tÀ b c"]
    got = dict(shingles.shingle_sets(pa.array(texts)))
    assert [len(got.get(k, ())) for k in range(len(texts))] == [len(brute.shingles(t)) for t in texts]


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(1000 + k, 1001 + k) for k in range(120)] + [(2, 2)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "x long, y long")).collect()}
    root = {n: n for link in links for n in link}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for x, y in links:
        root[top(x)] = top(y)
    groups = lambda f, nodes: {frozenset(m for m in nodes if f(m) == f(n)) for n in nodes}
    assert groups(got.get, list(got)) == groups(top, list(got))
    assert set(got) >= {n for x, y in links if x != y for n in (x, y)}


@pytest.mark.parametrize("few, rounds", [(2, 3), (2, 0), (4, 1)])
def test_long_lists_are_split(spark, monkeypatch, few, rounds):
    """Large groups around the limit, of several sizes, so that lists are long, leaders miss members, and pairs meet again outside the leader."""
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "ROUNDS", rounds)
    monkeypatch.setattr(jaccard, "MEMBERS", 7)
    rng, docs = random.Random(few * 10 + rounds), []
    for n in (24, 60, 130):
        base = [f"w{n}x{k}" for k in range(n)]
        other = base[: 2 * n // 3] + [f"v{n}x{k}" for k in range(n // 3)]
        for k in range(45):
            words = list(base if k % 3 else other)
            for _ in range(rng.choice((0, 1, 2, 3, n // 20))):
                words[rng.randrange(len(words))] = rng.choice((f"e{rng.randrange(6)}", f"z{rng.randrange(10**6)}"))
            cut = rng.choice((0, 0, 0, n // 8, n // 5))
            docs.append((len(docs), " ".join(words[cut:] if k % 2 else words[: len(words) - cut])))
    rng.shuffle(docs)
    got, want = compare(spark, docs)
    assert got == want and len({c for *_, c in got}) > 3


def test_a_token_in_a_third_of_all_documents(spark):
    common = " ".join(f"c{k}" for k in range(12))
    rng = random.Random(8)
    docs = [(k, f"{common} " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.choice((0, 1, 1, 30))))) for k in range(150)]
    docs += [(1000 + k, " ".join(f"u{rng.randrange(10**6)}" for _ in range(40))) for k in range(300)]
    got, want = compare(spark, docs)
    assert got == want


def test_sets_with_one_equal_hash_stay_apart(spark, monkeypatch):
    """With a first hash of few values, sets go by their second."""
    real = shingles.set_hash
    monkeypatch.setattr(jaccard, "set_hash", lambda found, kind=0: real(found, 1) if kind else real(found) % 5)
    docs = [(k, " ".join(f"w{k % 20}x{j}" for j in range(20 + k % 3))) for k in range(90)]
    monkeypatch.setattr(jaccard, "name_of", lambda found, clashing: real(found, 1) if real(found) % 5 in clashing else real(found) % 5)
    got, want = compare(spark, docs)
    assert got == want
