import base64
import random
import time

import brute
from pyspark.sql import functions as F

from tessella.llm import secret_scan

RNG = random.Random(4)
TEXTS = [
    "", "password = hunter22 and Passwd:'abc' token=\"x1y2z3\"", "api_key=abcdef apikey: ghijkl API_KEY:mnopqr", "x" * 30 + "AKIA" + "Z9" * 10 + " AKIASHORT", "deadbeef" * 3 + " " + "0" * 23, "secret secret=token=abcdef",
    "see " + base64.b64encode(RNG.randbytes(30)).decode() + " there", "key " + "".join(RNG.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(40)), "A" + RNG.randbytes(20).hex().upper(), "this-is-a-long-name-of-2-words-and-more", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "a1" * 40, "1234567890123456789012", " password=abcdefgh ", "🙂é password=abcdefgh", "none\nat all", "token" + " " * 50 + "=" + " " * 50 + "abcdef", "İ TOKEN: abcdef ſecret=abcdef", "/usr/lib/python3/dist-packages/some_module", "https://example.com/Path/To/2024/some-long-title-here",
]


def scanned(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: [tuple(s) for s in r["secrets"]] for r in secret_scan.scan(df).select("doc_id", "secrets").collect()}


def test_brute_force(spark):
    rng = random.Random(9)
    mixed = [" ".join(rng.choice((base64.b64encode(rng.randbytes(rng.randint(10, 60))).decode(), "word", rng.randbytes(14).hex(), "name_of_a_thing_2_be_long", "pa55word=" + "q" * rng.randint(3, 9), "token: " + "z9" * rng.randint(2, 5))) for _ in range(8)) for _ in range(40)]
    texts = [*TEXTS, None, *mixed]
    got = scanned(spark, texts)
    for k, t in enumerate(texts):
        assert got[k] == brute.secrets(t), t


def test_given_table(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = secret_scan.op6_secrets(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r)[1:] == brute.secret_row(texts[r["doc_id"]])


def test_parts_of_a_run_beside_base_spans(spark):
    rng = random.Random(21)
    key = lambda n: base64.b64encode(rng.randbytes(n)).decode().rstrip("=").replace("+", "K").replace("/", "Q")
    texts = [f"{key(24)}Z{rng.randbytes(14).hex()}G{key(30)}", f"a {key(18)} AKIA{'B7' * 9}/{key(33)}", "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") for _ in range(24)), "".join(rng.choice("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(17))]
    got = scanned(spark, texts)
    assert [got[k] for k in range(4)] == [brute.secrets(t) for t in texts]
    assert [sum(r == 3 for _, r, _ in got[k]) for k in range(4)] == [2, 2, 1, 1]


def test_very_long_texts(spark):
    """A run of a million characters, 200,000 words with a key among them, and 20,000 secrets: seconds each, and covered whole."""
    rng = random.Random(3)
    run = base64.b64encode(rng.randbytes(750_000)).decode()
    words = " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(200_000))
    key = rng.randbytes(16).hex()
    many = "\n".join(f"token={k:08d}" for k in range(20_000))
    df = spark.createDataFrame([(0, f"see {run} end"), (1, f"{words} {key} {words[:50]}"), (2, many)], "doc_id long, text string").repartition(3)
    began = time.monotonic()
    got = {r["doc_id"]: r["secrets"] for r in secret_scan.scan(df).collect()}
    assert [tuple(s) for s in got[0]] == [(4, 3, 4 + len(run))]
    assert [tuple(s) for s in got[1]] == [(len(words) + 1, 2, len(words) + 33)]
    assert [tuple(s) for s in got[2]] == [(15 * k, 0, 15 * k + 14) for k in range(20_000)]
    covered = {r["doc_id"]: r["text"] for r in secret_scan.without_secrets(df).collect()}
    assert covered == {0: "see [SECRET] end", 1: f"{words} [SECRET] {words[:50]}", 2: "\n".join(["[SECRET]"] * 20_000)}
    assert time.monotonic() - began < 120


def test_random_strings_are_found_and_words_are_not(spark):
    rng = random.Random(12)
    strings = [base64.b64encode(rng.randbytes(n)).decode() for n in (24, 30, 36, 48) for _ in range(25)]
    words = ["-".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(5)) + str(rng.randrange(100)) for _ in range(200)]
    got = scanned(spark, [f"id {s} end" for s in strings + words])
    assert sum(bool(got[k]) for k in range(len(strings))) >= 0.9 * len(strings)
    assert sum(bool(got[len(strings) + k]) for k in range(len(words))) <= 2


def test_edges(spark):
    df = spark.createDataFrame([(1, "password=abcdefgh.", 18, "a", 1), (1, "password=abcdefgh.", 18, "a", 1), (None, None, None, None, 2), (3, "plain", 99, "b", 3)], "doc_id long, text string, n_chars long, _t string, _secrets int")
    got = secret_scan.without_secrets(df, n_chars="n_chars")
    assert got.columns == df.columns and got.schema == df.schema
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "[SECRET]", 8, "a", 1), (1, "[SECRET]", 8, "a", 1), (3, "plain", 99, "b", 3), (None, None, None, None, 2)]
    assert secret_scan.without_secrets(df.limit(0)).count() == 0
    assert secret_scan.scan(df).columns == [*df.columns, "secrets"]


def test_redaction(spark):
    texts = [*TEXTS, "password=abcdef" + "ab" * 20 + " tail", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r["x"] for r in secret_scan.without_secrets(df.withColumn("was", F.col("text"))).select(F.struct("was", "text").alias("x")).collect()]
    assert {tuple(x) for x in got} == {(t, brute.covered(t)) for t in texts}


def test_short_keys(spark):
    """Of random keys of 10 to 15 characters nine in ten are found at least; of names and words of these lengths one, whose case changes four times."""
    rng = random.Random(8)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    keys = [(n, "".join(rng.choice(letters) for _ in range(n))) for n in range(10, 16) for _ in range(100)]
    names = "iPhone15ProMax covid-19-test 2024-01-01T00 McDonalds2024 JavaScript3 some_name_2 section-12-4 Windows11Pro order2024-117 getElementById en/articles/42 page_title_x2 chapter10part2 PowerPoint2019".split()
    got = scanned(spark, [f"the {k} is here" for _, k in keys] + [f"the {n} is here" for n in names])
    for size in range(10, 16):
        assert sum(bool(got[k]) for k, (n, _) in enumerate(keys) if n == size) >= 90, size
    assert [n for k, n in enumerate(names) if got[len(keys) + k]] == ["iPhone15ProMax"]
