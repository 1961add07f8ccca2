import re
from collections import Counter

import duckdb
import numpy as np
from test_registry import rows

from tessella.llm import collocation

SCHEMA = "lang string, text string, phrase string, n int"


def plain(docs, least, longest=4, share=80, best=2000):
    f, n = Counter(), Counter()
    for lang, text in docs:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang or "und"] += len(words)
            f.update((lang or "und", *words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    held = Counter()
    candidates = {k: a for k, a in f.items() if len(k) > 2 and a >= least}
    for (lang, *w), a in candidates.items():
        for i in range(len(w)):
            for j in range(i + 2, len(w) + 1):
                if j - i < len(w):
                    held[lang, *w[i:j]] = max(held[lang, *w[i:j]], a)
    out = {}
    for (lang, *w), a in candidates.items():
        if 100 * held[lang, *w] >= share * a:
            continue
        score, k = min((2000000 * a // (f[lang, *w[:k]] + f[lang, *w[k:]]), k) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, *w[:k]], f[lang, *w[k:]]))
    return sorted((lang, r, p.decode(), -a, x, y, n[lang], -s) for lang, found in out.items() for r, (s, a, p, x, y) in enumerate(sorted(found)[:best], 1))


def documents():
    rng = np.random.default_rng(5)
    words = ["The", "of", "new", "YORK", "city", "é", "ß", "\U0001f642", "a-b", "x y", "İ"]
    docs = [("en" if k % 3 else None, " ".join(rng.choice(words, 40)) + ", new york city hall. " + "again again again again again\tagain") for k in range(120)]
    return docs + [("de", None), ("de", ""), ("de", " .,\n"), ("fr", "un deux trois"), ("hot", "same words here " * 3000)] + [("copies", "one passage that many documents share; it is whole")] * 80


def test_plain_counts(spark):
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in documents()], SCHEMA).repartition(5)
    for least, best in ((3, 2000), (30, 20)):
        got = collocation.collocations(df, least=least, best=best).drop("words")
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, got.collect())) == plain(documents(), least, best=best)


def test_small_batches_and_a_full_map(spark):
    """Neither how often a task passes on its counts nor collisions in the map change the result."""
    df = spark.createDataFrame(documents(), "lang string, text string")
    want = plain(documents(), 5)
    assert sorted(map(tuple, collocation.collocations(df, least=5, n_bits=512, batch_words=50).drop("words").collect())) == want


def test_sql_on_edges(spark, tmp_path):
    for name, docs in (("some", documents()), ("none", [])):
        spark.createDataFrame([(*d, "x", 1) for d in docs], SCHEMA).repartition(2).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/{name}/documents.parquet/*.parquet'")
        assert rows(collocation.op13_collocations(spark, f"{tmp_path}/{name}").toPandas()) == rows(con.sql(collocation.OP13_SQL).df())
