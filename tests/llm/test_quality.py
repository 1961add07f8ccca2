import time

import duckdb
from test_registry import rows

import corpus_pipeline
from tessella.llm import quality

NOTICE = "All rights reserved by the publisher of this page"


def documents():
    own = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    docs = [(k, f"{own(k)}\n  {NOTICE.upper() if k % 2 else NOTICE} \nlast line {k}", "hot") for k in range(40)]  # a line of all documents
    docs += [(100 + k, f"{NOTICE}\nfour more words {k}", "hot") for k in range(30)]  # little else remains
    docs += [(200 + k, f"{own(k)}\n{NOTICE}", f"small{k}") for k in range(5)]
    docs += [(300 + k, f"{own(0)}\nthe same text", "copies") for k in range(50)]  # one document many times
    docs += [(400, None, "hot"), (401, "", "hot"), (402, " \t\n\x0b", None), (403, "few words", None), (404, "a b c d e f " * 40, "x"), (405, own(1) + " #%$ <|>", "x"), (406, "line\nline\n LINE \nline\r\n" + own(2), "x")]
    docs += [(407, "é ü ß \U0001f642 " * 4, "x"), (408, "word " * 30_000, "x"), (409, "\n" * 5000 + own(3), "x"), (410, "q w e r t", "x"), (411, "q w e r t " * 2, "x"), (412, own(4) + " " + own(4)[:30], "x")]
    return docs


def test_sql_on_edges(spark, tmp_path):
    spark.createDataFrame(documents(), "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got, want = quality.op2_quality(spark, str(tmp_path)).toPandas(), con.sql(quality.OP2_SQL).df()
    assert rows(got) == rows(want)
    kept = dict(zip(got["doc_id"], got["kept"]))
    assert all(kept[k] for k in range(40)) and sum(kept[100 + k] for k in range(30)) == 0
    assert all(kept[k] for k in [*range(200, 205), *range(300, 350)])


def test_repeated_words_by_hand(spark):
    texts = {1: "a b c d e a b c d e", 2: "a b c d e f a b c d e f", 3: "x x x x x x", 4: "a b c d e", 5: None}
    df = spark.createDataFrame([(k, t, "s") for k, t in texts.items()], "doc_id long, text string, source string")

    def brute(t):
        w = (t or "").split()
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        return len({i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)})

    assert {r["id"]: r["n_repeat_words"] for r in quality.judge(df).collect()} == {k: brute(t) for k, t in texts.items()}


def test_kept_rows_and_clashing_names(spark):
    rows_in = [(d, t, s, k, "x") for k, (d, t, s) in enumerate(documents())] + [(None, "one two three four five six seven eight nine ten", "n", 7, "y")] * 2
    df = spark.createDataFrame(rows_in, "doc_id long, text string, source string, _doc int, line string")
    verdict = {(r["id"], r["kept"]) for r in quality.judge(df).collect()}
    kept = quality.keep_good(df)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([r for r in rows_in if (r[0], True) in verdict], key=str)
    assert (None, True) in verdict and kept.filter("doc_id is null").count() == 2
    assert quality.judge(df.limit(0)).count() == 0 and quality.keep_good(df.limit(0)).count() == 0


def test_frequent_lines_leave_the_texts(spark):
    rows_in = [(d, t, s, len(t or "") + 1000, "x") for d, t, s in documents()] + [(None, "one two three four five six seven eight nine ten", "n", 7, "y")] * 2
    own = " ".join(f"v{j}" for j in range(100))
    twice = "\n".join([NOTICE, own, "", NOTICE.lower() + "\r", "end"])
    rows_in += [(500, twice, "hot", 1, "x")] * 2
    df = spark.createDataFrame(rows_in, "doc_id long, text string, source string, n_chars int, _doc string")
    kept = {(r["id"], r["kept"]) for r in quality.judge(df).collect()}
    got = quality.clean_good(df, n_chars="n_chars")
    assert got.columns == df.columns and got.schema == df.schema
    want = []
    for d, t, s, n, x in rows_in:
        if (d, True) in kept:
            lines = (t or "").split("\n")
            left = [line for line in lines if d == 0 or s != "hot" or " ".join(line.lower().split()) != NOTICE.lower()]
            want.append((d, t, s, n, x) if left == lines else (d, "\n".join(left), s, len("\n".join(left)), x))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    texts = {r[0]: r[1] for r in want}
    assert NOTICE in texts[0] and NOTICE not in texts[2] and NOTICE in texts[200] and texts[500] == f"{own}\n\nend"
    assert quality.clean_good(df.limit(0)).count() == 0


def test_pipeline_stage_removes_frequent_lines(spark):
    df = spark.createDataFrame([(d, t, s, len(t or "")) for d, t, s in documents()], "doc_id long, text string, source string, n_chars long")
    got = {r["doc_id"]: r for r in corpus_pipeline.quality_rules(spark, df, "").collect()}
    assert NOTICE in got[0]["text"] and all(NOTICE.lower() not in got[k]["text"].lower() and got[k]["n_chars"] == len(got[k]["text"]) for k in range(1, 40))


def test_very_many_removed_lines(spark):
    """Texts of 40,000 lines, every other one frequent, in seconds, and what is left of them."""
    n = 40_000
    text = lambda d: "\n".join(f"own {k} of {d}" if k % 2 else f"frequent {k}" for k in range(n))
    docs = spark.createDataFrame([(d, "h", text(d)) for d in range(22)], "doc_id long, source string, text string").repartition(4)
    began = time.monotonic()
    got = {r["doc_id"]: r["text"].split("\n") for r in quality.clean_good(docs).collect()}
    assert time.monotonic() - began < 60
    assert len(got[0]) == n and all(got[d] == [f"own {k} of {d}" for k in range(1, n, 2)] for d in range(1, 22))
