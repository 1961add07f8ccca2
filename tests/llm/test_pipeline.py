"""The pipeline against the plain versions of its stages, one after the other."""

import brute
import duckdb

import corpus_pipeline
from tessella.llm.quality import OP2_SQL

ITEM = "A train leaves Boston at 60 miles per hour and another train leaves Denver at 45 miles per hour"


def documents(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()
    more = [ITEM + " when do they meet on the way home", "the password = hunter2hunter2 is written in this short note of ours", "the password = hunter2hunter2 is written in this short note of ours", None, ""]
    rows = [tuple(r) for r in given] + [(10_000 + k, t, "en", "made", len(t or "")) for k, t in enumerate(more)]
    return rows


def test_against_plain_stages(spark, tmp_path):
    rows = documents(spark)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    kept = {r[0] for r in con.sql(f"SELECT doc_id FROM ({OP2_SQL}) WHERE kept").fetchall()}
    docs = [r for r in rows if r[0] in kept]
    first = {i for i, _, c in brute.near_components([(r[0], r[1]) for r in docs]) if i == c}
    docs = [r for r in docs if r[0] in first]
    leaks = {d for d, _ in brute.contaminated([(r[0], r[1]) for r in docs], [(1, ITEM)])}
    docs = [r for r in docs if r[0] not in leaks]
    want = {}
    for i, text, lang, source, _ in docs:
        ids, ids_sha, text_sha = brute.tokens(brute.covered(text))
        want[i] = (lang, source, ids, len(ids), ids_sha, text_sha)
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "lang", "source", "ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {r["doc_id"]: tuple(r)[1:] for r in got.collect()} == want
    assert 10_000 in leaks and 10_001 in want and 10_002 not in want


def test_stages_keep_columns(spark, tmp_path):
    rows = documents(spark)[-5:]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _id string")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "secrets", "tokens"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0
