from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F
from test_registry import rows

from tessella.llm import merkle
from tessella.llm.common import Scratch

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string"


def plain_levels(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        at = levels[-1]
        levels.append([sha256("".join(at[i : i + 2]).encode()).hexdigest() for i in range(0, len(at), 2)])
    return levels


@pytest.mark.parametrize("stacked", [1, 2, 3])
def test_traversal_gives_every_path(stacked):
    for n in [*range(1, 20), 31, 32, 33, 100]:
        leaves = [sha256(str(k).encode()).hexdigest() for k in range(n)]
        levels = plain_levels(leaves)
        got = list(merkle.traverse(leaves, len(levels) - 1, stacked))
        assert {root for _, root in got} == {levels[-1][0]}
        for i, (path, _) in enumerate(got):
            want = []
            for k, level in enumerate(levels[:-1]):
                at = i >> k
                want.append(("<" if at & 1 else ">") + (level[at ^ 1] if at ^ 1 < len(level) else ""))
            assert path == want


def test_a_subtree_is_grown_within_its_steps():
    """Two steps a leaf are enough, and what is kept is bounded by the subtree's size."""
    leaves = [str(k) for k in range(64)]
    for low, high in ((0, 2), (2, 4), (4, 6)):
        g = merkle.Growing(leaves, low, high, 0)
        for _ in range(1 << high):
            g.step(2)
            assert len(g.stack) <= high + 1 and len(g.nodes) < 2 << (high - low)
        assert len(g.stack) == 1


def documents():
    docs = [(k, f"s{k % 3}", "en", k * 7, f"text {k} é\U0001f642\n") for k in range(2500)]
    docs += [(k, None, None, None, None) for k in range(5)] + [(None, "s", "de", 3, "no id"), (7, "s", "de", None, ""), (7, "s", "de", None, ""), (7, "s", "de", 2**40, "-"), (1, "s", "ü", 5, "alone" * 1000)]
    return [(*d, "clash") for d in docs]


def test_sql_on_edges(spark, tmp_path):
    spark.createDataFrame(documents(), SCHEMA).repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = merkle.op11_merkle(spark, str(tmp_path))
    want = con.sql(merkle.OP11_SQL).df()
    assert rows(got.toPandas()) == rows(want)
    assert {r["verified"] for r in got.filter("doc_id is null").collect()} == {True}


def test_small_blocks_make_several_rounds(spark):
    df = spark.range(1000).select("id", F.lit("g").alias("lang"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("leaf"), F.lit(1).alias("pos"))
    out = merkle.manifest(df, "lang", "id", "leaf", Scratch(spark), block=3)
    assert out.columns == ["id", "lang", "pos", "leaf", "path", "subroot", "root"]
    want = plain_levels([sha256(str(k).encode()).hexdigest() for k in range(1000)])[-1][0]
    got = out.select("root", merkle.folded(F.col("leaf"), F.col("path")).alias("f")).collect()
    assert len(got) == 1000 and {r["root"] for r in got} == {want} == {r["f"] for r in got}


def test_one_row_and_none(spark, tmp_path):
    for name, docs in (("one", documents()[:1]), ("none", [])):
        spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = merkle.op11_merkle(spark, f"{tmp_path}/{name}").collect()
        assert len(got) == len(docs)
    one = merkle.op11_merkle(spark, f"{tmp_path}/one").first()
    assert one["leaf"] == one["subroot"] == one["root"] and one["proof_sha256"] == sha256(b"").hexdigest()
