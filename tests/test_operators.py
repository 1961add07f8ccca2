import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.operators import reconcile, retrieval, review, vector
from tessella.plans import registry
from tessella.sources import tables

CASES = {  # required, received, released, missing
    "case": (["HEMOGRAMA COMPLETO", "GLICOSE"], ["hemograma completo", "glicose"], True, []),
    "missing": (["HEMOGRAMA COMPLETO", "GLICOSE"], ["hemograma completo"], False, ["GLICOSE"]),
    "alias": (["HEMOGRAMA COMPLETO", "GLICOSE", "AUDIOMETRIA", "GAMA GT"], ["HEMOGRAMA", "ERITROGRAMA", "GLICOSE", "GAMA GT"], False, ["AUDIOMETRIA"]),
    "empty": ([], ["GLICOSE"], True, []),
    "accents": (["ÁCIDO ÚRICO"], ["ACIDO URICO"], True, []),
    "coverage": (["COLESTEROL TOTAL"], ["COLESTEROL HDL", "COLESTEROL LDL"], True, []),
    "blank": (["X"], ["###"], False, ["X"]),
}


def test_comparison_cases(spark):
    items = lambda side: spark.createDataFrame([(d, i, n) for d, c in CASES.items() for i, n in enumerate(c[side])], "doc_id string, pos int, name string")
    rules = spark.createDataFrame([("COLESTEROL TOTAL", "COLESTEROL HDL"), ("COLESTEROL TOTAL", "COLESTEROL LDL")], "general string, specific string")
    rows = reconcile.compare(items(0), items(1), reconcile.alias_table(spark), rules)
    got = rows.collect()
    docs = spark.createDataFrame([(d,) for d in CASES], "doc_id string")
    verdict = {r["doc_id"]: r for r in reconcile.verdicts(docs, rows).collect()}
    for d, (required, _, released, missing) in CASES.items():
        assert verdict[d]["released"] == released and verdict[d]["required"] == len(required), d
        assert sorted(r["name"] for r in got if r["doc_id"] == d and r["status"] == "faltante") == missing, d
    extra = {(r["doc_id"], r["name"]) for r in got if r["status"] == "extra_no_ocr"}
    assert extra == {("alias", "ERITROGRAMA"), ("empty", "GLICOSE")}
    assert verdict["empty"]["percent"] is None


def test_one_received_item_serves_several(spark):
    a = spark.createDataFrame([(1, 0, "glicemia"), (1, 1, "glicemia de jejum")], "doc_id int, pos int, name string")
    b = spark.createDataFrame([(1, 0, "Glicemia"), (1, 1, "x"), (1, 2, "X!")], "doc_id int, pos int, name string")
    rows = reconcile.compare(a, b, reconcile.alias_table(spark), spark.createDataFrame([], "general string, specific string")).collect()
    assert sorted((r["name"], r["status"], r["rule"]) for r in rows if r["side"] == "required") == [("glicemia", "encontrado", "equal"), ("glicemia de jejum", "encontrado", "alias")]
    assert [r["name"] for r in rows if r["side"] == "received"] == ["x"]


def test_nearest(spark):
    index = spark.createDataFrame([(k, [float(k), 0.0]) for k in range(6)] + [(9, [1.0, 0.0])], "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([(100, [1.0, 0.0])], "query_id long, embedding array<float>")
    got = [(r["vec_id"], r["dist2"], r["rank"]) for r in vector.nearest(queries, index, 2, 3).orderBy("rank").collect()]
    assert got == [(1, 0.0, 1), (9, 0.0, 2), (0, 1.0, 3)]
    many = vector.nearest(index.select(F.col("vec_id").alias("query_id"), "embedding"), index, 2, 20, block=2)
    assert many.count() == 49
    exact = spark.createDataFrame([(1, 1.5), (2, 1.4)], "vec_id long, dist2 double")
    assert [r["vec_id"] for r in vector.within(exact).collect()] == [2]
    with pytest.raises(Exception, match="hasn't 3 numbers"):
        vector.nearest(queries, index, 3).collect()


def test_pages_and_buttons(spark):
    df = spark.range(61)
    assert [r["id"] for r in review.page_of(df, [F.asc("id")], 7).collect()] == [60]
    assert review.page_count(df).first()["pages"] == 7 and review.page_count(df.limit(0)).first()["pages"] == 0
    assert review.page_buttons(1, 7) == [1, 2, 3, 4, 5] and review.page_buttons(7, 7) == [3, 4, 5, 6, 7] and review.page_buttons(1, 2) == [1, 2]


def test_messages(spark):
    history = F.array(F.struct(F.lit("user").alias("role"), F.lit("a").alias("content")), F.struct(F.lit("tool").alias("role"), F.lit("b").alias("content")))
    row = spark.range(1).select(retrieval.message_list("s", F.lit(""), history, F.lit("q")).alias("m")).first()
    assert [tuple(m) for m in row["m"]] == [("system", "s"), ("user", "a"), ("user", "q")]


def test_sources(spark, tmp_path):
    (tmp_path / "s.csv").write_text('Exame,Similares\n2.5 hexanodiona,"2,5-hexanodiona"\n')
    assert [tuple(r) for r in tables.read_synonyms(spark, str(tmp_path / "s.csv")).collect()] == [("2.5 hexanodiona", "2,5-hexanodiona")]
    (tmp_path / "f.tsv").write_text('Pergunta\tResposta Padrão\nq\t"a\n\nb"\n')
    assert tables.read_faq(spark, str(tmp_path / "f.tsv")).first()["resposta"] == "a\n\nb"
    (tmp_path / "u").mkdir()
    (tmp_path / "u/x.txt").write_text("line 1\nline 2")
    assert tables.read_pages(spark, str(tmp_path / "u")).first()["text"] == "line 1\nline 2"
    assert tables.read_uploads(spark, str(tmp_path / "u")).select("name", "size").first()["size"] == 13
    tables.write_audit(spark.createDataFrame([("00000000001", ["A"])], "cpf string, sent array<string>"), str(tmp_path / "audit"), "cpf")
    audit = spark.read.json(str(tmp_path / "audit"))
    assert "cpf" not in audit.columns and len(audit.first()["id_hash"]) == 64
    tables.write_export(spark.createDataFrame([('a "b"', None)], "x string, y string"), str(tmp_path / "out"))
    assert '"a ""b"""' in "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))


def test_event_lines(spark):
    lines = spark.createDataFrame([('data: {"doc_id": "d", "seq": 1, "progress": 10}',), ("data: {broken",), (": comment",), ("",)], "value string")
    assert [(r["doc_id"], r["progress"]) for r in tables.event_lines(lines).collect()] == [("d", 10)]


def test_sinks_come_back(spark, tmp_path):
    from tessella.sources import tables

    rows = spark.createDataFrame([("g1", "one\ntwo", [0.5, 1.0], "{}"), ("g2", "three", [2.0, 0.0], None)], "k string, t string, e array<double>, meta string")
    tables.write_lists(rows.select("k", "e"), str(tmp_path / "lists"))
    assert {tuple(r["e"]) for r in spark.read.json(str(tmp_path / "lists")).collect()} == {(0.5, 1.0), (2.0, 0.0)}
    tables.write_page_texts(rows, str(tmp_path / "pages"), "t", "k")
    assert {(r["path"].rsplit("/", 2)[-2], r["text"].strip()) for r in tables.read_pages(spark, str(tmp_path / "pages")).collect()} == {("k=g1", "one\ntwo"), ("k=g2", "three")}
    tables.write_markdown(rows, str(tmp_path / "md"), "k", "t")
    assert spark.read.parquet(str(tmp_path / "md")).count() == 2
    tables.write_markdown(rows, str(tmp_path / "none"), "k", "t", wanted=False)
    assert not (tmp_path / "none").exists()
    tables.write_vectors(rows.select(F.lit(1).alias("vec_id"), F.col("e").alias("embedding"), "meta"), str(tmp_path / "v"))
    assert tables.read_vectors(spark, str(tmp_path / "v")).schema.simpleString() == "struct<vec_id:bigint,embedding:array<float>,meta:string>"


def test_embedding_is_retried_and_asked_once_a_text(spark, tmp_path):
    from tessella.operators import vector

    log = str(tmp_path / "calls")

    def embed(texts):
        with open(log, "a") as f:
            f.write("".join(f"{t}\n" for t in texts))
        if sum(1 for _ in open(log)) < 4:
            raise OSError("not yet")
        return [[float(len(t))] for t in texts]

    df = spark.createDataFrame([("aa",), ("b",), ("aa",), (None,)], "name string")
    got = vector.embedded(df.coalesce(1), "name", embed, wait=0.01).collect()
    assert sorted(((r["name"], r["embedding"]) for r in got), key=str) == [("aa", [2.0]), ("aa", [2.0]), ("b", [1.0]), (None, None)]

    def never(texts):
        raise OSError("down")

    assert {r["embedding"] for r in vector.embedded(df, "name", never, wait=0.01).collect()} == {None}


def test_updates_to_null_and_blank_searches(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    changes = spark.createDataFrame([(1, None)], "k int, v string")
    values = lambda **o: {r["k"]: r["v"] for r in review.updated(df, changes, "k", ["v"], **o).collect()}
    assert values() == {1: "a", 2: None} and values(nulls=True) == {1: None, 2: None}
    assert df.filter(review.text_filter("v", " ")).count() == 2


def test_mean_of_exactly_one_half_rounds_up(spark):
    """Added as doubles, each of the first three is below its half in every order."""
    groups = {
        1: ([33.91, 18.52, 72.07], 42), 2: ([35.05, 64.57, 18.88], 40), 3: ([-69.46, -33.05, -21.99, None], -41), 4: ([49.49999999999999], 49), 5: ([49.499999999, 49.5], 49), 6: ([None], None),
        7: ([-0.5], 0), 8: ([-0.51], -1), 9: ([1e15, 1e15 + 2], 10**15 + 1), 10: ([2.5, 1 / 3], 1), 11: ([0.0], 0),
    }
    df = spark.createDataFrame([(k, v) for k, (values, _) in groups.items() for v in values], "k int, p double").repartition(3)
    assert {r["k"]: r["progress"] for r in review.mean_progress(df, "p", ["k"]).collect()} == {k: want for k, (_, want) in groups.items()}


def test_mean_progress_adds_in_order_as_its_sql_does(spark, tmp_path):
    """Users whose mean is a half, in exact numbers: the query is its SQL, which one thread of DuckDB reads in the order of the events, however the files are cut."""
    draw, rows = random.Random(3), []
    for user in [None, *range(200)]:
        values = [draw.randrange(0, 12000) for _ in range(draw.choice((2, 6, 20, 66)))]
        n = len(values) + 1
        last = next((v for v in range(10001) if (2 * (sum(min(x, 10000) for x in values) + v)) % (200 * n) == 100 * n), 50)
        rows += [(user, v / 100) for v in [*values, last]]
    rows += [(900, None), (901, 33.91), (901, 18.52), (901, 72.07), (902, -0.5), (903, -1e15), (903, 0.5)]
    draw.shuffle(rows)
    pd.DataFrame([(i, u, v) for i, (u, v) in enumerate(rows)], columns=["event_id", "user_id", "value"]).astype({"user_id": "Int64"}).to_parquet(tmp_path / "in_order.parquet")
    spark.read.parquet(str(tmp_path / "in_order.parquet")).repartition(5, F.hash("event_id")).write.parquet(str(tmp_path / "events.parquet"))
    duck = duckdb.connect(config={"threads": 1})
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/in_order.parquet'")
    want = dict(duck.sql(registry.ORACLE_SQL["avg_progress_round"]).fetchall())
    exact = {r["user_id"]: r["progress"] for r in review.mean_progress(spark.read.parquet(str(tmp_path / "in_order.parquet")).withColumn("p", F.least("value", F.lit(100.0))), "p", ["user_id"]).collect()}
    got = [tuple(r) for r in registry.avg_progress_round(spark, str(tmp_path)).select("user_id", "progress").collect()]
    assert dict(got) == want and len(got) == len(want)
    assert want[901] == 41 and sum(want[u] != exact[u] for u in want) > 20
