from datetime import datetime

from pyspark.sql import functions as F

from tessella.functions import documents, text, values

GUIDE = (
    "Nome / Name: PERSON A\tIdentidade / ID Number: X\n4. Exames / Exams:\n4.1 Realizados na própria clínica / Performed at the clinic itself:\n"
    "AUDIOMETRIA TONAL * / PURE TONE AUDIOMETRY *\tCOLESTEROL TOTAL * / TOTAL CHOLESTEROL *\nSUMÁRIO DE URINA (EAS) * / URINALYSIS (UA) *\tGLICEMIA DE JEJUM * / GLUCOSE *\n"
    "Obrigatório * / Mandatory *\n5. Observações importantes / Important notice:\n6. Orientações de preparo para exame / Exam preparation guidelines:\nRealizar higienização com água / Clean with water\n"
)


def one(spark, *columns, **given):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in given.items()])
    row = df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return row[0] if len(columns) == 1 else tuple(row)


def test_guide_page(spark):
    assert one(spark, text.person_name(F.col("p")), text.item_names(F.col("p")), p=GUIDE) == ("PERSON A", ["AUDIOMETRIA TONAL", "COLESTEROL TOTAL", "SUMÁRIO DE URINA (EAS)", "GLICEMIA DE JEJUM"])
    assert one(spark, text.person_name(F.col("p")), text.item_names(F.col("p")), p="no header") == (None, [])


def test_identifiers(spark):
    first = lambda t: one(spark, text.first_identifier(F.col("t")), t=t)
    assert first("CPF: 000.000.000-02\n## HEMOGRAMA") == "00000000002"
    assert first("00000000003 ... CE/00000000004") == "00000000004"
    assert first("nothing 123") is None
    assert one(spark, text.all_identifiers(F.col("t"), F.lit("00000000001")), t="000.000.000-01 00000000002 00000000002") == ["00000000002"]


def test_heading_items(spark):
    items = lambda t: one(spark, text.heading_items(F.col("t")), t=t)
    assert items("# HEMOGRAMA\n## GLICOSE") == ["HEMOGRAMA", "GLICOSE"]
    assert items("GLICOSE - 01/01/2025\n### no\ntext") == ["GLICOSE"]


def test_keys(spark):
    assert one(spark, text.normalize_key(F.col("t")), text.normalize_upper(F.col("t")), t="  Ácido-Úrico!! ") == ("acido urico", "ACIDO-URICO!!")
    assert one(spark, text.normalize_key(F.col("t")), t="###") == ""
    assert one(spark, text.strip_fences(F.col("t")), t='```json\n[{"exame": 1}]\n```') == '[{"exame": 1}]'


def test_stages(spark):
    got = {r["p"]: r["s"] for r in spark.createDataFrame([(p,) for p in (0, 1, 29, 30, 59, 60, 99, 100, -1)], "p int").select("p", values.stage_of(F.col("p")).alias("s")).collect()}
    assert got == {0: "upload", 1: "ocr", 29: "ocr", 30: "brnet", 59: "brnet", 60: "validation", 99: "validation", 100: "completed", -1: None}


def test_values(spark):
    shown = lambda n: one(spark, values.format_bytes(F.col("n")), n=n)
    assert [shown(n) for n in (0, 500, 1024, 1536, 104857600)] == ["0 Bytes", "500Bytes", "1KB", "1.5KB", "100MB"]
    assert one(spark, values.round_half_up(F.lit(-0.5)), values.round_half_up(F.lit(2.5))) == (0, 3)
    assert one(spark, values.file_kind(F.lit("x"), F.lit("a.docx")), values.file_kind(F.lit("image/png"), F.lit("a")), values.file_kind(F.lit(None).cast("string"), F.lit("a.b"))) == ("document", "image", "other")
    assert one(spark, values.accepted(F.lit("image/png"), F.lit("a.PNG"), F.lit(5), ["image/*"], 5), values.accepted(F.lit("a/b"), F.lit("a.PDF"), F.lit(6), [".pdf"], 5)) == (True, False)
    assert one(spark, values.ago(F.lit(datetime(2024, 1, 1)), F.lit(datetime(2024, 1, 3, 5)))) == "2 days ago"
    assert one(spark, values.iso_timestamp(F.lit("2024-01-02T03:04:05")), values.iso_timestamp(F.lit("x"))) == (datetime(2024, 1, 2, 3, 4, 5), None)
    assert one(spark, values.stage_position(F.lit("brnet")), values.stage_position(F.lit("zzz"))) == (3, 1)


def test_json(spark):
    get = lambda t: one(spark, documents.items_or_error(F.lit(t), "exames"))
    assert tuple(get('{"exames": ["A"]}')) == (["A"], None)
    assert get("{}")["error"] and get("nope")["error"] == "not JSON"
    unwrap = lambda t: one(spark, documents.unwrap_list(F.lit(t), ["resultado", "lista"], "string"))
    assert unwrap('["a"]') == ["a"] and unwrap('{"lista": ["b"]}') == ["b"] and unwrap('{"a": 1}') == []
