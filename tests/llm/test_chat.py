import hashlib
import random
import time

from pyspark.sql import functions as F

from tessella.llm import chat

SCHEMA = f"conv_id long, turn long, role string, parts array<{chat.PART}>, turns string"


def part(kind, text=None, ref=None, **size):
    return (kind, text, ref, size.get("width"), size.get("height"), size.get("seconds"), size.get("pages"))


def test_parts_are_visited_in_order(spark):
    rows = [(1, 1, "assistant", [part("text", "ok")], ""), (1, 0, "user", [part("text", "look <|end|> "), part("image", ref="a.png", width=28, height=15), part("audio", ref="b.wav", seconds=1.5), part("document", ref="c.pdf", pages=3), part("odd", ref="d"), part(None, "[x]")], "")]
    r = chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).first()
    assert r["formatted"] == "<|turn|>user\nlook &lt;|end|> <|image:1|><|audio:2|><|document:3|><|file:4|>&#91;x]<|end|>\n<|turn|>assistant\nok<|end|>\n"
    assert [tuple(a) for a in r["attachments"]] == [(0, 1, "image", "a.png", 4), (0, 2, "audio", "b.wav", 38), (0, 3, "document", "c.pdf", 768), (0, 4, "file", "d", 0)]
    assert r["media_tokens"] == 4 + 38 + 768
    assert [r["formatted"][s["start"] : s["end"]] for s in r["loss"]] == ["ok"]


def test_texts_come_back(spark):
    rng = random.Random(6)
    bits = ["<|end|>\n", "<|turn|>", "</s>", "[INST]", "&", "&amp;", "&lt;", "&#91;", "&#10;", "\n", "\r", "🙂", "é", " ", "a", "<", "[", "|>", "<|image:1|>", "\x00", ""]
    said = {(c, t): (rng.choice(("user", "assistant", "tool\nx", "", "sys<tem")), "".join(rng.choice(bits) for _ in range(rng.randrange(12)))) for c in range(60) for t in range(rng.randint(1, 5))}
    df = spark.createDataFrame([(c, t, *v) for (c, t), v in said.items()], "conv_id long, turn long, role string, text string").repartition(4)
    out = chat.format_conversations(df.withColumn("parts", chat.text_parts(F.col("text"))))
    for r in out.select("conv_id", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("learned")).collect():
        want = [v for (c, _), v in sorted(said.items()) if c == r["conv_id"]]
        assert [tuple(t) for t in r["turns"]] == want
        assert r["learned"] == "".join(t for role, t in want if role == "assistant")


def test_edges(spark):
    rows = [(1, 0, None, None, "x"), (1, 0, "a", [], "x"), (1, None, "b", [part("text", None)], "x"), (None, 0, "user", [part("text", "n")], "x"), (None, 0, "user", [part("text", "n")], "x"), (2, 0, "assistant", [part("text", "long " * 50_000)], "x")]
    got = {r["conv_id"]: r for r in chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1]["formatted"] == "<|turn|>b\n<|end|>\n<|turn|>\n<|end|>\n<|turn|>a\n<|end|>\n" and got[1]["loss"] == []
    assert got[None]["formatted"] == "<|turn|>user\nn<|end|>\n" * 2
    head = len("<|turn|>assistant\n")
    assert [(s["start"], s["end"]) for s in got[2]["loss"]] == [(head, head + 250_000)]
    assert chat.format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_very_many_turns(spark):
    """200,000 turns of one conversation, in seconds."""
    n = 200_000
    rows = spark.range(n).select(F.lit(None).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), chat.text_parts(F.concat(F.lit("t"), F.col("id") % 7)).alias("parts"))
    began = time.monotonic()
    out = chat.format_conversations(rows).select(F.size("loss").alias("n"), F.sha2(chat.read_loss(F.col("formatted"), F.slice("loss", n // 2 - 9, 10)).cast("binary"), 256).alias("last"), F.element_at("loss", -1).alias("end"), F.length("formatted").alias("chars")).first()
    assert time.monotonic() - began < 60
    assert out["n"] == n // 2 and out["end"]["end"] == out["chars"] - len(chat.END)
    assert out["last"] == hashlib.sha256("".join(f"t{k % 7}" for k in range(n - 19, n, 2)).encode()).hexdigest()
