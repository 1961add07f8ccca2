"""Chat formatting with typed content parts.

A turn's content is a list of parts. A visitor flattens them in order: a text part gives its text with the
template's control characters escaped, an image, audio or document part gives a placeholder ``<|kind:k|>`` (k is
the part's position) and an attachment entry with the reference and the number of tokens that it expands to.
A conversation is its turns, each ``<|turn|>role, newline, content, <|end|>, newline``.

Escaping replaces ``&``, ``<`` and ``[`` (in roles also the newline) by character references, so no text can
form a marker of this or a bracketed template, and is undone exactly by ``unescape``.

Edge cases: null text or role counts as empty; null or empty part lists give an empty turn; an unknown or null
part type with text is text, else a ``file`` placeholder of no tokens; turns are ordered by turn, then role, then
escaped content, a null turn first; repeated rows stay; rows with a null conversation id form one conversation. Columns
other than the named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import let, running, table

TURN, END = "<|turn|>", "<|end|>\n"
MEDIA = ("image", "audio", "document")
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))


def escape(text: Column, role: bool = False) -> Column:
    for raw, safe in ESCAPES + ((("\n", "&#10;"),) if role else ()):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in reversed((*ESCAPES, ("\n", "&#10;"))):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def text_parts(text: Column) -> Column:
    """A list of one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages")))


def flatten_parts(parts: Column, patch: int = 14, audio_rate: int = 25, page_tokens: int = 256) -> Column:
    """struct<content, attachments: array<struct<part, type, ref, tokens>>, tokens> of a list of parts."""
    parts = F.coalesce(parts, F.array().cast(f"array<{PART}>"))
    kind = lambda p: F.when(p["type"].isin(*MEDIA), p["type"]).when((p["type"] == "text") | p["text"].isNotNull(), "text").otherwise("file")
    zero = lambda c: F.coalesce(c, F.lit(0))
    tokens = lambda p: (
        F.when(p["type"] == "image", F.ceil(zero(p["width"]) / patch) * F.ceil(zero(p["height"]) / patch))
        .when(p["type"] == "audio", F.ceil(zero(p["seconds"]) * audio_rate))
        .when(p["type"] == "document", zero(p["pages"]) * page_tokens)
        .otherwise(0)
        .cast("long")
    )
    shown = F.transform(parts, lambda p, i: F.when(kind(p) == "text", escape(F.coalesce(p["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), kind(p), F.lit(":"), i.cast("string"), F.lit("|>"))))
    listed = F.filter(F.transform(parts, lambda p, i: F.struct(i.alias("part"), kind(p).alias("type"), p["ref"].alias("ref"), tokens(p).alias("tokens"))), lambda a: a["type"] != "text")
    return F.struct(F.array_join(shown, "").alias("content"), listed.alias("attachments"), F.aggregate(F.transform(listed, lambda a: a["tokens"]), F.lit(0).cast("long"), lambda s, x: s + x).alias("tokens"))


def format_conversations(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", learned: str = "assistant") -> DataFrame:
    """conv, formatted, loss (array of struct<start, end> in code points, one for each turn of the role learned), attachments (with their turn's position) and media_tokens."""
    rows = messages.select(F.col(conv), F.col(turn).alias("_turn"), F.coalesce(F.col(role), F.lit("")).alias("_role"), flatten_parts(F.col(parts)).alias("_flat"))
    rows = rows.select(conv, F.struct("_turn", F.col("_role").alias("role"), F.col("_flat.content").alias("content"), F.col("_flat.attachments").alias("attachments"), F.col("_flat.tokens").alias("tokens")).alias("t"))
    grouped = rows.groupBy(conv).agg(F.sort_array(F.collect_list("t")).alias("turns"))
    head = lambda t: F.concat(F.lit(TURN), escape(t["role"], role=True), F.lit("\n"))
    shown = grouped.select(conv, "turns", F.transform("turns", lambda t: F.concat(head(t), t["content"], F.lit(END))).alias("shown"))
    ends = running(F.transform("shown", lambda t: F.length(t).cast("long")), lambda a, b: a + b)
    span = lambda e, t, i: F.struct((F.get(e, i) - len(END) - F.length(t["content"])).alias("start"), (F.get(e, i) - len(END)).alias("end"))
    spans = let(ends, lambda e: F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == learned, span(e, t, i))), lambda x: x.isNotNull()))
    listed = F.flatten(F.transform("turns", lambda t, i: F.transform(t["attachments"], lambda a: F.struct(i.alias("turn"), a["part"].alias("part"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    return shown.select(
        conv, F.array_join("shown", "").alias("formatted"), spans.alias("loss"), listed.alias("attachments"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda s, t: s + t["tokens"]).alias("media_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> from a formatted conversation."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>\n", -1), lambda p: p != "")
    cut = lambda p: F.locate("\n", p)
    return F.transform(pieces, lambda p: F.struct(unescape(p.substr(F.lit(len(TURN) + 1), F.locate("\n", p) - len(TURN) - 1)).alias("role"), unescape(p.substr(F.locate("\n", p) + 1, F.length(p))).alias("text")))


def read_loss(formatted: Column, loss: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(formatted.substr((s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = "</s>[INST] ok [/INST]"
    probes = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    rows = rows.unionByName(probes)
    out = format_conversations(rows.withColumn("parts", text_parts(F.col("text"))))
    out = out.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss")).alias("learned"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP8_SQL = """
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') AS safe FROM m),
n AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, safe) AS said,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, safe) FILTER (role = 'assistant'), '') AS learned,
         sum(8 + length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), chr(10), '&#10;')) + 1
             + length(safe) + 8) AS formatted_chars
  FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(learned) AS BIGINT) AS loss_chars,
       sha256(learned) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM n
"""
