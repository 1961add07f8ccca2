"""Quality rules: base counts of each document, then cross-document line frequency.

Base: words are runs of characters outside ``\\x20\\x09-\\x0D``. A document fails if it has fewer than ``least_words``
words or if over ``most_repeated`` percent of its words lie in five-word windows that occur twice or more in it.

Method: a line is normalised (lower case, white space as one space, trimmed), hashed together with the document's
host, and the host's distinct documents with that line are counted. A line in more than
``line_documents`` of them, whatever the host's size, is removed wherever it occurs, except in
the host's first document (smallest id) that has it: ``clean_good`` gives the texts without such lines. A document is depleted, and rejected, if fewer than
``least_words`` words or less than ``least_share`` of its words remain.

Documents of a host with equal texts are one document here, so exact copies are neither counted twice nor treated
differently from each other.

Edge cases: null text has no words and fails; a null host is a host of its own; a null or repeated doc_id is
allowed, and rows equal in id, host and text get equal results; whole texts are read whatever their length. Only
the named columns are used; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import BROADCAST_ROWS, SPACE, let, small_or_shuffled, table, text_or_empty, written

LEAST_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5
LINE_DOCUMENTS, LEAST_SHARE = 20, 0.2
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\f\r"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def base_counts(df: DataFrame, text: str) -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words; text mustn't be null."""
    t = F.col(text)
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    df = df.withColumns({"_words": words_of(t), "_lines": lines})
    hashes = F.transform(F.sequence(F.lit(0), F.size("_words") - WINDOW), lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(WINDOW)]))
    bare = F.octet_length(t)
    symbols = sum((bare - F.octet_length(F.replace(t, F.lit(s), F.lit(""))) for s in SYMBOLS), F.lit(0))
    df = df.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": symbols.cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_hashes": F.when(F.size("_words") > WINDOW, hashes).otherwise(F.array().cast("array<bigint>")),
    })
    repeats = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    pairs = F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_sorted", F.when(repeats, pairs))
    twice = F.filter("_sorted", lambda s, k: (F.get("_sorted", k + 1)["h"] == s["h"]) | (F.when(k > 0, F.get("_sorted", k - 1)["h"]) == s["h"]))
    df = df.withColumn("_at", F.when(F.col("_sorted").isNotNull(), F.array_sort(F.transform(twice, lambda s: s["i"]))))
    steps = F.transform("_at", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_at", k + 1) - p, F.lit(WINDOW))))
    df = df.withColumn("n_repeat_words", F.coalesce(F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0)).cast("long"))
    return df.drop("_words", "_lines", "_hashes", "_sorted", "_at")


def line_rows(docs: DataFrame) -> DataFrame:
    """For docs (id, host, text): a row for each document and line that isn't blank: id, host, doc (hash of host and text), pos, line (hash of host and normalised line), words."""
    spaces = f"[{SPACE}]+"
    # hashed before the lines are dealt out: beside posexplode a whole text would be hashed for each of its lines
    hashed = docs.select("id", F.xxhash64("host").alias("host"), F.xxhash64("host", "text").alias("doc"), F.split("text", "\n", -1).alias("lines"))
    rows = hashed.select("id", "host", "doc", F.posexplode("lines").alias("pos", "raw"))
    rows = rows.withColumn("raw", F.btrim(F.lower("raw"), F.lit(BLANKS))).filter(F.col("raw") != "")
    n = F.size(F.split("raw", spaces))
    rows = rows.select("id", "host", "doc", "pos", F.xxhash64("host", F.regexp_replace("raw", spaces, " ")).alias("line"), n.alias("words"))
    return rows


def frequent_lines(docs: DataFrame, line_documents: int) -> DataFrame:
    """line, first_doc: the lines above the limit."""
    rows = line_rows(docs).groupBy("host", "line", "doc").agg(F.min("id").alias("id"))
    counted = rows.groupBy("line").agg(F.count("*").alias("n"), F.min(F.struct("id", "doc")).alias("first"))
    return counted.filter(F.col("n") > line_documents).select("line", F.col("first.doc").alias("first_doc"))


def judge(documents: DataFrame, doc_id: str = "doc_id", host: str = "source", text: str = "text", least_words: int = LEAST_WORDS, most_repeated: int = MOST_REPEATED,
          line_documents: int = LINE_DOCUMENTS, least_share: float = LEAST_SHARE) -> DataFrame:
    """id, doc, the base counts, base_failed, removed_words, removed_at (positions of removed lines, or null) and kept, a row for each document."""
    docs = documents.select(F.col(doc_id).alias("id"), F.col(host).cast("string").alias("host"), text_or_empty(text).alias("text"))
    over = frequent_lines(docs, line_documents)
    removed = line_rows(docs).join(over, "line").filter(F.col("doc") != F.col("first_doc"))
    removed = removed.groupBy("id", "doc").agg(F.sum("words").alias("removed_words"), F.collect_set("pos").alias("removed_at"))
    rows = docs.groupBy("id", F.xxhash64("host", "text").alias("doc")).agg(F.count("*").alias("rows")).filter(F.col("rows") > 1)
    removed = removed.alias("r").join(rows.alias("c"), F.col("r.id").eqNullSafe(F.col("c.id")) & (F.col("r.doc") == F.col("c.doc")), "left")
    removed = removed.select(F.col("r.id").alias("rid"), F.col("r.doc").alias("rdoc"), (F.col("removed_words") / F.coalesce("rows", F.lit(1))).cast("long").alias("removed_words"), "removed_at")
    base = base_counts(docs, "text").withColumn("doc", F.xxhash64("host", "text")).drop("text", "host")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    out = base.join(removed, F.col("id").eqNullSafe(F.col("rid")) & (F.col("doc") == F.col("rdoc")), "left").drop("rid", "rdoc")
    out = out.withColumns({"base_failed": failed, "removed_words": F.coalesce("removed_words", F.lit(0).cast("long"))})
    left = F.col("n_words") - F.col("removed_words")
    depleted = (F.col("removed_words") > 0) & ((left < least_words) | (left < least_share * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted)


def keep_good(documents: DataFrame, doc_id: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """The rows of documents that the rules keep, unchanged. Rows of equal host and text have the same verdict."""
    gone = written(judge(documents, doc_id, host, text).filter(~F.col("kept")).select(F.col("doc").alias("_doc")).distinct(), "rejected")
    doc = F.xxhash64(documents[host].cast("string"), F.coalesce(documents[text].cast("string"), F.lit("")))
    return documents.join(small_or_shuffled(gone), doc == gone["_doc"], "left_anti")


def clean_good(documents: DataFrame, doc_id: str = "doc_id", host: str = "source", text: str = "text", n_chars: str | None = None) -> DataFrame:
    """The rows of documents that the rules keep, their texts without the removed lines, and the text's length in the column n_chars, if named, where a text changes."""
    found = judge(documents, doc_id, host, text).filter(~F.col("kept") | F.col("removed_at").isNotNull())
    changes = written(found.groupBy(F.col("doc").alias("_doc")).agg(F.min("kept").alias("_kept"), F.first("removed_at").alias("_at")), "changes")
    numbers = changes.agg(F.sum(1 + F.coalesce(F.size("_at"), F.lit(0)))).first()[0] or 0
    doc = F.xxhash64(F.col(host).cast("string"), text_or_empty(text))
    rows = documents.select(F.struct("*").alias("row"), doc.alias("doc"))
    rows = rows.join(F.broadcast(changes) if numbers <= BROADCAST_ROWS else changes, F.col("doc") == F.col("_doc"), "left").filter(F.coalesce("_kept", F.lit(True)))
    lines = F.split(F.col(f"row.`{text}`").cast("string"), "\n", -1)
    # the places that are left: a difference by hashes, in the lines' order
    left = lambda v: F.array_except(F.sequence(F.lit(0), F.size(v) - 1), F.col("_at"))
    cleaned = F.when(F.col("_at").isNotNull(), let(lines, lambda v: F.array_join(F.transform(left(v), lambda i: F.get(v, i)), "\n")))

    def column(name: str) -> Column:
        was = F.col(f"row.`{name}`")
        if name == text:
            return F.coalesce(cleaned, was)
        return F.coalesce(F.length(cleaned).cast(documents.schema[name].dataType), was) if name == n_chars else was

    return rows.select(*[column(c).alias(c) for c in documents.columns])


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, i, list_slice(words, i, i + 4) AS gram
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
t AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, CAST(sum(least(5, coalesce(nxt - i, 5))) AS BIGINT) AS n_repeat_words
      FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM t) GROUP BY doc_id),
b AS (SELECT w.doc_id, source, text, CAST(len(words) AS BIGINT) AS n_words,
             CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b),
l AS (SELECT doc_id, source, text, raw, len(string_split_regex(raw, '[\x20\x09-\x0D]+')) AS words,
             regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g') AS line
      FROM (SELECT doc_id, source, text, trim(lower(unnest(string_split(text, chr(10)))), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS raw FROM d) WHERE raw <> ''),
c AS (SELECT source, line, count(DISTINCT text) AS n, arg_min(text, doc_id) AS first_text FROM l GROUP BY source, line),
o AS (SELECT source, line, first_text FROM c WHERE n > 20),
x AS (SELECT l.doc_id, CAST(sum(words) AS BIGINT) AS removed FROM l JOIN o ON l.source IS NOT DISTINCT FROM o.source AND l.line = o.line
      WHERE l.text <> o.first_text GROUP BY l.doc_id)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(removed > 0 AND (n_words - removed < 10 OR n_words - removed < 0.2 * n_words), false) AS kept
FROM f LEFT JOIN x ON f.doc_id = x.doc_id
"""
