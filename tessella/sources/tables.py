"""Readers and writers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: How timestamps are saved, to the microsecond.
TIMESTAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
SYNONYMS = "exam string, synonym string"
FAQ = "pergunta string, resposta string"
VECTORS = "vec_id bigint, embedding array<float>, meta string"
PROGRESS = "doc_id string, seq bigint, ts timestamp, progress int, step string, message string, resultado string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_synonyms(spark: SparkSession, path: str) -> DataFrame:
    """One synonym a row; commas inside quotes belong to the name."""
    return spark.read.schema(SYNONYMS).option("header", True).option("quote", '"').option("escape", '"').csv(path)


def read_faq(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated questions and answers; quoted answers can have newlines."""
    return spark.read.schema(FAQ).option("header", True).option("sep", "\t").option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VECTORS).parquet(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole text files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, size, content) of files as they are."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("size"), "content")


def event_lines(lines: DataFrame, schema: str = PROGRESS) -> DataFrame:
    """Events of server-sent lines ``data: {...}`` in a column value; other and malformed lines are skipped. For batches and streams."""
    body = F.when(F.startswith("value", F.lit("data: ")), F.substr("value", F.lit(7)))
    parsed = F.from_json(body, schema, {"mode": "PERMISSIVE"})
    good = F.try_parse_json(body).isNotNull()
    return lines.filter(good).select(parsed.alias("e")).select("e.*")


def write_audit(df: DataFrame, path: str, identifier: str) -> None:
    """JSON lines under the identifier's hash instead of itself, so no path or key shows it; appends."""
    df.withColumn("id_hash", F.sha2(F.col(identifier).cast("string"), 256)).drop(identifier).write.mode("append").json(path)


def write_export(df: DataFrame, path: str) -> None:
    """CSV with every cell quoted and quotes inside doubled."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def event_frames(text: DataFrame, schema: str = PROGRESS) -> DataFrame:
    """Events of whole texts in a column value: blocks between blank lines, each one event whose data lines belong together; bad blocks are skipped."""
    blocks = text.select(F.explode(F.split("value", "\\r?\\n[ \\t]*\\r?\\n")).alias("block"))
    lines = F.filter(F.split("block", "\\r?\\n"), lambda x: x.startswith("data:"))
    return event_lines(blocks.select(F.concat(F.lit("data: "), F.array_join(F.transform(lines, lambda x: F.ltrim(F.substr(x, F.lit(6)))), "\n")).alias("value")), schema)


def write_lists(df: DataFrame, path: str) -> None:
    """Guides or other lists as JSON lines; appends."""
    df.write.mode("append").json(path)


def write_page_texts(df: DataFrame, path: str, text: str, by: str) -> None:
    """Page texts, one file's worth of lines for each value of by, in a folder of its own."""
    df.select(by, F.col(text).alias("value")).write.mode("append").partitionBy(by).text(path)


def write_markdown(df: DataFrame, path: str, doc_id: str, markdown: str, wanted: bool = True) -> None:
    """Recognised texts by document, if wanted."""
    if wanted:
        df.select(F.col(doc_id).alias("doc_id"), F.col(markdown).alias("markdown")).write.mode("append").parquet(path)


def write_vectors(df: DataFrame, path: str) -> None:
    """Vectors with their metadata, as read_vectors reads them."""
    df.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<float>"), F.col("meta").cast("string")).write.mode("overwrite").parquet(path)


def loaded(saved: Column, schema: str, default: Column) -> Column:
    """A value saved as JSON, or the default where it is missing or bad; columns of type timestamp come back as such."""
    good = F.try_parse_json(saved).isNotNull()
    return F.coalesce(F.when(good, F.from_json(saved, schema, {"mode": "PERMISSIVE", "timestampFormat": TIMESTAMP})), default)


def as_json(*columns: str) -> Column:
    return F.to_json(F.struct(*columns), {"timestampFormat": TIMESTAMP})
