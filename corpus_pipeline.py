"""The corpus pipeline: quality rules, near duplicates, benchmark leaks, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and all that the stage before kept; its result is written as Parquet in the
shared folder and read again as the next stage's docs. All but the last return the columns of documents. Edge cases
are those of the operators; a row without an id is never taken for a near duplicate or a leak.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import bpe, decontam, jaccard, quality, secret_scan
from tessella.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, and frequent lines go from the others; n_chars follows where a text changes."""
    return quality.clean_good(docs, n_chars="n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return jaccard.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are covered; n_chars follows where a text changes."""
    return secret_scan.without_secrets(docs, n_chars="n_chars")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the ids of each text, their number, and digests of the ids and of the decoded bytes."""
    return bpe.round_trip(docs.select("doc_id", "lang", "source", "text"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("tokens", tokens),
]

#: Near duplicates, templates and byte-pair merges can't be said in SQL; tests compare run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
