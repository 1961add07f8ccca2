"""Exact nearest neighbours by squared Euclidean distance, and synonym expansion."""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import ship_package, stored

K, MOST_DISTANT = 5, 1.5


def nearest(queries: DataFrame, index: DataFrame, dimension: int, k: int = K, block: int = 4096) -> DataFrame:
    """(query_id, vec_id, dist2, rank): the k nearest rows of index (vec_id, embedding) for each of queries (query_id, embedding), ties by vec_id.

    Queries go to the tasks in blocks of about ``block``, a bounded size (8 MB at 256 numbers each); each block is compared
    with every part of the index where that part is read, and a part passes on its k best for each query, so the index
    isn't shuffled and what is shuffled is k rows a part and query. A vector of another length than dimension stops the query.
    """
    right = F.size("embedding") == dimension
    checked = F.when(right, F.transform("embedding", lambda x: x.cast("double"))).otherwise(F.raise_error(F.lit(f"an embedding hasn't {dimension} numbers")))
    queries = queries.select(F.col("query_id").cast("long").alias("query_id"), checked.alias("q"))
    index = index.select(F.col("vec_id").cast("long").alias("vec_id"), checked.alias("v"))
    spark = queries.sparkSession
    numbered = stored(queries, "queries")
    blocks = -(-numbered.count() // block)

    def search_in(shared):
        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q = shared.value
            best_d, best_v = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
            for pdf in batches:
                if not len(pdf):
                    continue
                vec, v = pdf["vec_id"].to_numpy(np.int64), np.stack(pdf["v"].to_numpy())
                for s in range(0, len(ids), 64):
                    d = np.stack([((v - x) ** 2).sum(1) for x in q[s : s + 64]])
                    d, names = np.concatenate([best_d[s : s + 64], d], 1), np.concatenate([best_v[s : s + 64], np.broadcast_to(vec, d.shape)], 1)
                    order = np.lexsort((names, d), axis=1)[:, :k]
                    best_d[s : s + 64], best_v[s : s + 64] = np.take_along_axis(d, order, 1), np.take_along_axis(names, order, 1)
            found = np.isfinite(best_d)
            yield pd.DataFrame({"query_id": np.repeat(ids, found.sum(1)), "vec_id": best_v[found], "dist2": best_d[found]})

        return search

    best = None
    for number in range(blocks):
        part = numbered.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number).toArrow()
        if part.num_rows:
            shared = spark.sparkContext.broadcast((part["query_id"].to_numpy(), np.array(part["q"].to_pylist(), float)))
            one = index.mapInPandas(search_in(shared), "query_id long, vec_id long, dist2 double")
            best = one if best is None else best.union(one)
    if best is None:
        best = spark.range(0).select(F.col("id").alias("query_id"), F.col("id").alias("vec_id"), F.lit(0.0).alias("dist2"))
    w = Window.partitionBy("query_id").orderBy("dist2", "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def within(neighbours: DataFrame, most: float = MOST_DISTANT) -> DataFrame:
    """Strictly nearer than most."""
    return neighbours.filter(F.col("dist2") < most)


def with_metadata(neighbours: DataFrame, metadata: DataFrame) -> DataFrame:
    return neighbours.join(metadata, "vec_id")


def expand(names: DataFrame, neighbours: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(query_id, expanded): a name (query_id, name) with its neighbours' synonyms (vec_id, synonym), distinct, sorted, comma-joined."""
    more = neighbours.join(synonyms, "vec_id").select("query_id", F.col("synonym").alias("name"))
    both = names.select("query_id", "name").union(more).filter(F.col("name").isNotNull())
    return both.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("expanded"))


def describe_index(index: DataFrame) -> DataFrame:
    return index.agg(F.count("*").alias("n_rows"), F.min(F.size("embedding")).alias("least_dimension"), F.max(F.size("embedding")).alias("most_dimension"))


def embedded(names: DataFrame, text: str, embed, attempts: int = 3, wait: float = 1.0, most_wait: float = 10.0) -> DataFrame:
    """names with embedding (array<float>): embed, a function of a list of texts, is called once for each batch of distinct texts, and
    again after an error, up to so many attempts with doubling waits. A text whose attempts all fail, or that is null, has a null embedding."""
    ship_package(names.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for attempt in range(attempts):
                try:
                    pdf["embedding"] = [None if v is None else np.asarray(v, np.float32) for v in embed(pdf["_text"].tolist())]
                    break
                except Exception:  # noqa: BLE001 - whatever a remote model raises
                    if attempt + 1 < attempts:
                        time.sleep(min(most_wait, wait * 2**attempt))
            else:
                pdf["embedding"] = None
            yield pdf[["_text", "embedding"]]

    known = names.select(F.col(text).alias("_text")).filter("_text is not null").distinct().mapInPandas(run, "_text string, embedding array<float>")
    return names.join(known, F.col(text) == F.col("_text"), "left").drop("_text")


def with_score(neighbours: DataFrame) -> DataFrame:
    return neighbours.withColumn("score", F.format_string("%.4f", "dist2"))
