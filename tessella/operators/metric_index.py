"""An index of vectors on disk: parts around pivots, with radii, searched exactly.

Each vector lies in the part of its nearest pivot; pivots are vectors of a bounded sample (``pivots`` of them). A part's
folder has its vectors and their distance to the pivot; a small table has each part's pivot, number of rows, least and greatest
distance. A query needs a part only if the triangle inequality leaves room: no vector of a part is nearer than the
query's distance to the pivot less the part's radius, nor than the least distance less the query's. The parts nearest to
a query that together hold k vectors bound its k-th distance from above, so all others beyond that bound are left out, and no true
neighbour is lost. Pairs of query and part that remain are joined by part; within a part blocks of vectors meet blocks of queries.

A missing index, one without rows, or one of another dimension than asked for raises ``NoIndex`` before a search starts
(``search(..., missing="empty")`` gives no rows instead). A query of another length stops the search with an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.session import ship_package, stored

#: Pivots at most; with their vectors they are the only thing that every task gets.
PIVOTS = 256
#: Rows of a part that are one block; a part of any size is several blocks, dealt over tasks.
BLOCK = 4096
FOUND = "query_id long, vec_id long, dist2 double"


class NoIndex(Exception):
    """There is no index to search, or one of another dimension."""


def checked(column: str, dimension: int):
    right = F.size(column) == dimension
    return F.when(right, F.transform(column, lambda x: x.cast("double"))).otherwise(F.raise_error(F.lit(f"an embedding hasn't {dimension} numbers")))


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Of each point to each pivot, row by row to bound memory."""
    return np.stack([np.sqrt(((pivots - x) ** 2).sum(1)) for x in points]) if len(points) else np.zeros((0, len(pivots)))


def build(vectors: DataFrame, path: str, dimension: int, pivots: int = PIVOTS) -> None:
    """Writes the index of vectors (vec_id, embedding) to path: pivots by the lowest hashes of ids, one pass to find each vector's part."""
    spark = ship_package(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), checked("embedding", dimension).alias("v"))
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).toArrow()
    centres = np.array(chosen["v"].to_pylist(), float).reshape(-1, dimension)
    shared = spark.sparkContext.broadcast(centres)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                d = distances(np.stack(pdf["v"].to_numpy()), shared.value)
                part = d.argmin(1)
                yield pd.DataFrame({"vec_id": pdf["vec_id"], "v": pdf["v"], "d": d[np.arange(len(d)), part], "part": part.astype(np.int32)})

    placed = rows.mapInPandas(place, "vec_id long, v array<double>, d double, part int")
    placed.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(16)).cast("int")).repartition("part", "block").drop("block").write.partitionBy("part").parquet(f"{path}/vectors")
    parts = spark.read.schema("vec_id long, v array<double>, d double, part int").parquet(f"{path}/vectors").groupBy("part").agg(F.count("*").alias("n"), F.min("d").alias("least"), F.max("d").alias("most"))
    named = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "part int, pivot array<double>")
    parts.join(F.broadcast(named), "part").coalesce(1).write.parquet(f"{path}/parts")


def parts_of(spark: SparkSession, path: str, dimension: int) -> pd.DataFrame:
    """The parts' table; NoIndex where it isn't there, is empty or has another dimension."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/parts/_SUCCESS")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        raise NoIndex(f"no index in {path}")
    parts = spark.read.schema("part int, n bigint, least double, most double, pivot array<double>").parquet(f"{path}/parts").toPandas()
    if not len(parts):
        raise NoIndex(f"the index in {path} has no rows")
    if len(parts["pivot"][0]) != dimension:
        raise NoIndex(f"the index in {path} has {len(parts['pivot'][0])} dimensions, not {dimension}")
    return parts


def needed(q: np.ndarray, parts: dict[str, np.ndarray], k: int) -> np.ndarray:
    """For each query (row) and part whether the part can hold one of its k nearest; the slack covers rounding."""
    to_pivot = distances(q, parts["pivot"])
    farthest = to_pivot + parts["most"]
    order = np.argsort(farthest, 1)
    held = np.cumsum(parts["n"][order], 1)
    last = np.minimum((held < k).sum(1), order.shape[1] - 1)
    bound = np.take_along_axis(farthest, order, 1)[np.arange(len(q)), last]
    bound = np.where(held[:, -1] < k, np.inf, bound)[:, None]
    nearest = np.maximum(np.maximum(to_pivot - parts["most"], parts["least"] - to_pivot), 0)
    return nearest <= bound * (1 + 1e-9) + 1e-12


def plan(queries: DataFrame, parts: pd.DataFrame, dimension: int, k: int) -> DataFrame:
    """(query_id, q, part): the parts that each query has to look at."""
    spark = ship_package(queries.sparkSession)
    table = {"pivot": np.array(parts["pivot"].tolist()), "n": parts["n"].to_numpy(), "least": parts["least"].to_numpy(), "most": parts["most"].to_numpy(), "part": parts["part"].to_numpy()}
    shared = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                row, part = np.nonzero(needed(np.stack(pdf["q"].to_numpy()), shared.value, k))
                yield pd.DataFrame({"query_id": pdf["query_id"].to_numpy()[row], "q": pdf["q"].to_numpy()[row], "part": shared.value["part"][part].astype(np.int32)})

    rows = queries.select(F.col("query_id").cast("long").alias("query_id"), checked("embedding", dimension).alias("q"))
    return rows.mapInPandas(run, "query_id long, q array<double>, part int")


def best_of(ids: np.ndarray, q: np.ndarray, vec: np.ndarray, v: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest of one block of vectors for each query of another, ties by vec_id."""
    out = []
    for s in range(0, len(ids), 64):
        d = np.stack([((v - x) ** 2).sum(1) for x in q[s : s + 64]])
        order = np.lexsort((np.broadcast_to(vec, d.shape), d), axis=1)[:, :k]
        out.append(pd.DataFrame({"query_id": np.repeat(ids[s : s + 64], order.shape[1]), "vec_id": vec[order].ravel(), "dist2": np.take_along_axis(d, order, 1).ravel()}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "dist2": []})


def search(queries: DataFrame, path: str, dimension: int, k: int = 5, missing: str = "error") -> DataFrame:
    """(query_id, vec_id, dist2, rank): the k nearest vectors of the index for each of queries (query_id, embedding)."""
    spark = queries.sparkSession
    try:
        parts = parts_of(spark, path, dimension)
    except NoIndex:
        if missing != "empty":
            raise
        return spark.createDataFrame([], FOUND + ", rank int")
    sizes = {int(p): int(n) for p, n in zip(parts["part"], parts["n"])}
    blocks = F.create_map(*[F.lit(x) for p, n in sizes.items() for x in (p, max(1, -(-n // BLOCK)))])
    wanted = stored(plan(queries, parts, dimension, k), "wanted")
    # a part of several blocks is looked at block by block, each with all its queries: no task gets a whole large part
    asked = wanted.withColumn("block", F.explode(F.sequence(F.lit(0), blocks[F.col("part")] - 1)))
    asked = asked.withColumn("group", F.pmod(F.xxhash64("query_id"), F.lit(8)).cast("int"))
    seen = wanted.select("part").distinct()
    vectors = spark.read.schema("vec_id long, v array<double>, d double, part int").parquet(f"{path}/vectors").join(F.broadcast(seen), "part", "left_semi")
    vectors = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id"), blocks[F.col("part")]).cast("int")).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(7))))

    def meet(key: tuple, q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(v):
            return pd.DataFrame({"query_id": pd.Series([], dtype="int64"), "vec_id": pd.Series([], dtype="int64"), "dist2": pd.Series([], dtype="float64")})
        return best_of(q["query_id"].to_numpy(), np.stack(q["q"].to_numpy()), v["vec_id"].to_numpy(), np.stack(v["v"].to_numpy()), k)

    keys = ["part", "block", "group"]
    best = asked.groupBy(*keys).cogroup(vectors.select("vec_id", "v", *keys).groupBy(*keys)).applyInPandas(meet, FOUND)
    w = Window.partitionBy("query_id").orderBy("dist2", "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def parts_read(queries: DataFrame, path: str, dimension: int, k: int = 5) -> DataFrame:
    """(query_id, parts, of): how many parts a search looks at for each query, and how many there are."""
    parts = parts_of(queries.sparkSession, path, dimension)
    return plan(queries, parts, dimension, k).groupBy("query_id").agg(F.count("*").alias("parts")).withColumn("of", F.lit(len(parts)))
