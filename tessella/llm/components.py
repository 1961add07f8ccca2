"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import Scratch


def components(links: DataFrame) -> DataFrame:
    """links (x, y), both bigint -> node, root for every node of a link; root is one of its component's nodes. Rows with a null are no links.

    Each round hooks every node to its smallest neighbour, shortens the paths once and contracts the links, until
    none is left between different roots. Tables are written between rounds, so a lost executor costs one round; each
    is removed when the next is there.
    """
    scratch = Scratch(links.sparkSession)
    edges = scratch.written(links.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).filter("x <> y").distinct(), "links")
    total: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.union(edges.select("y", "x"))
        near = scratch.written(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("low")).select("node", F.least("node", "low").alias("up")), "hooks")
        up = near.select(F.col("node").alias("_n"), F.col("up").alias("_u"))
        hooks = scratch.written(near.join(up, F.col("up") == F.col("_n"), "left").select("node", F.coalesce("_u", "up").alias("root")), "hooks")
        to = lambda name: hooks.select(F.col("node").alias(f"_{name}"), F.col("root").alias(f"_r{name}"))  # noqa: E731, B023
        moved = edges.join(to("x"), F.col("x") == F.col("_x")).join(to("y"), F.col("y") == F.col("_y"))
        left = scratch.written(moved.select(F.least("_rx", "_ry").alias("x"), F.greatest("_rx", "_ry").alias("y")).filter("x <> y").distinct(), "links")
        was = total
        if was is None:
            total = hooks
        else:
            total = scratch.written(was.join(to("t"), F.col("root") == F.col("_t"), "left").select("node", F.coalesce("_rt", "root").alias("root")), "roots")
            scratch.drop(hooks, was)
        scratch.drop(edges, near)
        edges = left
    if total is None:
        return edges.select(F.col("x").alias("node"), F.col("y").alias("root"))
    scratch.close(total)
    return total
