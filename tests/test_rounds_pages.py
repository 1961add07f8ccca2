"""Filtered facets, pages by index, lookups in rounds and the display queue against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import pages, reconcile, review
from tessella.streaming import progress


def test_facets_under_filters(spark):
    rng = random.Random(5)
    data = [(rng.choice("abc"), rng.choice([None, "x", "y"]), rng.sample("pqrs", rng.randrange(4)), rng.randrange(100)) for _ in range(500)]
    df = spark.createDataFrame(data, "s string, t string, tags array<string>, v int")
    filters = {"s": F.col("s").isin("a", "b"), "t": F.col("t") == "x", "v": F.col("v") < 60}
    met = [(r[0] in "ab", r[1] == "x", r[3] < 60) for r in data]
    want: dict = {}
    for r, (s, t, v) in zip(data, met):
        for facet, ok, cells in (("s", t and v, [r[0]]), ("t", s and v, [r[1]]), ("tags", s and t and v, r[2])):
            for c in cells if ok else []:
                want[facet, c] = want.get((facet, c), 0) + 1
    out = review.facets_under(df, filters, ["s", "t", "tags"])
    assert {(r["facet"], r["value"]): r["n"] for r in out.collect()} == want
    unfiltered = {tuple(r) for r in review.facets(df, ["s", "tags"]).collect()}
    assert {tuple(r) for r in review.facets_under(df, {}, ["s", "tags"]).collect()} == unfiltered
    assert review.facets_under(df.limit(0), filters, ["s"]).collect() == []


def test_filtered_facets_scan_once(spark, tmp_path):
    spark.range(100).select("id", (F.col("id") % 3).alias("a"), (F.col("id") % 5).alias("b")).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    plan = review.facets_under(df, {"a": F.col("a") > 0, "b": F.col("b") > 1}, ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Join" not in plan


def test_pages(spark, tmp_path):
    rng = random.Random(1)
    data = [(k, rng.choice([None, 1, 2, 2, 2])) for k in range(1003)]
    df = spark.createDataFrame(data, "id long, v int")
    order = [F.desc_nulls_last("v"), F.asc("id")]
    index = pages.build(df, order, f"file://{tmp_path}/p", 7)
    want = [k for k, v in sorted(data, key=lambda r: (-(r[1] or 0), r[0]))]
    assert index.pages() == 101 and index.rows() == 1003 and len(index.directory()) > 3
    got = [index.page(p).orderBy("place").collect() for p in (1, 2, 50, 101, 102)]
    assert [[r["id"] for r in rows] for rows in got] == [want[:10], want[10:20], want[490:500], want[1000:], []]
    assert [r["place"] for r in got[3]] == [1000, 1001, 1002]
    assert len(index.ranges(101)) == 1 and max(len(index.ranges(p)) for p in range(1, 102)) <= 2
    plan = index.page(101)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    assert [r["id"] for r in index.page(2, 700).orderBy("place").collect()] == want[700:]
    with pytest.raises(ValueError, match="counted from 1"):
        index.page(0)
    again = pages.PageIndex(spark, f"file://{tmp_path}/p", df.schema)
    assert [r["id"] for r in again.page(101).orderBy("place").collect()] == want[1000:]


def test_pages_of_nothing(spark, tmp_path):
    index = pages.build(spark.createDataFrame([], "id long"), [F.asc("id")], f"file://{tmp_path}/p", 3)
    assert index.pages() == 0 and index.page(1).collect() == [] and index.page(1).columns == ["id", "place"]


CANDIDATES = {1: ["a", "b"], 2: ["x", "b"], 3: ["x", None, "c", "d"], 4: ["x", "y"], 5: [], 6: None, 7: [None, "a"], 8: ["c"]}
KNOWN = {"a": "A", "b": "B", "c": "C", "d": "D"}


def test_lookups_in_rounds(spark):
    docs = spark.createDataFrame(list(CANDIDATES.items()), "doc int, candidates array<string>")
    known = spark.createDataFrame(list(KNOWN.items()), "identifier string, items string")
    asked = []

    def lookup(wanted):
        asked.append(sorted(r[0] for r in wanted.collect()))
        return wanted.join(known, "identifier")

    got = {r["doc"]: (r["identifier"], r["items"], r["status"]) for r in reconcile.required_in_rounds(docs, lookup, "doc", "candidates").collect()}
    plain = {r["doc"]: (r["identifier"], r["items"], r["status"]) for r in reconcile.required_items(docs, known, "doc", "candidates", "identifier", "items").collect()}
    assert got == plain and got[3] == ("c", "C", "ok") and got[4] == (None, None, "falha")
    # "d" is never asked for: its document is solved before; no identifier is asked for twice, and no fourth round comes
    assert asked == [["a", "c", "x"], ["b", "y"], []]


def test_no_rounds(spark):
    docs = spark.createDataFrame([(1, []), (2, None)], "doc int, candidates array<string>")
    out = reconcile.required_in_rounds(docs, lambda w: 1 / 0, "doc", "candidates")
    assert sorted(tuple(r) for r in out.collect()) == [(1, None, None, "falha"), (2, None, None, "falha")]
    assert reconcile.required_in_rounds(docs.limit(0), lambda w: 1 / 0, "doc", "candidates").collect() == []


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_display_times(spark, block):
    rng = random.Random(block)
    data = [(rng.choice(["a", "a", "b", None]), k, rng.randrange(200), rng.choice([0, 0, 1, 3, 40])) for k in range(400)] + [("c", 1000, None, None)]
    out = progress.display_times(spark.createDataFrame(data, "u string, k int, at int, lasts int"), "u", "at", "k", "lasts", block)
    want, until = {}, {}
    for u, k, at, lasts in sorted(data, key=lambda r: (r[2] or 0, r[1])):
        start = max(at or 0, until.get(u, 0))
        until[u] = start + (lasts or 0)
        want[k] = (start, until[u])
    assert {r["k"]: (r["start"], r["end"]) for r in out.collect()} == want
