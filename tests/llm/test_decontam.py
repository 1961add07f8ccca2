import random

import brute
import pytest

from tessella.llm import decontam

QUESTION = "A train leaves Boston at 60 miles per hour and another train leaves Denver towards Boston at 45 miles per hour when do they meet"
MOVED = "A train leaves Lisbon at 80 miles per hour and another train leaves Madrid towards Lisbon at 35 miles per hour when do they meet"
MIXED = "A train leaves Lisbon at 80 miles per hour and another train leaves Madrid towards Oslo at 35 miles per hour when do they meet"
ITEMS = [(1, QUESTION), (2, "one two three four five six"), (3, "too few words"), (4, None), (5, ""), (6, QUESTION), (7, "add 12 kg of Flour to 3 l of water and stir for 5 min then bake")]


def found(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(d, spark.createDataFrame(items, "item_id long, text string"), **options).collect()}


def documents():
    rng = random.Random(2)
    filler = lambda n: " ".join("".join(rng.choice("aeioulnrst") for _ in range(5)) for _ in range(n))
    docs = [filler(20) + " " + t + " " + filler(9) for t in (QUESTION, MOVED, MIXED, QUESTION.upper(), QUESTION.replace(" ", "\n, "), "One two. Three-four five; six!", "one two three four five seven", "add 9 kg of Sugar to 7 l of water and stir for 8 min then bake", "Add 9 kg of Flour to 9 l of water")]
    docs += [None, "", "x", filler(3000), QUESTION + " " + filler(2000), " ".join(QUESTION.split()[:14]), " ".join(QUESTION.split()[:9]), (QUESTION + " ") * 40]
    return list(enumerate(docs))


def test_edited_and_partial_items(spark):
    """One word edited in each half, and 14 words in a row of 60, are found; 12 in a row aren't."""
    words = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    edited = list(words[:40])
    edited[12] = edited[28] = "other"
    docs = [(1, " ".join(edited)), (2, "x y " + " ".join(words[20:34]) + " z"), (3, "x y " + " ".join(words[20:32]) + " z"), (4, " ".join(words[:6] + ["other"] + words[6:12]))]
    items = [(7, " ".join(words[:40])), (8, " ".join(words))]
    want = brute.contaminated(docs, items)
    assert found(spark, docs, items) == want and {d for d, _ in want} == {1, 2}


def test_brute_force(spark):
    docs = documents()
    want = brute.contaminated(docs, ITEMS)
    assert found(spark, docs, ITEMS) == want
    assert {(0, 1), (0, 6), (1, 1), (3, 1), (4, 1), (5, 2), (7, 7), (13, 1), (16, 1)} <= want
    assert not {d for d, _ in want} & {2, 6, 9, 10, 11, 12}


@pytest.mark.parametrize("limit", (0, 10))
def test_other_way_beyond_the_limit(spark, limit):
    docs = documents()
    assert found(spark, docs, ITEMS, known_limit=limit) == found(spark, docs, ITEMS)


def test_given_tables(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
    docs, items = ([tuple(r) for r in read(t).select(c, "text").collect()] for t, c in (("documents", "doc_id"), ("benchmark", "item_id")))
    got = {(r["doc_id"], r["item_id"]) for r in decontam.op7_decontam(spark, "/root/testdata/sf0.001").collect()}
    assert got == brute.contaminated(docs, items) and got


def test_edges(spark):
    docs = spark.createDataFrame([(None, QUESTION, 1, "a"), (1, QUESTION, 2, "b"), (1, QUESTION, 2, "b"), (2, "clean words here", 3, "c"), (3, None, 4, "d")], "doc_id long, text string, hash int, _id string")
    items = spark.createDataFrame([(7, QUESTION, 1), (None, "one two three four five six seven eight nine", 2)], "item_id long, text string, id int")
    assert sorted(((r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, items).collect()), key=str) == [(1, 7), (None, 7)]
    kept = decontam.without_leaks(docs, items)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [2, 3, None]
    assert decontam.contaminated(docs.limit(0), items).count() == 0
    assert decontam.contaminated(docs, items.limit(0)).count() == 0
    assert decontam.without_leaks(docs, items.limit(0)).count() == 5
