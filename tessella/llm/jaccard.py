"""Exact n-gram Jaccard join: documents whose sets of five-word shingles have a similarity of at least 0.8, and
their connected components.

Documents with equal sets are one node. Tokens (shingle hashes) have three global orders: A, rare first, by a
weight that is gathered over the corpus, then by hash; B, ascending hash; C, descending hash. Two sets that are
similar enough share a token in the first ``n - ceil(0.8 n) + 1`` of each under every order. The lists of nodes by
prefix token under A give the candidates; a candidate pair goes on only if the prefixes under B and under C also
overlap, the sizes fit, and the parity bitmaps of the sets, which differ in no more bits than the sets differ in
tokens, leave it possible. All this is tested on numbers kept for each node, before any text moves.

Only components are asked for, so not all pairs of a list are looked at. Each node is compared with one leader, a
member of the lists it is in. After that, in each list of up to ``FEW`` members all pairs in different components are
candidates. A longer list whose members are in different components is split, by this rule: if what x and y share lies
in L, and L is no larger than both, then each is at least as similar to L as they are to each other. So once all
members of a list have been compared with its leader L, a pair that could still join two components

- shares a token outside L. Such pairs meet again in the lists by (L, token), where each node has the first tokens
  under order A of what L hasn't: as many as its prefix has, or all if they are fewer; or
- shares nothing outside L, and one of the two is smaller than L: y then has at most
  ``(1.8 |x and L| - 0.8 |x|) / 0.8`` tokens, and the same holds the other way round. Those nodes meet again in one list for L.

The new lists are treated like the old ones until all lists lie within one component. Rows grow with the lists, not with their squares. After ``ROUNDS`` rounds the pairs that are left are
compared one by one. No list is cut and no pair is left out that could join two components.

A leader's text goes once to each task that compares it, in front of its members, and leaders with many members are
dealt over several tasks. A token with more than one in 100,000 of all tokens is known beforehand, and its list is
dealt out by node as well.

The weight of a token is a sum over batches of documents of its count there, where over one; it is kept for 2**22
hash buckets as a byte each, a fixed 4 MB. It decides only the order, never the result.

Edge cases: null and empty texts have no shingles and link with nothing, with component_id their own id; a text of
fewer than five words has its whole sequence as one shingle; a null id counts as none when the smallest id of a
component is taken; rows repeated under one id are one document more with an equal set. Columns other than the two
named ones are ignored. Shingles are compared by 64-bit hashes (see shingles); whole sets by two of them, so that two
sets with one equal hash stay apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tessella.llm.common import Scratch, releasing, ship_package, small_or_shuffled, table, text_or_empty, written
from tessella.llm.components import components
from tessella.llm.shingles import U, mix, set_hash, shingle_sets

SIZE, PERCENT = 5, 80
BUCKET_BITS, BITMAP_WORDS = 22, 16
#: Tokens counted at once for weights; the share of all tokens, and the count in such a batch, that make a token a frequent one.
COUNTED, FREQUENT, FREQUENT_IN_BATCH = 4_000_000, 1e-5, 8
#: Parts that a frequent token's list is dealt into; members of a leader that one task compares.
PARTS, MEMBERS = 64, 250
#: Members of a list of which all pairs are candidates; rounds of leaders for longer lists before all of their pairs that are left are.
FEW, ROUNDS = 16, 2


def least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def prefix_length(n: int, percent: int) -> int:
    return n - least_overlap(n, percent) + 1


def parity_bitmap(found: np.ndarray) -> np.ndarray:
    """1024 bits; a bit is set if an odd number of tokens fall on it."""
    at = (mix(found ^ U(0xA5A5A5A5A5A5A5A5)) >> U(54)).astype(np.int64)
    odd = (np.bincount(at, minlength=64 * BITMAP_WORDS) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def bucket_of(found: np.ndarray) -> np.ndarray:
    return (found >> U(64 - BUCKET_BITS)).astype(np.int64)


def name_of(found: np.ndarray, clashing: frozenset[int]) -> int:
    """A set's number; sets whose first hash another set has too go by their second."""
    name = set_hash(found)
    return set_hash(found, 1) if name in clashing else name


def rare_first(found: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """The first n tokens of a sorted set under order A."""
    return found[np.argsort(weight[bucket_of(found)], kind="stable")[:n]]


def profiles(docs: DataFrame, id_type: str, size: int) -> DataFrame:
    """docs (id, th, text) -> rows (id, th, n, node, second) for the documents, (bucket, count) for the tokens' weights and (token, count) for tokens that are frequent in a batch."""
    numbers = [pa.field(c, pa.int64()) for c in ("th", "n", "node", "second", "bucket", "token", "count")]

    def counted(kept: list[np.ndarray], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
        tokens, counts = np.unique(np.concatenate(kept), return_counts=True)
        often = counts >= max(FREQUENT_IN_BATCH, FREQUENT * counts.sum())
        over = counts > 1
        buckets, at = np.unique(bucket_of(tokens[over]), return_inverse=True)
        for name, keys, sums in (("bucket", buckets, np.bincount(at, counts[over], len(buckets)).astype(np.int64)), ("token", tokens[often].view(np.int64), counts[often])):
            columns = {name: pa.array(keys), "count": pa.array(sums, pa.int64())}
            yield pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(len(keys), f.type)) for f in arrow], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        kept, held = [], 0
        for batch in batches:
            rows, arrow = batch.num_rows, pa.schema([pa.field("id", batch.column(0).type), *numbers])
            n, node, second = (np.zeros(rows, np.int64) for _ in range(3))
            for k, found in shingle_sets(batch.column(2), size):
                n[k] = len(found)
                if not len(found):
                    continue
                node[k], second[k] = set_hash(found), set_hash(found, 1)
                if int(node[k]) not in seen:
                    seen.add(int(node[k]))
                    kept.append(found)
                    held += len(found)
                    if held >= COUNTED:
                        yield from counted(kept, arrow)
                        kept, held = [], 0
            none = pa.nulls(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(node, mask=n == 0), pa.array(second, mask=n == 0), none, none, none], schema=arrow)
        if kept:
            yield from counted(kept, arrow)

    return docs.mapInArrow(releasing(run), f"id {id_type}, th long, n long, node long, second long, bucket long, token long, count long")


def gathered_weights(rows: DataFrame) -> np.ndarray:
    """rows (bucket, count) -> a byte for each bucket, by the logarithm of its count; no more rows come here than there are buckets."""
    sums = rows.groupBy("bucket").agg(F.sum("count").alias("weight")).toArrow()
    out = np.zeros(1 << BUCKET_BITS, np.uint8)
    out[sums["bucket"].to_numpy()] = np.minimum(255, 4 * np.log2(1 + sums["weight"].to_numpy())).astype(np.uint8)
    return out


def frequent_tokens(rows: DataFrame, total: int) -> np.ndarray:
    """rows (token, count) -> those tokens with a share of at least FREQUENT of all, sorted: at most 1 / FREQUENT."""
    sums = rows.groupBy("token").agg(F.sum("count").alias("n")).filter(F.col("n") >= FREQUENT * total).select("token").toArrow()
    return np.sort(sums["token"].to_numpy().view(np.uint64))


def sorted_in(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of a are in b, for sorted b."""
    return b[np.minimum(b.searchsorted(a), len(b) - 1)] == a if len(b) else np.zeros(len(a), bool)


def prefix_rows(docs: DataFrame, shared, size: int, percent: int) -> DataFrame:
    """(token, node, n): the prefix of each set of n tokens under order A; equal sets of one task give one. The upper half of n has the part of a frequent token's list, else 0."""
    arrow = pa.schema([("token", pa.int64()), ("node", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (weight, frequent, clashing), seen = shared.value, set()

        def batch_of(tokens: list[np.ndarray], nodes: list[int], sizes: list[int]) -> pa.RecordBatch:
            times, flat = [len(t) for t in tokens], np.concatenate(tokens)
            node = np.repeat(np.array(nodes, np.int64), times)
            part = np.where(sorted_in(flat, frequent), 1 + node % PARTS, 0)
            return pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(node), pa.array(np.repeat(np.array(sizes, np.int64), times) | part << 32)], schema=arrow)

        for batch in batches:
            tokens, nodes, sizes, held = [], [], [], 0
            for _, found in shingle_sets(batch.column(0), size):
                n = len(found)
                if not n or (node := name_of(found, clashing)) in seen:
                    continue
                seen.add(node)
                tokens.append(rare_first(found, weight, prefix_length(n, percent)))
                nodes.append(node)
                sizes.append(n)
                held += len(tokens[-1])
                if held >= 500_000:
                    yield batch_of(tokens, nodes, sizes)
                    tokens, nodes, sizes, held = [], [], [], 0
            if tokens:
                yield batch_of(tokens, nodes, sizes)

    return docs.select("text").mapInArrow(releasing(run), "token long, node long, n long")


def node_marks(docs: DataFrame, shared, size: int, percent: int) -> DataFrame:
    """docs (text) -> node and what is tested before texts move: n, bitmap, and the prefixes under orders B and C, by 32 bits of each token."""
    short = lambda tokens: (tokens >> U(32)).astype(np.uint32).view(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clashing, seen = shared.value[2], set()
        for batch in batches:
            nodes, sizes, maps, b, c = [], [], [], [], []
            for _, found in shingle_sets(batch.column(0), size):
                if len(found) and (node := name_of(found, clashing)) not in seen:
                    seen.add(node)
                    p = prefix_length(len(found), percent)
                    for column, value in zip((nodes, sizes, maps, b, c), (node, len(found), parity_bitmap(found), short(found[:p]), short(found[-p:]))):
                        column.append(value)
            lists = [pa.array(maps, pa.list_(pa.int64())), pa.array(b, pa.list_(pa.int32())), pa.array(c, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), *lists], names=["node", "n", "bitmap", "b", "c"])

    return docs.select("text").mapInArrow(releasing(run), "node long, n long, bitmap array<long>, b array<int>, c array<int>")


def node_texts(docs: DataFrame, shared, size: int) -> DataFrame:
    """docs (text) -> node, text: one text of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clashing, seen = shared.value[2], set()
        for batch in batches:
            nodes, at = [], []
            for k, found in shingle_sets(batch.column(0), size):
                if len(found) and (node := name_of(found, clashing)) not in seen:
                    seen.add(node)
                    nodes.append(node)
                    at.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), batch.column(0).take(pa.array(at, pa.int64()))], names=["node", "text"])

    return docs.select("text").mapInArrow(releasing(run), "node long, text string").groupBy("node").agg(F.first("text").alias("text"))


def sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def bits_fit(bits: Column, a: Column, b: Column, percent: int) -> Column:
    """Whether sets of a and b tokens that differ in at least so many can be similar: differing <= (a + b) (100 - percent) / (100 + percent)."""
    return (100 + percent) * bits <= (100 - percent) * (a + b)


def plausible(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """Of pairs (x, leader) of nodes, written, those that sizes, bitmaps and the prefixes under B and C leave possible."""
    of = lambda s: marks.select(F.col("node").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("n", "bitmap", "b", "c")])
    both = small_or_shuffled(pairs).join(of("x"), "x").join(of("leader"), "leader")
    a, b = F.col("n_x"), F.col("n_leader")
    bits = sum((F.bit_count(F.get("bitmap_x", k).bitwiseXOR(F.get("bitmap_leader", k))) for k in range(1, BITMAP_WORDS)), F.bit_count(F.get("bitmap_x", 0).bitwiseXOR(F.get("bitmap_leader", 0))))
    fits = sizes_fit(a, b, percent) & bits_fit(bits, a, b, percent)
    return both.filter(fits & F.arrays_overlap("b_x", "b_leader") & F.arrays_overlap("c_x", "c_leader")).select("x", "leader", F.lit(False).alias("rest"))


def is_similar(shared: int, a: int, b: int, percent: int) -> bool:
    return 100 * shared >= percent * (a + b - shared)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    return is_similar(int(sorted_in(a, b).sum()), len(a), len(b), percent)


def compared(pairs: DataFrame, names: DataFrame, docs: DataFrame, scratch: Scratch, shared, size: int, percent: int) -> DataFrame:
    """pairs (x, leader, rest), written -> for each pair (leader, x, n, n_leader, shared, linked, rest) and, where rest holds, rows (leader, x, n, token) of the first tokens of x under order A that leader hasn't."""
    counts = scratch.written(pairs.groupBy("leader").agg(F.ceil(F.count("*") / MEMBERS).cast("long").alias("parts")), "leaders")
    many = small_or_shuffled(counts.filter("parts > 1"))
    heads = counts.select("leader", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), F.col("leader").alias("node"), F.lit(False).alias("rest"))
    members = pairs.join(many, "leader", "left").select("leader", F.coalesce(F.pmod(F.xxhash64("x"), F.col("parts")), F.lit(0)).alias("part"), F.lit(1).alias("kind"), F.col("x").alias("node"), "rest")
    rows = scratch.written(heads.union(members), "compare")
    needed = scratch.written(rows.select("node").distinct().join(names, "node").select("th").distinct(), "needed")
    texts = node_texts(docs.join(small_or_shuffled(needed), "th", "left_semi"), shared, size)
    rows = small_or_shuffled(rows).join(texts, "node")
    rows = rows.repartition("leader", "part").sortWithinPartitions("leader", "part", "kind").select("leader", "kind", "node", "rest", "text")
    arrow = pa.schema([(c, pa.int64()) for c in ("leader", "x", "n", "n_leader", "shared")] + [("linked", pa.bool_()), ("rest", pa.bool_()), ("token", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, head = shared.value[0], None
        for batch in batches:
            leaders, kinds, nodes, rest = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            out, more = [], []
            for k, found in shingle_sets(batch.column(4), size):
                if kinds[k] == 0:
                    head = found
                    continue
                inside = sorted_in(found, head)
                n, m, both = len(found), len(head), int(inside.sum())
                out.append((leaders[k], nodes[k], n, m, both, is_similar(both, n, m, percent), bool(rest[k])))
                if rest[k]:
                    first = rare_first(found[~inside], weight, prefix_length(n, percent))
                    more.append((leaders[k], nodes[k], n, first.view(np.int64)))
            if out:
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(columns, arrow)), pa.nulls(len(out), pa.int64())], schema=arrow)
            if more:
                times = [len(t) for *_, t in more]
                flat = [pa.array(np.repeat(np.array([r[c] for r in more], np.int64), times)) for c in range(3)]
                none = [pa.nulls(sum(times), arrow.field(c).type) for c in (3, 4, 5, 6)]
                yield pa.RecordBatch.from_arrays([*flat, *none, pa.array(np.concatenate([t for *_, t in more]))], schema=arrow)

    return scratch.written(rows.mapInArrow(releasing(compare), "leader long, x long, n long, n_leader long, shared long, linked boolean, rest boolean, token long"), "compared")


def candidate_lists(docs: DataFrame, shared, size: int, percent: int) -> DataFrame:
    """(key, node, n, rank): the lists by prefix token under order A, without members that have no partner of fitting size. rank says how many of its prefix tokens a node shares."""
    part = F.shiftright("n", 32)
    by_size = Window.partitionBy("token", part).orderBy("n", "node")
    near = {f"{name}_{c}": f(c).over(by_size) for name, f in (("before", F.lag), ("after", F.lead)) for c in ("n", "node")}
    lists = prefix_rows(docs, shared, size, percent).withColumns(near)
    fit = lambda name: (F.col(f"{name}_node") != F.col("node")) & sizes_fit(F.col(f"{name}_n"), F.col("n"), percent)
    lists = lists.filter((part > 0) | fit("before") | fit("after")).select(F.col("token").alias("key"), "node", F.col("n").bitwiseAND(F.lit((1 << 32) - 1)).alias("n")).distinct()
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    share = (1000 * F.count("*").over(Window.partitionBy("node")) / prefix).cast("long")
    return lists.withColumn("rank", F.shiftleft(share, 48).bitwiseOR(F.col("node").bitwiseAND(F.lit((1 << 48) - 1))))


def split_lists(found: DataFrame, percent: int) -> DataFrame:
    """compared pairs -> (key, node, n): where those meet again that could still join components."""
    outside = found.filter("token is not null").select(F.xxhash64("leader", "token").alias("key"), F.col("x").alias("node"), "n")
    most = F.floor(((100 + percent) * F.col("shared") - percent * F.col("n")) / percent)
    rows = found.filter("token is null and rest").select("leader", "x", "n", "n_leader", "linked", most.alias("most"))
    limits = rows.groupBy("leader").agg(F.min("n").alias("least"), F.max(F.when(~F.col("linked"), F.col("most"))).alias("top")).filter("top >= least")
    smaller = rows.join(small_or_shuffled(limits), "leader").filter((~F.col("linked") & (F.col("most") >= F.col("least"))) | ((F.col("n") < F.col("n_leader")) & (F.col("n") <= F.col("top"))))
    return outside.union(smaller.select(F.xxhash64("leader", F.lit("smaller")).alias("key"), F.col("x").alias("node"), "n"))


def joined_roots(roots: DataFrame | None, links: DataFrame, scratch: Scratch) -> DataFrame:
    """roots (node, root) after links (x, y) have joined components; nodes without a row are their own root."""
    if roots is None:
        return components(links)
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    between = links.join(of("x"), "x", "left").join(of("y"), "y", "left").select(F.coalesce("rx", "x").alias("x"), F.coalesce("ry", "y").alias("y"))
    found = components(between)
    to = found.select(F.col("node").alias("root"), F.col("root").alias("top"))
    moved = roots.join(to, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    out = scratch.written(moved.union(found.join(roots, "node", "left_anti").select("node", "root")), "roots")
    scratch.drop(roots)
    return out


def near_components(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """id, n_shingles, component_id (the smallest id of its component) for each document."""
    spark = ship_package(documents.sparkSession)
    scratch = Scratch(spark)
    docs = documents.select(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(text_or_empty(text)).alias("th"), text_or_empty(text).alias("text"))
    profile = scratch.written(profiles(docs, dict(docs.dtypes)["id"], size), "profiles")
    rows = profile.filter("count is null").drop("bucket", "token", "count")
    # sets that share a first hash: some n**2 / 2**65 of n
    clashing = rows.filter("n > 0").groupBy("node").agg(F.min("second").alias("a"), F.max("second").alias("b")).filter("a <> b").select("node").toArrow()["node"].to_pylist()
    if clashing:
        rows = rows.withColumn("node", F.when(F.col("node").isin(clashing), F.col("second")).otherwise(F.col("node")))
    total = rows.agg(F.sum("n")).first()[0] or 0
    shared = spark.sparkContext.broadcast((gathered_weights(profile.filter("bucket is not null")), frequent_tokens(profile.filter("token is not null"), total), frozenset(clashing)))

    lists = scratch.written(candidate_lists(docs, shared, size, percent), "lists")
    names = scratch.written(rows.filter("n > 0").groupBy("node").agg(F.min("th").alias("th")), "names")
    ranks = scratch.written(lists.select("node", "rank").distinct(), "ranks")
    needed = scratch.written(ranks.select("node").join(names, "node").select("th").distinct(), "needed")
    marks = node_marks(docs.join(small_or_shuffled(needed), "th", "left_semi"), shared, size, percent)
    marks = scratch.written(marks.groupBy("node").agg(F.first(F.struct("n", "bitmap", "b", "c")).alias("s")).select("node", "s.*"), "marks")

    # one leader for each node: of those that lead its lists the one that shares most
    leaders = lists.groupBy("key").agg(F.max_by("node", "rank").alias("leader"), F.max("rank").alias("lead"))
    star = lists.select("key", "node").join(leaders, "key").filter("leader <> node").groupBy("node").agg(F.max_by("leader", "lead").alias("leader"))
    star = scratch.written(star.select(F.col("node").alias("x"), "leader"), "star")
    pairs = scratch.written(plausible(star, marks, percent), "pairs")
    found = compared(pairs, names, docs, scratch, shared, size, percent)
    roots = joined_roots(None, found.filter("linked").select("x", F.col("leader").alias("y")), scratch)
    scratch.drop(star, pairs, found)

    for turn in range(ROUNDS + 1):
        known = scratch.written(ranks.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "known")
        with_roots = lists.select("key", "node", "n").join(small_or_shuffled(known), "node")
        spread = with_roots.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.max_by("node", "rank").alias("leader"), F.count("*").alias("members")).filter("a <> b")
        few = (F.col("members") <= FEW) | F.lit(turn == ROUNDS)
        spread = scratch.written(spread.select("key", "leader", few.alias("few")), "spread")
        mixed = scratch.written(with_roots.join(small_or_shuffled(spread), "key").select("key", "node", "n", "root", "leader", "few"), "mixed")
        scratch.drop(lists, known, spread)
        if mixed.isEmpty():
            break
        long = mixed.filter("not few and node <> leader").select(F.col("node").alias("x"), "leader", F.lit(True).alias("rest")).distinct()
        together = scratch.written(all_pairs(mixed.filter("few"), percent), "together")
        pairs = scratch.written(plausible(together, marks, percent).union(long), "pairs")
        found = compared(pairs, names, docs, scratch, shared, size, percent)
        lists = scratch.written(split_lists(found, percent).distinct(), "lists")
        roots = joined_roots(roots, found.filter("linked").select("x", F.col("leader").alias("y")), scratch)
        scratch.drop(mixed, together, pairs, found)

    smallest = rows.filter("n > 0").groupBy("node").agg(F.min("id").alias("id"))
    placed = smallest.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = placed.groupBy("root").agg(F.min("id").alias("component_id"))
    named = placed.join(lowest, "root").select(F.col("node").alias("_node"), "component_id")
    out = rows.select("id", "n", "node").join(named, F.col("node") == F.col("_node"), "left")
    out = scratch.written(out.select("id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id")), "near")
    scratch.close(out)
    return out


def all_pairs(mixed: DataFrame, percent: int) -> DataFrame:
    """All pairs (x, leader) of nodes of fitting size in one list and in different components."""
    side = lambda s: mixed.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "root")])
    fits = (F.col("node_x") < F.col("node_y")) & (F.col("root_x") != F.col("root_y")) & sizes_fit(F.col("n_x"), F.col("n_y"), percent)
    return side("x").join(side("y"), "key").filter(fits).select(F.col("node_x").alias("x"), F.col("node_y").alias("leader")).distinct()


def one_of_each(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of documents but those of a component's documents other than the one with the smallest id; rows of one id stay or go together."""
    found = near_components(documents.filter(F.col(doc_id).isNotNull()), doc_id, text)
    gone = written(found.filter("id <> component_id").select(F.col("id").alias("_id")).distinct(), "gone")
    return documents.join(small_or_shuffled(gone), documents[doc_id] == gone["_id"], "left_anti")


def op5_near_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


#: All pairs of sets of fitting size that share a shingle are compared, which only small tables allow.
OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
p AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w WHERE len(words) >= 5),
g AS (SELECT DISTINCT doc_id, concat_ws(' ', word, w2, w3, w4, w5) AS shingle
      FROM (SELECT doc_id, word, lead(word) OVER o AS w2, lead(word, 2) OVER o AS w3, lead(word, 3) OVER o AS w4, lead(word, 4) OVER o AS w5 FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)) WHERE w5 IS NOT NULL
      UNION ALL SELECT doc_id, array_to_string(words, ' ') FROM w WHERE len(words) BETWEEN 1 AND 4),
s AS (SELECT doc_id, list(shingle ORDER BY shingle) AS shingles FROM g GROUP BY doc_id),
k AS (SELECT shingles, min(doc_id) AS node, len(shingles) AS n FROM s GROUP BY shingles),
t AS (SELECT node, n, unnest(shingles) AS shingle FROM k),
l AS (SELECT a.node AS x, b.node AS y FROM t a JOIN t b ON a.shingle = b.shingle AND a.node < b.node AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
      GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
c AS (SELECT node, node AS other FROM k UNION SELECT c.node, e.y FROM c JOIN e ON c.other = e.x),
m AS (SELECT node, min(other) AS component_id FROM c GROUP BY node)
SELECT d.doc_id, CAST(coalesce(len(s.shingles), 0) AS BIGINT) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id LEFT JOIN k ON s.shingles = k.shingles LEFT JOIN m ON k.node = m.node
"""
