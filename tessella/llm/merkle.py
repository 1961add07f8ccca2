"""Merkle manifest: a digest for each document, one for each group of them and one for the whole table, with proofs.

A leaf is the SHA-256 of a document's fields, each ``-`` if null, else its bytes in UTF-8, counted, ``:`` and the
value. Digests are lowercase hexadecimal text and are hashed as such. The leaves of a group stand in order; every two
neighbours become the hash of both, a last one alone becomes its own hash, until one is left: the group's root. The
groups' roots, ordered by group (null first, by UTF-8 bytes), make the table's root in the same way.

Method: leaves are numbered by a range partitioning and cut into aligned blocks of ``2 ** BLOCK`` leaves. Within a block
a fractal traversal goes through the leaves in order: of the block's tree, cut into stacked subtrees of ``STACKED``
levels, it keeps at each level the existing subtree, which has the siblings of the leaf at hand, and the desired one,
which is grown by two steps of tree hashing for each leaf, so it is there when the existing one has been gone through. It
gives each leaf's authentication path inside the block; a task never holds more than a block's digests and two
subtrees for each level. The blocks' roots are leaves of the upper tree, worked out the same way, round by round, and its
paths are appended by a join on the block. Nothing passes through the driver but the largest number of blocks.

A path is a list of siblings from the leaf up, each with ``<`` before it if it stands left of the node, else ``>``; a
sibling that isn't there is empty. So a lone node and a pair are hashed alike: the hash of what is there.

Edge cases: any field may be null; leaves are ordered by ``doc_id``, null first, then by leaf, so rows that agree in all
fields are interchangeable and each gets a proof; a group of one row has its leaf as root; an empty table gives no
rows; texts are hashed whole; columns other than the named ones are ignored. Tampering leaves a null doc_id alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, ship_package, small_or_shuffled, table

#: Levels of a block, and of one of the subtrees that are stacked in it.
BLOCK, STACKED = 10, 2
#: Groups whose proofs (some 70 bytes a level) may be sent whole to every executor.
BROADCAST_GROUPS = 20_000


def digest_of(*fields: Column) -> Column:
    """The leaf of fields, in this order."""
    told = lambda c: F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))
    return F.sha2(F.concat(*[told(c.cast("string")) for c in fields]).cast("binary"), 256)


def parent(left: str, right: str) -> str:
    return sha256((left + right).encode()).hexdigest() if left else ""


class Growing:
    """A subtree from height low to high over the leaves from first on, built by tree hashing, one leaf or one merge a step."""

    def __init__(self, leaves: list[str], low: int, high: int, first: int):
        self.leaves, self.low, self.high = leaves, low, high
        self.at, self.end = first, first + (1 << high)
        self.stack: list[tuple[int, int, str]] = []
        self.nodes: dict[tuple[int, int], str] = {}

    def step(self, steps: int) -> None:
        for _ in range(steps):
            if len(self.stack) > 1 and self.stack[-1][0] == self.stack[-2][0]:
                (height, _, right), (_, index, left) = self.stack.pop(), self.stack.pop()
                height, index, node = height + 1, index // 2, parent(left, right)
            elif self.at < self.end:
                height, index, node = 0, self.at, self.leaves[self.at] if self.at < len(self.leaves) else ""
                self.at += 1
            else:
                return
            self.stack.append((height, index, node))
            if self.low <= height < self.high:
                self.nodes[height, index] = node


def traverse(leaves: list[str], height: int, stacked: int = STACKED) -> Iterator[tuple[list[str], str]]:
    """The authentication path of each leaf of one tree of at most 2 ** height leaves, from the first on, and the tree's root."""
    whole = Growing(leaves, height, height + 1, 0)
    whole.end = 1 << height
    whole.step(2 << height)
    root = whole.stack[0][2]
    levels = [(low, min(low + stacked, height)) for low in range(0, height, stacked)]
    existing, desired = [], []
    for low, high in levels:
        first = Growing(leaves, low, high, 0)
        first.step(2 << high)
        existing.append(first.nodes)
        desired.append(Growing(leaves, low, high, 1 << high))
    for i in range(len(leaves)):
        path = []
        for nodes, (low, high) in zip(existing, levels):
            path += [("<" if i >> h & 1 else ">") + nodes[h, (i >> h) ^ 1] for h in range(low, high)]
        yield path, root
        for k, (low, high) in enumerate(levels):
            if desired[k].end - (1 << high) < len(leaves):
                desired[k].step(2)
            if (i + 1) % (1 << high) == 0:
                existing[k], desired[k] = desired[k].nodes, Growing(leaves, low, high, i + 1 + (1 << high))


def numbered(df: DataFrame, scratch: Scratch, by: list[str], order: list[str]) -> DataFrame:
    """df with pos (from 0) and n (rows) within by, in the order of order, then any."""
    rows = df.withColumn("_tie", F.monotonically_increasing_id())
    keys = [*by, *order, "_tie"]
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie").withColumn("_at", F.monotonically_increasing_id())
    rows = scratch.written(rows, "numbered").withColumn("_part", F.shiftright("_at", 33))
    parts = rows.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    within = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_rows").over(within.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = scratch.written(parts.select(*by, "_part", "_first", before.alias("_before"), F.sum("_rows").over(within).alias("n")), "parts")
    rows = rows.join(small_or_shuffled(parts), [*by, "_part"])
    return rows.withColumn("pos", F.col("_before") + F.col("_at") - F.col("_first")).drop("_at", "_part", "_first", "_before")


def climbed(nodes: DataFrame, block: int) -> DataFrame:
    """nodes (tree, pos, n, digest and others) with path and top: the path within the block of 2 ** block, and the block's root."""
    ship_package(nodes.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        height = min(block, int(pdf["n"].iloc[0] - 1).bit_length())
        pdf["path"], pdf["top"] = zip(*traverse(pdf["digest"].tolist(), height))
        return pdf.drop(columns="_block")

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema) + ", path array<string>, top string"
    return nodes.withColumn("_block", F.shiftright("pos", block)).groupBy("tree", "_block").applyInPandas(run, schema)


def blocks_of(done: DataFrame, block: int) -> DataFrame:
    """What climbed gives, as the nodes of the upper tree: (tree, pos, n, digest)."""
    first = done.filter(F.col("pos").bitwiseAND((1 << block) - 1) == 0)
    return first.select("tree", F.shiftright("pos", block).alias("pos"), F.shiftright(F.col("n") + (1 << block) - 1, block).alias("n"), F.col("top").alias("digest"))


def proofs(nodes: DataFrame, scratch: Scratch, block: int) -> DataFrame:
    """(tree, pos, path, root) of nodes (tree, pos, n, digest): the whole path up to the tree's root."""
    if (nodes.agg(F.max("n")).first()[0] or 1) == 1:
        return nodes.select("tree", "pos", F.array().cast("array<string>").alias("path"), F.col("digest").alias("root"))
    done = scratch.written(climbed(nodes, block), "climbed")
    upper = proofs(scratch.written(blocks_of(done, block), "blocks"), scratch, block)
    upper = upper.select("tree", F.col("pos").alias("_block"), F.col("path").alias("_path"), "root")
    done = done.withColumn("_block", F.shiftright("pos", block)).join(upper, ["tree", "_block"])
    return scratch.written(done.select("tree", "pos", F.concat("path", "_path").alias("path"), "root"), "proofs")


def manifest(leaves: DataFrame, group: str, order: str, leaf: str, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """leaves with path (to the table's root), subroot and root."""
    others = [c for c in leaves.columns if c != leaf]
    tree = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    rows = leaves.select(tree.alias("tree"), F.col(order).alias("_order"), F.col(leaf).alias("digest"), F.struct(*others).alias("row"))
    rows = numbered(rows, scratch, ["tree"], ["_order", "digest"]).drop("_order")
    done = scratch.written(climbed(rows, block), "leaves")
    blocks = proofs(scratch.written(blocks_of(done, block), "blocks"), scratch, block)
    roots = blocks.filter("pos = 0").select(F.lit("").alias("tree"), F.col("tree").alias("group"), F.col("root").alias("digest"))
    roots = numbered(roots, scratch, ["tree"], ["group"])
    upper = proofs(roots.drop("group"), scratch, block).select("pos", F.col("path").alias("_upper"), F.col("root").alias("top_root"))
    upper = scratch.written(roots.join(upper, "pos").select(F.col("group").alias("tree"), "_upper", "top_root"), "roots")
    blocks = blocks.join(small_or_shuffled(upper, BROADCAST_GROUPS), "tree")
    blocks = blocks.select("tree", F.col("pos").alias("_block"), F.concat("path", "_upper").alias("_path"), F.col("root").alias("subroot"), F.col("top_root").alias("root"))
    out = done.withColumn("_block", F.shiftright("pos", block)).join(blocks, ["tree", "_block"])
    return out.select(*[f"row.`{c}`" for c in others], F.col("digest").alias(leaf), F.concat("path", "_path").alias("path"), "subroot", "root")


def proof_digest(path: Column) -> Column:
    """The hash of a path's siblings."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.substr(s, F.lit(2))), "").cast("binary"), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path make."""
    beside = lambda s: F.substr(s, F.lit(2))
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.when(F.startswith(s, F.lit("<")), F.concat(beside(s), node)).otherwise(F.concat(node, beside(s))).cast("binary"), 256))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    name, more = F.col("doc_id").cast("long").cast("string"), F.col("n_chars").cast("decimal(20,0)") + 1
    leaf = lambda n: digest_of(name, F.col("source"), F.col("lang"), n, F.col("text"))
    picked = F.crc32(name.cast("binary")) % 7 == 0
    leaves = docs.select("doc_id", "lang", leaf(F.col("n_chars").cast("long")).alias("leaf"), F.when(picked, leaf(more)).alias("tampered"))
    out = manifest(scratch.written(leaves, "digests"), "lang", "doc_id", "leaf", scratch)
    out = out.withColumns({"proof_sha256": proof_digest(F.col("path")), "folded_root": folded(F.coalesce("tampered", "leaf"), F.col("path"))})
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


OP11_SQL = r"""
WITH RECURSIVE bits AS (SELECT list(c ORDER BY i) AS crc FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
told AS (SELECT doc_id, lang, n_chars, '' || CASE WHEN doc_id IS NULL THEN '-' ELSE length(CAST(doc_id AS VARCHAR)) || ':' || doc_id END
    || CASE WHEN source IS NULL THEN '-' ELSE octet_length(encode(source)) || ':' || source END || CASE WHEN lang IS NULL THEN '-' ELSE octet_length(encode(lang)) || ':' || lang END AS head,
  CASE WHEN text IS NULL THEN '-' ELSE octet_length(encode(text)) || ':' || text END AS tail,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0 AND doc_id IS NOT NULL AS picked FROM documents, bits),
leaves AS (SELECT doc_id, lang, sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE length(CAST(n_chars AS VARCHAR)) || ':' || n_chars END || tail) AS leaf,
  CASE WHEN picked AND n_chars IS NOT NULL THEN sha256(head || length(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1) || tail) END AS tampered FROM told),
g AS (SELECT DISTINCT lang FROM leaves),
gi AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM g),
l AS (SELECT doc_id, tree, leaf, tampered, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n
  FROM leaves JOIN gi ON leaves.lang IS NOT DISTINCT FROM gi.lang),
a AS (SELECT tree, 0 AS lvl, i, n, leaf AS h FROM l
  UNION ALL SELECT tree, lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM a WHERE n > 1 GROUP BY tree, lvl, i // 2, n),
sub AS (SELECT tree, h AS subroot FROM a WHERE n = 1),
b AS (SELECT 0 AS lvl, tree AS i, (SELECT count(*) FROM sub) AS n, subroot AS h FROM sub
  UNION ALL SELECT lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM b WHERE n > 1 GROUP BY lvl, i // 2, n),
top AS (SELECT h AS root FROM b WHERE n = 1),
p AS (SELECT tree, i AS leaf_i, 0 AS lvl, i AS spot, n, '' AS sibs, coalesce(tampered, leaf) AS f FROM l
  UNION ALL SELECT p.tree, leaf_i, p.lvl + 1, spot // 2, (p.n + 1) // 2, sibs || coalesce(s.h, ''), sha256(CASE WHEN spot % 2 = 1 THEN s.h || f ELSE f || coalesce(s.h, '') END)
  FROM p LEFT JOIN a s ON s.tree = p.tree AND s.lvl = p.lvl AND s.i = xor(spot, 1) WHERE p.n > 1),
q AS (SELECT tree, leaf_i, 0 AS lvl, tree AS spot, (SELECT count(*) FROM sub) AS n, sibs, f FROM p WHERE n = 1
  UNION ALL SELECT tree, leaf_i, q.lvl + 1, spot // 2, (q.n + 1) // 2, sibs || coalesce(s.h, ''), sha256(CASE WHEN spot % 2 = 1 THEN s.h || f ELSE f || coalesce(s.h, '') END)
  FROM q LEFT JOIN b s ON s.lvl = q.lvl AND s.i = xor(spot, 1) WHERE q.n > 1)
SELECT doc_id, leaf, subroot, root, sha256(sibs) AS proof_sha256, f AS folded_root, f = root AS verified
FROM l JOIN q ON q.tree = l.tree AND q.leaf_i = l.i AND q.n = 1 JOIN sub ON sub.tree = l.tree, top
"""
