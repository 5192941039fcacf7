"""Sharding by a hierarchical weighted hash tree.

The cluster is a tree: regions hold racks, racks hold shards, and a node's
weight is the sum of the shards below it. A row descends from the root; at each
level every child draws ``-ln(u) / weight`` with ``u`` hashed from the row's key
and the child's own name, and the smallest draw wins. A child wins in
proportion to its weight, and a change of one weight alters one draw, so rows
move only into or out of the subtrees whose weights changed.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.common import table

SLOT_BUCKETS = 1024


@dataclass(frozen=True)
class Node:
    """A region, a rack or (with ``shard`` set) a leaf. Names are unique in the tree."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int | None = None
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def cluster(regions: int = 2, racks: int = 2, shards: int = 2) -> Node:
    """An even tree; shards are numbered from 0 in tree order."""
    number = iter(range(regions * racks * shards))
    return Node("root", tuple(
        Node(f"region{r}", tuple(
            Node(f"region{r}/rack{k}", tuple(Node(f"shard{(i := next(number))}", shard=i) for _ in range(shards)))
            for k in range(racks)))
        for r in range(regions)))


def leaves(node: Node) -> list[Node]:
    return [x for c in node.children for x in leaves(c)] if node.children else [node]


def grow(root: Node, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a rack and a region of its own.

    No weight of another subtree changes, so rows move only into the new shard.
    """
    n = 1 + max(x.shard for x in leaves(root))
    leaf = Node(f"shard{n}", shard=n, own_weight=weight)
    rack = Node(f"region-of-shard{n}/rack", (leaf,))
    return replace(root, children=(*root.children, Node(f"region-of-shard{n}", (rack,))))


def reweigh(node: Node, shard: int, weight: float) -> Node:
    """The tree with another weight for one shard."""
    if not node.children:
        return replace(node, own_weight=weight) if node.shard == shard else node
    return replace(node, children=tuple(reweigh(c, shard, weight) for c in node.children))


def draw(key: Column, node: Node) -> Column:
    """The node's weighted draw: exponential with its weight as the rate."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(node.name)), 11) + 0.5) / float(2**53)
    return -F.log(u) / node.weight


def descend(key: Column, node: Node) -> Column:
    """The shard of a key, by the smallest draw at each level (ties: the first child)."""
    if not node.children:
        return F.lit(node.shard)
    if len(node.children) == 1:
        return descend(key, node.children[0])
    draws = [draw(key, c) for c in node.children]
    best = F.least(*draws)
    out = descend(key, node.children[-1])
    for d, c in reversed(list(zip(draws, node.children, strict=True))[:-1]):
        out = F.when(d == best, descend(key, c)).otherwise(out)
    return out


def number_slots(rows: DataFrame, group: str, order: list[str], spread: list[str], buckets: int = SLOT_BUCKETS) -> DataFrame:
    """Adds ``slot``: gapless numbers from 0 within each value of ``group``.

    No task sees a whole group: rows are dealt by (group, hash bucket), numbered
    there, and shifted by how many rows of the group lie in earlier buckets. The
    counts, at most groups x ``buckets`` rows, join on the columns that the rows are dealt by already.
    """
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(*spread), F.lit(buckets)).cast("int"))
    before = W.partitionBy(group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    start = rows.groupBy(group, "_bucket").count().select(group, "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    here = W.partitionBy(group, "_bucket").orderBy(*order)
    numbered = rows.withColumn("_n", F.row_number().over(here))
    return numbered.join(start, [group, "_bucket"]).withColumn("slot", F.col("_start") + F.col("_n") - 1).drop("_bucket", "_start", "_n")


def shard_documents(docs: DataFrame, root: Node | None = None) -> DataFrame:
    """Places every row of ``docs`` (doc_id, text) by its doc_id, under the law ``key``.

    Edge cases: a null text has size 1 and checksum 0; rows with a null doc_id share
    one shard; repeated rows each get a slot, in any order among equals; an empty
    table gives no rows; other columns are ignored.
    """
    root = root or cluster()
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    rows = rows.withColumns({"law": F.lit("key"), "shard": descend(F.col("doc_id"), root), "grown_shard": descend(F.col("doc_id"), grow(root))})
    return number_slots(rows, "shard", ["doc_id", "text_crc32", "size"], ["doc_id", "text_crc32"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op1_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
