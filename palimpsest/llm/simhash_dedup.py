"""Near-duplicates by SimHash, with a forest of vantage-point trees.

Documents become 64-bit fingerprints; fingerprints link at ``RADIUS`` or fewer
differing bits. The 64 bits are cut into blocks, and a view is some of the blocks: of any two
linked fingerprints some view differs in few bits or none (``Views``), so it is enough to search each
view's own Hamming space with that radius. In each view a vantage-point tree splits
the space: a node has a vantage point and a distance; fingerprints nearer than that
go one way, the rest the other. Each fingerprint lives in one leaf (a shard), and,
by the triangle bound, it need only be compared in leaves that its ball of the view's
radius reaches: it is also sent, as a query, over each boundary that the ball overlaps.
Leaves compare whole fingerprints exactly, so no link is lost and none is invented.

Vantage points come from a hash of the node's number, so that the tree needs no
sample and no driver memory; its depth follows the number of fingerprints. A ball of one bit overlaps a third of the
boundaries, so its copies grow with the depth; with more views the radius is zero and a fingerprint has one copy a view: 5
for up to 4 million fingerprints, 15 for up to a thousand million, then 35.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from palimpsest.llm.common import arrow_map, checkpoint, keep_rows, lowered_words, mix64, table, texts
from palimpsest.llm.components import connected_components

SHINGLE_WORDS = 4
SEED = 42
RADIUS = 4
#: Fingerprints that a leaf is meant to hold; the tree is as deep as that takes.
LEAF_SIZE = 1024
#: Leaves with more fingerprints than this are compared in tiles, each a task's group of its own.
TILE = 4096
#: Parts in which a group's fingerprints are dealt out to learn the group's least doc_id.
SALTS = 32
_HASHES_AT_ONCE = 1 << 16


@dataclass(frozen=True)
class Views:
    """Masks of the views, and the radius in each. Of ``blocks`` blocks RADIUS bits can change so many; a view is some of the others."""

    masks: tuple[int, ...]
    radius: int

    @staticmethod
    def of(blocks: int, together: int = 1) -> Views:
        """Every ``together`` of ``blocks`` blocks. One at a time they have the radius that some block keeps; more need blocks to spare."""
        edges = [64 * i // blocks for i in range(blocks + 1)]
        own = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return Views(tuple(sum(c) for c in combinations(own, together)), RADIUS // blocks if together == 1 else 0)

    @property
    def bits(self) -> int:
        return min(m.bit_count() for m in self.masks)

    def copies(self, depth: int) -> float:
        """A fingerprint's copies, about: at each level a ball of one bit overlaps the boundary for a third of them."""
        return len(self.masks) * (1 + 0.34 * self.radius) ** depth


#: Three blocks, of which RADIUS changes leave one with one change at most; five, of which one is unchanged; six and two; seven and three.
CHOICES = (Views.of(3), Views.of(5), Views.of(6, 2), Views.of(7, 3))


def views_for(depth: int) -> Views:
    """The views with the fewest copies among those whose bits suffice for trees of this depth."""
    return min((v for v in CHOICES if v.bits >= depth), key=lambda v: v.copies(depth), default=CHOICES[-1])


def simhash(tokens: list[bytes], width: int = SHINGLE_WORDS) -> int:
    """The fingerprint of a word sequence; without words it is 0."""
    if not tokens:
        return 0
    n = len(tokens) - width + 1
    shingles = map(b" ".join, zip(*(tokens[i:] for i in range(width)))) if n > 0 else iter([b" ".join(tokens)])
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64, max(n, 1))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _HASHES_AT_ONCE):
        part = hashes[i : i + _HASHES_AT_ONCE]
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(len(part), 64).sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, text_hash): fp is the fingerprint as a signed long."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.fromiter((simhash(lowered_words(t)) for t in texts(b)), np.uint64, b.num_rows)
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64)), b.column("text_hash")], ["doc_id", "fp", "text_hash"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash")), batch, "doc_id long, fp long, text_hash long")


def vantage_points(nodes: np.ndarray, views: Views, view: int) -> np.ndarray:
    """Each node's vantage point, in the view's bits."""
    with np.errstate(over="ignore"):
        return mix64(nodes.astype(np.uint64) * np.uint64(len(views.masks)) + np.uint64(view)) & np.uint64(views.masks[view])


def descend(fp: np.ndarray, views: Views, view: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaves that each fingerprint's ball reaches: (index into fp, leaf, whether it is the one it lives in)."""
    mask, radius = np.uint64(views.masks[view]), views.radius
    near = (views.masks[view].bit_count() - 1) // 2
    at, node, home = np.arange(len(fp)), np.ones(len(fp), np.int64), np.ones(len(fp), bool)
    for _ in range(depth):
        d = np.bitwise_count((fp[at] ^ vantage_points(node, views, view)) & mask).astype(np.int64)
        inside, left, right = d <= near, d - radius <= near, d + radius > near
        at = np.concatenate([at[left], at[right]])
        home = np.concatenate([(home & inside)[left], (home & ~inside)[right]])
        node = np.concatenate([2 * node[left], 2 * node[right] + 1])
    return at, node, home


def in_leaves(distinct: DataFrame, views: Views, depth: int, homes_only: bool = False) -> DataFrame:
    """(view, leaf, fp, home) for every view."""

    def batch(b: pa.RecordBatch) -> pa.Table:
        fp = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        parts = []
        for view in range(len(views.masks)):
            at, leaf, home = descend(fp, views, view, depth)
            if homes_only:
                at, leaf, home = at[home], leaf[home], home[home]
            parts.append(pa.table({"view": np.full(len(at), view, np.int32), "leaf": leaf, "fp": fp[at].view(np.int64), "home": home}))
        return pa.concat_tables(parts)

    return arrow_map(distinct.select("fp"), batch, "view int, leaf long, fp long, home boolean")


def _forest(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Labels (the least index of each component) after the pairs a-b join."""
    while True:
        la, lb = label[a], label[b]
        if (differ := la != lb).any():
            low, high = np.minimum(la, lb)[differ], np.maximum(la, lb)[differ]
            np.minimum.at(label, high, low)
            while (label != (up := label[label])).any():
                label = up
        else:
            return label


def leaf_links(homes: np.ndarray, queries: np.ndarray, radius: int = RADIUS, rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Star links (fingerprint, least fingerprint linked with it here) over all pairs home-query within the radius.

    Both sides are sorted by their distance from one vantage point; by the triangle
    bound a block of homes meets only the queries whose distance is within the radius.
    """
    nodes = np.unique(np.concatenate([homes, queries]))
    label, vantage = np.arange(len(nodes)), nodes[len(nodes) // 2]
    ordered = []
    for side in (homes, queries):
        d = np.bitwise_count(side ^ vantage).astype(np.int64)
        order = np.argsort(d, kind="stable")
        ordered.append((d[order], side[order], np.searchsorted(nodes, side[order])))
    (dh, h, ih), (dq, q, iq) = ordered
    for i in range(0, len(h), rows):
        block = slice(i, i + rows)
        lo, hi = np.searchsorted(dq, dh[block][0] - radius), np.searchsorted(dq, dh[block][-1] + radius, "right")
        a, b = np.nonzero(np.bitwise_count(h[block, None] ^ q[None, lo:hi]) <= radius)
        a, b = ih[block][a], iq[lo:hi][b]
        if (pairs := a != b).any():
            label = _forest(a[pairs], b[pairs], label)
    linked = np.nonzero(label != np.arange(len(nodes)))[0]
    return nodes[linked], nodes[label[linked]]


def fingerprint_links(distinct: DataFrame, count: int, leaf_size: int = LEAF_SIZE, tile: int = TILE, views: Views | None = None) -> DataFrame:
    """(u, v) star links whose components are those of all pairs within RADIUS bits.

    ``count`` is the number of rows of ``distinct``; it sets the depth of the trees.
    """
    depth = max(0, math.ceil(math.log2(max(count, 1) / leaf_size)))
    views = views or views_for(depth)
    rows = in_leaves(distinct, views, depth)
    sizes = in_leaves(distinct, views, depth, homes_only=True).groupBy("view", "leaf").count()
    largest = sizes.agg(F.max("count")).first()[0] or 0
    if largest > tile:
        tiles = sizes.where(F.col("count") > tile).select("view", "leaf", F.ceil(F.col("count") / tile).cast("int").alias("cuts"))
        rows = rows.join(tiles, ["view", "leaf"], "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
        own = F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int")
        every = F.sequence(F.lit(0), F.col("cuts") - 1)
        # A home is in one row of tiles, with every block of queries; a query is in one column, with every block of homes.
        roles = F.when(F.col("home"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))
        rows = rows.withColumn("home", F.explode(roles)).withColumn("home_tile", F.explode(F.when(F.col("home"), F.array(own)).otherwise(every)))
        rows = rows.withColumn("query_tile", F.explode(F.when(F.col("home"), every).otherwise(F.array(own)))).drop("cuts")
    else:
        rows = rows.withColumns({"home_tile": F.lit(0), "query_tile": F.lit(0)})

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        fp, home = group["fp"].to_numpy().view(np.uint64), group["home"].to_numpy()
        u, v = leaf_links(fp[home], fp if largest <= tile else fp[~home])
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    return rows.groupBy("view", "leaf", "home_tile", "query_tile").applyInPandas(compare, "u long, v long")


def with_components(prints: DataFrame) -> DataFrame:
    """``prints`` with ``root``, the least fingerprint that links reach, and ``component_id``, the least doc_id there."""
    distinct = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    links = fingerprint_links(distinct, distinct.count())
    roots = connected_components(links).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    placed = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    groups = placed.groupBy("root").agg(F.min("least").alias("group_least"), F.count("*").alias("members")).where("members > 1")
    # A group may hold a third of all fingerprints: they meet their group's row in SALTS parts.
    salted = groups.select("root", "group_least", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    component = placed.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).join(salted, ["root", "salt"], "left")
    return prints.join(component.select("fp", "root", F.coalesce("group_least", "least").alias("component_id")), "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs`` (doc_id, text).

    component_id is the least doc_id that links reach. Equal fingerprints are one
    vertex, so copies never become pairs.

    Edge cases: null and empty texts, and texts of white space, have fingerprint 0 and
    link like any other; fewer than four words are one shingle; rows that repeat a
    doc_id are kept; a null doc_id is never the least while there is another; an empty
    table gives no rows; other columns are ignored.
    """
    return with_components(checkpoint(fingerprints(docs))).select("doc_id", "fp", "component_id")


def op2_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each group stays: that of the least doc_id (then of the least text hash).

    Columns are those of ``docs``. A row is known by its doc_id and its text, so of rows
    that repeat both only one stays; rows without a doc_id come after all others.
    """
    prints = checkpoint(fingerprints(docs))
    keys = {"no_id": F.col("doc_id").isNull(), "id": F.coalesce("doc_id", F.lit(0)), "text_hash": F.col("text_hash")}
    rows = with_components(prints).select("root", *(c.alias(k) for k, c in keys.items()))
    first = rows.groupBy("root").agg(F.min(F.struct(*keys)).alias("first")).select("first.*")
    return keep_rows(docs, rows.select(*keys), first)
