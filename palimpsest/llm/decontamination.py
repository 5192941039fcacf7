"""Benchmark decontamination: documents that hold a benchmark item, or nearly so.

A window as long as an item slides over a document, word by word. At a similarity of 0.8 a window lacks at most a fifth of
its item's shingles, so it holds one of any shingles that are more than a fifth: of each item the rarest are indexed
(``rarest``), and an item's windows are those with one of them. Each such window's SimHash is compared with its item's, and
where they are within the radius, the weighted shingles are: the sum of the lesser counts over the sum of the greater ones.

A benchmark of up to ``BLOCK_BYTES`` goes to the tasks. A greater one is a table: one pass over the documents finds their
indexed shingles behind a bitmap of bounded size, joins give pairs of document and item, and each pair is verified.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from palimpsest.llm.common import arrow_map, checkpoint, mix64, table, texts

SHINGLE_WORDS = 5
#: The least similarity, as a fraction.
SIMILARITY = (4, 5)
#: At the least similarity, windows differ from their item in 9 bits on the average, 3 more or less.
RADIUS = 20
#: Bytes of benchmark text that go to the tasks; a greater benchmark is joined.
BLOCK_BYTES = 16 << 20
#: Bits of the bitmap of indexed shingles: so many a shingle, a power of two, at most MOST_BITS.
BITS_EACH, MOST_BITS, CHUNK_BITS = 64, 1 << 29, 1 << 20
WINDOWS_AT_ONCE = 4096
#: Dropped from both ends of a word; what is nothing else is no word.
PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def tokens(text: bytes) -> list[bytes]:
    """Words with A-Z lowered and ASCII punctuation stripped."""
    return [w for w in (x.strip(PUNCTUATION) for x in text.lower().split()) if w]


def word_hashes(some: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, some), np.uint64, len(some))


def shingle_hashes(hashed: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of ``width`` words, from the words' hashes."""
    out = np.zeros(max(len(hashed) - width + 1, 0), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out = mix64(out + hashed[i : i + len(out)])
    return out


def bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(len(hashes), 64)


def fingerprints(ones: np.ndarray, n: int) -> np.ndarray:
    """A bit is 1 if it is set in over half of the n hashes."""
    return np.packbits(2 * ones > n, axis=1, bitorder="little").view(np.uint64).ravel()


def similarity(a: Counter, b: Counter) -> float:
    shared = sum((a & b).values())
    return shared / (a.total() + b.total() - shared)


def shingles(some: list[bytes]) -> Counter:
    width = min(SHINGLE_WORDS, len(some))
    return Counter(zip(*(some[i : len(some) - width + 1 + i] for i in range(width)), strict=True))


def print_of(words: list[bytes]) -> np.ndarray:
    hashes = shingle_hashes(word_hashes(words), min(SHINGLE_WORDS, len(words)))
    return fingerprints(bits(hashes).sum(0, dtype=np.int64)[None], len(hashes))[0]


def spared(n: int) -> int:
    """Of an item's n shingles, as many may a similar window lack at most."""
    return n * (SIMILARITY[1] - SIMILARITY[0]) // SIMILARITY[1]


def rarest(own: Counter, holders: Counter) -> list[int]:
    """The shingle hashes (own: how often the item has each) of which a similar window holds one: those that fewest items have."""
    out, weight, limit = [], 0, spared(own.total())
    for h in sorted(own, key=lambda x: (holders[x], x)):
        out.append(h)
        weight += own[h]
        if weight > limit:
            break
    return out


def best_window(words: list[bytes], hashed: np.ndarray, item: list[bytes], counts: Counter, print_: np.uint64, starts: np.ndarray) -> tuple[float, int, int] | None:
    """(similarity, first word, words) of the most similar window among ``starts``, the first of equals; None below the least similarity."""
    length, width = min(len(item), len(words)), min(SHINGLE_WORDS, len(item))
    per, best = length - width + 1, None
    if per <= 0:
        return None
    for some in _near_runs(starts, len(item)):
        sums = np.concatenate([np.zeros((1, 64), np.int64), np.cumsum(bits(shingle_hashes(hashed[some[0] : some[-1] + length], width)), axis=0, dtype=np.int64)])
        at = some - some[0]
        near = np.bitwise_count(fingerprints(sums[at + per] - sums[at], per) ^ print_) <= RADIUS
        for first in some[near].tolist():
            s = similarity(counts, shingles_of(words[first : first + length], width))
            if SIMILARITY[1] * s >= SIMILARITY[0] and (best is None or s > best[0]):
                best = (s, first, length)
    return best


class Benchmark:
    """Items as the tasks use them."""

    def __init__(self, items: list[tuple[int, str]]):
        split = [(i, w) for i, t in items if (w := tokens((t or "").encode()))]
        self.ids, self.words = [i for i, _ in split], [w for _, w in split]
        self.counts, self.prints = [shingles(w) for w in self.words], [print_of(w) for w in self.words]
        self.vocabulary = {w: 1 + k for k, w in enumerate(sorted({x for w in self.words for x in w}))} | {b"": -1}
        own = word_hashes(sorted(self.vocabulary.keys() - {b""}))
        self.hash_of = np.concatenate([np.zeros(1, np.uint64), own])
        hashes = [Counter(shingle_hashes(word_hashes(w), min(SHINGLE_WORDS, len(w))).tolist()) for w in self.words]
        holders = Counter(h for own in hashes for h in own)
        having = defaultdict(lambda: defaultdict(list))
        for k, own in enumerate(hashes):
            for h in rarest(own, holders):
                having[min(SHINGLE_WORDS, len(self.words[k]))][h].append(k)
        #: By shingle width: indexed hashes in order, and the items that have each.
        self.index = {width: (np.array(sorted(h), np.uint64), [h[x] for x in sorted(h)]) for width, h in having.items()}

    def starts(self, text: bytes) -> dict[int, np.ndarray]:
        """By item: where windows begin that hold one of its indexed shingles (by hash)."""
        known = self.vocabulary
        ids = np.fromiter([known.get(w.strip(PUNCTUATION), 0) for w in text.lower().split()], np.int64)
        ids = ids[ids >= 0]
        out = defaultdict(list)
        for width, (hashes, having) in self.index.items():
            n = len(ids) - width + 1
            if n <= 0:
                continue
            inside = np.concatenate([[0], np.cumsum(ids > 0)])
            at = np.flatnonzero(inside[width:] - inside[:-width] == width)
            if not len(at):
                continue
            own = np.zeros(len(at), np.uint64)
            with np.errstate(over="ignore"):
                for i in range(width):
                    own = mix64(own + self.hash_of[ids[at + i]])
            place = np.searchsorted(hashes, own)
            place[place == len(hashes)] = 0
            for p, k in zip(at[hit := hashes[place] == own].tolist(), place[hit].tolist(), strict=True):
                for item in having[k]:
                    out[item].append(around(p, width, len(self.words[item]), len(ids)))
        return {item: _covered(spans) for item, spans in out.items()}

    def matches(self, text: bytes) -> list[tuple[int, float, int, int]]:
        """(item, similarity, first word, words) for each item that the text holds: its most similar window."""
        found = self.starts(text)
        if not found:
            return []
        words = tokens(text)
        hashed, best = word_hashes(words), {}
        for k, starts in found.items():
            b = best_window(words, hashed, self.words[k], self.counts[k], self.prints[k], starts)
            # Of repeated items the most similar, then the earliest window counts.
            if b and (self.ids[k] not in best or (-b[0], b[1]) < (-best[self.ids[k]][0], best[self.ids[k]][1])):
                best[self.ids[k]] = b
        return [(i, *b) for i, b in sorted(best.items(), key=lambda x: (x[0] is None, x[0]))]


def around(place: int, width: int, size: int, words: int) -> tuple[int, int]:
    """The first and last start of a window of ``size`` words that holds the shingle at ``place``, in a text of so many words."""
    last = max(words - size, 0)
    return max(0, min(place - size + width, last)), min(place, last)


def shingles_of(some: list[bytes], width: int) -> Counter:
    return Counter(zip(*(some[i : len(some) - width + 1 + i] for i in range(width)), strict=True))


def _covered(spans: list[tuple[int, int]]) -> np.ndarray:
    """The integers in any of the closed spans, in order."""
    edges = np.zeros(max(b for _, b in spans) + 2, np.int64)
    first, last = np.array(spans).T
    np.add.at(edges, first, 1)
    np.add.at(edges, last + 1, -1)
    return np.flatnonzero(np.cumsum(edges) > 0)


def _near_runs(starts: np.ndarray, size: int) -> list[np.ndarray]:
    """The starts in runs of a bounded length without wide gaps."""
    runs = np.split(starts, np.flatnonzero(np.diff(starts) > size) + 1)
    return [r[i : i + WINDOWS_AT_ONCE] for r in runs for i in range(0, len(r), WINDOWS_AT_ONCE)]


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null")


def small_benchmark(benchmark: DataFrame) -> Broadcast | None:
    """The items for the tasks, or None where they pass BLOCK_BYTES."""
    items = _items(benchmark)
    if (items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0) > BLOCK_BYTES:
        return None
    return benchmark.sparkSession.sparkContext.broadcast(Benchmark([(r["item_id"], r["text"]) for r in items.collect()]))


SCHEMA = "doc_id long, item_id long, similarity double, first_word long, n_words long"
_FIELDS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64())])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): each item that a row of ``docs`` holds.

    Edge cases: null, empty and blank texts on either side match nothing; an item of fewer
    than five words is one shingle; a document shorter than an item is one window; of
    equally similar windows the first counts; repeated documents are reported each,
    repeated items once; empty tables give no rows; other columns are ignored.
    """
    rows, shared = docs.select(F.col("doc_id").cast("long"), "text"), small_benchmark(benchmark)
    if shared is None:
        found = found_by_join(rows.withColumn("row", F.monotonically_increasing_id()), benchmark)
        return found.select([f.name for f in _FIELDS])

    def batch(b: pa.RecordBatch) -> pa.Table:
        found = [(d, *m) for d, t in zip(b.column("doc_id").to_pylist(), texts(b), strict=True) for m in shared.value.matches(t)]
        return pa.Table.from_pylist([dict(zip(_FIELDS.names, f, strict=True)) for f in found], schema=_FIELDS)

    return arrow_map(rows, batch, SCHEMA)


def _shingle_keys(words: list[bytes], width: int) -> np.ndarray:
    """The hashes of a text's shingles; those of fewer than five words differ from the others."""
    hashes = shingle_hashes(word_hashes(words), width)
    return hashes if width == SHINGLE_WORDS else mix64(hashes + np.uint64(width))


def indexed_shingles(items: DataFrame) -> DataFrame:
    """(key, item): of each item (item, text) the rarest shingles, of which a similar window holds one."""

    def batch(b: pa.RecordBatch) -> pa.Table:
        rows = []
        for item, text in zip(b.column("item").to_pylist(), texts(b), strict=True):
            if words := tokens(text):
                own = Counter(_shingle_keys(words, min(SHINGLE_WORDS, len(words))).view(np.int64).tolist())
                rows += [(item, key, n, spared(own.total())) for key, n in own.items()]
        return pa.table([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names=["item", "key", "n", "limit"])

    every = checkpoint(arrow_map(items, batch, "item long, key long, n long, limit long"))
    ranked = every.join(every.groupBy("key").agg(F.count("*").alias("holders")), "key")
    before = F.coalesce(F.sum("n").over(W.partitionBy("item").orderBy("holders", "key").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return ranked.withColumn("before", before).where(F.col("before") <= F.col("limit")).select("key", "item")


def bitmap_of(keys: DataFrame) -> np.ndarray:
    """The bits that the keys set, as bytes: a power of two of bits, by the number of keys."""
    n = keys.count()
    size = min(MOST_BITS, max(CHUNK_BITS, 1 << (BITS_EACH * n).bit_length()))

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(CHUNK_BITS, bool)
        own[group["bit"].to_numpy() % CHUNK_BITS] = True
        return pd.DataFrame({"chunk": group["chunk"].iloc[:1], "bits": [np.packbits(own, bitorder="little").tobytes()]})

    bit = F.col("key").bitwiseAND(size - 1)
    chunks = keys.select(bit.alias("bit")).distinct().withColumn("chunk", F.floor(F.col("bit") / CHUNK_BITS)).groupBy("chunk").applyInPandas(merge, "chunk long, bits binary").collect()
    out = np.zeros(size // 8, np.uint8)
    for r in chunks:
        out[r["chunk"] * CHUNK_BITS // 8 :][: CHUNK_BITS // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def found_by_join(rows: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(row, and the columns of ``contaminated``) for ``rows`` (row, doc_id, text), with the items as a table: one pass over the texts."""
    items = checkpoint(_items(benchmark).distinct().withColumn("item", F.monotonically_increasing_id()))
    index = checkpoint(indexed_shingles(items.select("item", "text")))
    context = rows.sparkSession.sparkContext
    bitmap = context.broadcast(bitmap_of(index.select("key").distinct()))
    least = items.agg(F.min(F.size(F.split(F.trim("text"), r"\s+")))).first()[0] or SHINGLE_WORDS
    widths = range(min(least, SHINGLE_WORDS), SHINGLE_WORDS + 1)

    def look(b: pa.RecordBatch) -> pa.Table:
        here, keys = [], []
        mask = np.uint64(8 * len(bitmap.value) - 1)
        for i, text in enumerate(texts(b)):
            words = tokens(text)
            own = [k for w in widths for k in [_shingle_keys(words, w)] if len(k)]
            if own:
                own = np.unique(np.concatenate(own))
                at = own & mask
                own = own[(bitmap.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
                if len(own):
                    here.append(i)
                    keys.append(own.view(np.int64))
        part = pa.Table.from_batches([b]).take(pa.array(here, pa.int64()))
        return part.append_column("keys", pa.array(keys, pa.list_(pa.int64())))

    hits = checkpoint(arrow_map(rows.select("row", "doc_id", "text"), look, "row long, doc_id long, text string, keys array<long>"))
    pairs = hits.select("row", F.explode("keys").alias("key")).join(index, "key").select("row", "item").distinct()
    both = pairs.join(hits.drop("keys"), "row").join(items.select("item", "item_id", F.col("text").alias("item_text")), "item")
    schema = pa.schema([("row", pa.int64()), *_FIELDS])

    def verify(b: pa.RecordBatch) -> pa.Table:
        found = []
        for row, doc_id, item_id, text, own in zip(*(b.column(c).to_pylist() for c in ("row", "doc_id", "item_id")), texts(b), texts(b, "item_text"), strict=True):
            words, item = tokens(text), tokens(own)
            hashed, width = word_hashes(words), min(SHINGLE_WORDS, len(item))
            shared = np.flatnonzero(np.isin(shingle_hashes(hashed, width), shingle_hashes(word_hashes(item), width)))
            starts = _covered([around(p, width, len(item), len(words)) for p in shared.tolist()]) if len(shared) else shared
            if best := best_window(words, hashed, item, shingles(item), print_of(item), starts):
                found.append((row, doc_id, item_id, *best))
        return pa.Table.from_pylist([dict(zip(schema.names, f, strict=True)) for f in found], schema=schema)

    found = arrow_map(both, verify, "row long, " + SCHEMA)
    first = F.row_number().over(W.partitionBy("row", "item_id").orderBy(F.desc("similarity"), "first_word", "n_words"))
    return found.withColumn("rank", first).where("rank = 1").drop("rank")


def op7_benchmark_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    shared = small_benchmark(benchmark)
    if shared is None:
        # The verdict depends on the text alone.
        found = found_by_join(docs.select(F.xxhash64("text").alias("row"), F.lit(None).cast("long").alias("doc_id"), "text").dropDuplicates(["row"]), benchmark)
        return docs.withColumn("_text", F.xxhash64("text")).join(found.select(F.col("row").alias("_text")).distinct(), "_text", "left_anti").select(*docs.columns)

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        return b.filter(pa.array([not shared.value.matches(t) for t in texts(b)], pa.bool_()))

    return arrow_map(docs, batch, docs.schema)
