"""Quality by nearest neighbours among labelled latent-semantic vectors.

A text's terms are its words (hashed to a set number), pairs of neighbouring character classes, and how its words repeat. Their
weighted frequencies in a bounded sample of labelled texts give a latent space (the leading
right singular vectors). The sample's vectors go to every task; each document's cosines with
all of them are computed exactly, block by block, and the nearest vote with their labels,
weighted by similarity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from xxhash import xxh64_intdigest

from palimpsest.llm.common import arrow_map, bucket_of, table, texts
from palimpsest.llm.text_counts import numbered, words_in_repeats

#: Labelled documents that the space is fitted on and that vote, those with the least hashes of doc_id.
MOST_LABELLED = 4096
DIMENSIONS = 32
NEIGHBOURS = 25
#: The power of the cosine that weighs a vote.
SHARPNESS = 16
THRESHOLD = 0.7
#: Documents whose cosines are computed at once.
BLOCK = 512

#: Character classes: white space, line ends, digits, four of letters, ends of sentences, quotes, brackets; each other ASCII mark is its own.
_GROUPS = (b" \t\x0b\x0c\r", b"\n", b"0123456789", b"aeiou", b"bcdfghjklmnpqrstvwxyz", b"AEIOU", b"BCDFGHJKLMNPQRSTVWXYZ", b".,;:", b"'\"`", b"()[]{}", b"-_/\\", b"+=~^@")
_MARKS = b"!?#$%&*|<>"
CLASS = np.full(256, len(_GROUPS) + len(_MARKS), np.uint8)
for _i, _g in enumerate((*_GROUPS, *(bytes([m]) for m in _MARKS))):
    CLASS[list(_g)] = _i
CLASS[:32][CLASS[:32] == len(_GROUPS) + len(_MARKS)] = 0
CLASSES = len(_GROUPS) + len(_MARKS) + 1
#: Beside the pairs: words equal to the one before, words in repeated windows, words that are not new, and short texts.
EXTRA = 4
#: Terms that words are hashed to, and how much they weigh beside the others.
LEXICAL, LEXICAL_WEIGHT = 1024, 0.5
TERMS = LEXICAL + CLASSES * CLASSES + EXTRA
_MARKS_AROUND = b"!?.,;:'\"()[]{}*#$%&|<>-_/\\+=~^@`"
_CACHED, _LONGEST_CACHED = 200_000, 64


class _Buckets(dict):
    """Word -> its term; words are hashed once, but for very long ones, and then kept."""

    def __missing__(self, word: bytes) -> int:
        k = xxh64_intdigest(word.strip(_MARKS_AROUND)) % LEXICAL
        if len(word) <= _LONGEST_CACHED:
            if len(self) >= _CACHED:
                self.clear()
            self[word] = k
        return k


_buckets = _Buckets()


def term_frequencies(text: bytes) -> np.ndarray:
    """The share of each term; a text without words has none."""
    out = np.zeros(TERMS, np.float32)
    tokens = text.split()
    if not tokens:
        return out
    own = CLASS[np.frombuffer(text, np.uint8)].astype(np.int64)
    pairs = np.bincount(own[:-1] * CLASSES + own[1:], minlength=CLASSES * CLASSES)
    out[LEXICAL:-EXTRA] = pairs / max(len(own) - 1, 1)
    out[:LEXICAL] = LEXICAL_WEIGHT**2 / len(tokens) * np.bincount(list(map(_buckets.__getitem__, text.lower().split())), minlength=LEXICAL)
    ids = numbered(tokens)
    n = len(ids)
    out[-EXTRA:] = np.count_nonzero(ids[1:] == ids[:-1]) / n, words_in_repeats(ids) / n, 0.1 * (1 - (ids.max() + 1) / n), 0.1 / n
    return out


@dataclass(frozen=True)
class Model:
    """The latent space and the labelled vectors in it; without labels, only the prior."""

    weights: np.ndarray
    space: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def project(self, frequencies: np.ndarray) -> np.ndarray:
        latent = np.sqrt(frequencies) * self.weights @ self.space
        return latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)

    def score(self, frequencies: np.ndarray) -> np.ndarray:
        """The weighted share of label 1 among the nearest; the prior where no neighbour is similar at all."""
        if not len(self.labels):
            return np.full(len(frequencies), self.prior)
        out, k = [], min(NEIGHBOURS, len(self.labels))
        for i in range(0, len(frequencies), BLOCK):
            cosines = self.project(frequencies[i : i + BLOCK]) @ self.vectors.T
            near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            weight = np.clip(np.take_along_axis(cosines, near, 1), 0, 1).astype(np.float64) ** SHARPNESS
            votes, total = (weight * self.labels[near]).sum(1), weight.sum(1)
            out.append((votes + 1e-3 * self.prior) / (total + 1e-3))
        return np.clip(np.concatenate(out), 0, 1)


def fit(frequencies: np.ndarray, labels: np.ndarray) -> Model:
    """Weights terms by how few of the texts have them, and keeps the leading singular directions."""
    if not len(labels):
        empty = np.zeros((0, DIMENSIONS), np.float32)
        return Model(np.zeros(TERMS, np.float32), np.zeros((TERMS, DIMENSIONS), np.float32), empty, np.zeros(0), 0.5)
    having = (frequencies > 0).sum(0)
    weights = np.log((1 + len(labels)) / (1 + having)).astype(np.float32) + 1
    _, _, right = np.linalg.svd(np.sqrt(frequencies) * weights, full_matrices=False)
    bare = Model(weights, right[:DIMENSIONS].T.astype(np.float32), np.zeros((0, DIMENSIONS)), np.zeros(0), float(labels.mean()))
    return Model(bare.weights, bare.space, bare.project(frequencies).astype(np.float32), labels.astype(np.float64), bare.prior)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, may_learn: Column, most: int) -> DataFrame:
    """(doc_id, text, label) of at most ``most`` labelled documents: those with the least hashes of doc_id."""
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & may_learn).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # At most ``most`` rows of two numbers.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, most: int = MOST_LABELLED) -> Model:
    def batch(b: pa.RecordBatch) -> pa.Table:
        return pa.table({"doc_id": b.column("doc_id").cast(pa.int64()), "label": b.column("label").cast(pa.int32()), "terms": pa.array([term_frequencies(t).tobytes() for t in texts(b)], pa.binary())})

    # Rows that repeat a doc_id become one, that of the least text hash, before they are read, so no more than ``most`` come.
    sample = labelled_sample(docs, labels, "quality", may_learn, most)
    once = sample.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = arrow_map(once, batch, "doc_id long, label int, terms binary").collect()
    rows.sort(key=lambda r: r["doc_id"])
    frequencies = np.frombuffer(b"".join(r["terms"] for r in rows), np.float32).reshape(len(rows), TERMS)
    return fit(frequencies, np.array([r["label"] for r in rows], np.int64))


def may_learn() -> Column:
    return bucket_of(F.col("doc_id"), 4) != 2


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text).

    Edge cases: a null, empty or blank text has no terms and gets the sample's share of
    label 1; of rows with one labelled doc_id, one is learned from; a doc_id labelled twice counts as 1 if any label is; repeated rows are scored
    each; without labels every score is one half; an empty table gives no rows; other
    columns are ignored.
    """
    model = train(docs, labels, may_learn())

    def batch(b: pa.RecordBatch) -> pa.Table:
        found = model.score(np.stack([term_frequencies(t) for t in texts(b)]))
        return pa.table({"doc_id": b.column("doc_id"), "score": found.astype(np.float64)})

    scored = arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), batch, "doc_id long, score double")
    return scored.select("doc_id", (~may_learn()).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op4_latent_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def drop_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are predicted to have label 1."""
    model = train(docs, labels, may_learn())

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        return b.filter(pa.array(model.score(np.stack([term_frequencies(t) for t in texts(b)])) >= THRESHOLD))

    return arrow_map(docs, batch, docs.schema)
