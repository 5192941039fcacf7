"""Language-model scores: the whole text's log-probability under a gated recurrent network.

The output is factored by classes, with a softmax on the state for each factor (``gru``): the class of the next
token by its ending, then its slot in the class. The commonest words of a class have a slot of their own; the rest share some
slots by their beginning, and have there their share of the corpus's counts, one of them set apart for tokens that
training never saw. The same slots are the network's inputs.

Counts come from every training document, and so does the network. Documents are dealt by the hash of their text to
shards of a set number of tokens, whatever the files they come in. In each of a few rounds every shard runs truncated
backpropagation over its share of that round's documents from the same start, and the shards' networks are averaged by their
tokens. Counts of the commonest words go to the tasks; the others, of which there is no bound, meet the documents' rarer
tokens in a join.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import bucket_of, checkpoint, lowered_words, table, texts
from palimpsest.llm.gru import Network, Trainer, log10_likelihoods

#: Words whose counts are sent to every task, and the longest of them; others meet their counts in the join.
COMMON_WORDS, LONGEST_COMMON = 400_000, 64
#: Class 0 is the end; then endings of their own, and hashed classes for the rest.
ENDING_CLASSES, HASHED_CLASSES = 56, 7
CLASSES = 1 + ENDING_CLASSES + HASHED_CLASSES
#: Slots of a class: for words of their own, and for the rest by the first bytes.
OWN_SLOTS, SHARED_SLOTS = 20, 12
SLOTS = OWN_SLOTS + SHARED_SLOTS
TOKENS = CLASSES * SLOTS
ENDING_BYTES, BEGINNING_BYTES = 2, 2
#: Averaging rounds, each over its part of the training documents, and their learning rates.
RATES = (0.03, 0.02, 0.01)
LANES = 256
#: Training tokens of a shard; where that would make more than so many shards, they are longer.
SHARD_TOKENS, MOST_SHARDS = 2_000_000, 10_000
#: A shard learns from, and a task scores, documents in groups of so many tokens at most.
GROUP_TOKENS = 4_000_000
#: Numbers of a network that are added up as one row, and the parts in which the shards' rows are added first.
CHUNK, SALTS = 8192, 16
_FLUSH = 500_000


def is_training() -> Column:
    return bucket_of(F.col("doc_id"), 5) != 1


def corpus_counts(training: DataFrame) -> DataFrame:
    """(word, c) of all training tokens but the ends; each task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.binary()).cast(pa.string()), "c": pa.array(list(counts.values()), pa.int64())})
            counts.clear()
            return out

        for b in batches:
            for t in texts(b):
                counts.update(lowered_words(t))
                if len(counts) > _FLUSH:
                    yield flush()
        if counts:
            yield flush()

    return training.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def common_words(counts: DataFrame, most: int = COMMON_WORDS) -> list[tuple[bytes, int]]:
    """At most ``most`` words and their counts, the commonest first: all above a count that a histogram tells."""
    counts = counts.where(F.octet_length("word") <= LONGEST_COMMON)
    step = F.floor(16 * F.log2("c")).cast("int")
    histogram, above, least = counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect(), 0, 1 << 20
    for r in histogram:
        above += r["count"]
        if above > most:
            break
        least = r["step"]
    found = counts.where(step >= least).select("word", "c").toArrow()
    rows = zip(found.column("word").cast(pa.binary()).to_pylist(), found.column("c").to_pylist(), strict=True)
    return sorted(rows, key=lambda r: (-r[1], r[0]))


@dataclass(frozen=True)
class Places:
    """Where a word is predicted: class x SLOTS + slot, by the word, or by its last bytes and its first."""

    words: dict[bytes, int]
    endings: dict[bytes, int]

    def class_of(self, word: bytes) -> int:
        ending = word[-ENDING_BYTES:]
        return k if (k := self.endings.get(ending)) is not None else 1 + ENDING_CLASSES + sum(ending) % HASHED_CLASSES

    def of(self, word: bytes) -> int:
        if (k := self.words.get(word)) is not None:
            return k
        return self.class_of(word) * SLOTS + OWN_SLOTS + int.from_bytes(word[:BEGINNING_BYTES], "big") % 251 % SHARED_SLOTS


def choose_places(common: list[tuple[bytes, int]]) -> Places:
    """``common``: (word, count), the commonest first."""
    mass: Counter = Counter()
    for w, c in common:
        mass[w[-ENDING_BYTES:]] += c
    endings = sorted(mass, key=lambda e: (-mass[e], e))[:ENDING_CLASSES]
    places = Places({}, {e: 1 + i for i, e in enumerate(endings)})
    taken: Counter = Counter()
    for w, _ in common:
        k = places.class_of(w)
        if taken[k] < OWN_SLOTS:
            places.words[w] = k * SLOTS + taken[k]
            taken[k] += 1
    return places


class Vocabulary(dict):
    """Raw word -> place, plus TOKENS x (1 + rank) for common words; a worker process builds it once."""

    _built: dict[int, Vocabulary] = {}

    def __init__(self, places: Places, common: bytes):
        super().__init__()
        self.places = places
        for i, w in enumerate(common.split(b"\n") if common else []):
            self[w] = TOKENS * (1 + i) + places.of(w)
        self.fixed = len(self)

    def __missing__(self, word: bytes) -> int:
        found = self.places.of(word)
        if len(word) <= LONGEST_COMMON and len(self) < self.fixed + COMMON_WORDS // 2:
            self[word] = found
        return found

    @classmethod
    def of(cls, shared: Broadcast) -> Vocabulary:
        name, places, common, *_ = shared.value
        if name not in cls._built:
            cls._built.clear()
            cls._built[name] = cls(places, common)
        return cls._built[name]


def coded(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """(doc_id, hash, n_tokens, n_known, base, shares, rare, places): what one reading of each text gives.

    base and shares are sums over the common words; ``rare`` are the others, with spaces between, for the join.
    places: two bytes a token, the end's (0) last.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.of(shared)
        _, _, _, log_counts, log_totals, base_total, ends = shared.value
        look = vocabulary.__getitem__
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                rows = []
                for text in texts(part):
                    words = lowered_words(text)
                    codes = np.fromiter((*map(look, words), 0), np.int64, len(words) + 1)
                    rank, place = np.divmod(codes, TOKENS)
                    known = rank > 0
                    known[-1] = True  # the end
                    logs = float(log_counts[rank[known]].sum())
                    unknown = b" ".join([words[k] for k in np.flatnonzero(~known).tolist()]).decode() or None
                    rows.append((len(codes), int(known.sum()) - (ends == 0), logs - len(codes) * base_total, logs - float(log_totals[place].sum()), unknown, place.astype(np.uint16).tobytes()))
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string(), pa.binary())
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("hash"), *columns], ["doc_id", "hash", "n_tokens", "n_known", "base", "shares", "rare", "places"])

    schema = "doc_id long, hash long, n_tokens long, n_known long, base double, shares double, rare string, places binary"
    return docs.select("doc_id", F.xxhash64("text", "doc_id").alias("hash"), "text").mapInArrow(run, schema)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Rows' numbers and places in groups of GROUP_TOKENS at most (or one document)."""
    rows, group, size = [], [], 0
    for b in batches:
        for row, places in zip(b.column("row").to_pylist(), b.column("places").to_pylist(), strict=True):
            if group and size + len(places) // 2 > GROUP_TOKENS:
                yield rows, group
                rows, group, size = [], [], 0
            rows.append(row)
            group.append(np.frombuffer(places, np.uint16))
            size += len(places) // 2
    if group:
        yield rows, group


def averaged_round(training: DataFrame, network: Network, rate: float) -> Network:
    """One round: every shard, a partition of (row, places), learns from its documents; their networks are averaged by tokens."""
    start = training.sparkSession.sparkContext.broadcast((network.classes, network.slots, network.hidden, network.vector))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, slots, hidden, vector = start.value
        trainer = Trainer(Network(classes, slots, hidden).load(vector), rate, LANES)
        for _, group in _documents(batches):
            trainer.learn(group)
        if trainer.tokens:
            own = trainer.network.vector
            chunks = [own[i : i + CHUNK].tobytes() for i in range(0, len(own), CHUNK)]
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(range(len(chunks)), pa.int32()), "tokens": pa.array([float(trainer.tokens)] * len(chunks)), "part": pa.array(chunks, pa.binary())})

    def average(group: pd.DataFrame) -> pd.DataFrame:
        tokens = group["tokens"].sum()
        total = sum(np.frombuffer(x, np.float32) * (n / tokens) for x, n in zip(group["part"], group["tokens"], strict=True))
        return pd.DataFrame({"chunk": group["chunk"].iloc[:1], "tokens": [tokens], "part": [total.astype(np.float32).tobytes()]})

    schema = "chunk int, tokens double, part binary"
    rows = training.select("row", "places").mapInArrow(run, schema).withColumn("salt", F.spark_partition_id() % SALTS)
    # No task has many networks: first they are averaged in SALTS parts, then the parts.
    found = rows.groupBy("chunk", "salt").applyInPandas(average, schema).groupBy("chunk").applyInPandas(average, schema).collect()
    return network.load(np.concatenate([np.frombuffer(r["part"], np.float32) for r in sorted(found, key=lambda r: r["chunk"])])) if found else network


def dealt(rows: DataFrame, tokens: int) -> DataFrame:
    """``rows`` with each shard's documents together, in the order of their hashes."""
    shards = max(1, min(MOST_SHARDS, round(tokens / SHARD_TOKENS)))
    return rows.repartition(shards, "hash").sortWithinPartitions("hash", "row")


def trained(rows: DataFrame, log_shares: np.ndarray) -> Network:
    """The network after all rounds over ``rows`` (row, hash, places), dealt. Which round and shard a document is in follows from its hash."""
    network, rounds = Network(CLASSES, SLOTS, log_shares=log_shares), len(RATES)
    for k, rate in enumerate(RATES):
        network = averaged_round(rows.where(F.pmod(F.shiftright("hash", 32), F.lit(rounds)) == k), network, rate)
    return network


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs`` (doc_id, text).

    base_score takes each token by its share of the training tokens; score is the network's.
    Both are log10 of the whole text's probability, in which all unseen tokens are one.

    Edge cases: a null, empty or blank text is the end alone; repeated rows count and are
    scored each; without training documents nothing is known and the network is as it
    began; an empty table gives no rows; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    training = docs.where(is_training())
    counts = checkpoint(corpus_counts(training))
    ends = training.count()
    common = common_words(counts)
    places = choose_places(common)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"k": pa.array([places.of(w) for w in b.column("word").cast(pa.binary()).to_pylist()], pa.int32()), "c": b.column("c")})

    masses = {r["k"]: (r["c"], r["v"]) for r in counts.mapInArrow(place, "k int, c long").groupBy("k").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()}
    mass, log_totals = shares(masses, ends, set(places.words.values()))
    tokens, distinct = int(mass[:, 0].sum()), int(mass[:, 1].sum())
    base_total = math.log10(tokens + 0.5 * (distinct + 1))
    log_counts = np.log10(np.array([ends, *(c for _, c in common)], np.float64) + 0.5)
    shared = docs.sparkSession.sparkContext.broadcast((uuid4().hex, places, b"\n".join(w for w, _ in common), log_counts, log_totals, base_total, ends))
    partial = checkpoint(dealt(coded(docs, shared).withColumn("row", F.monotonically_increasing_id()), tokens))
    network = trained(partial.where(is_training()).select("row", "hash", "places"), np.log((mass[:, 0] + 0.5) / (mass[:, 0] + 0.5).sum()).reshape(CLASSES, SLOTS))
    final = docs.sparkSession.sparkContext.broadcast(network.vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(CLASSES, SLOTS).load(final.value)
        for rows, group in _documents(batches):
            yield pa.RecordBatch.from_pydict({"row": pa.array(rows, pa.int64()), "path": pa.array(log10_likelihoods(net, group), pa.float64())})

    paths = checkpoint(partial.select("row", "places").mapInArrow(run, "row long, path double"))
    # Words have no space in them. Each counts as often as it comes.
    rare = partial.select("row", F.explode(F.split("rare", " ")).alias("word"))
    found = rare.join(counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    added = found.groupBy("row").agg(F.sum(F.log10(F.col("c") + 0.5)).alias("logs"), F.sum(F.when(F.col("c") > 0, 1).otherwise(0)).alias("seen"))
    logs = F.coalesce("logs", F.lit(0.0))
    return partial.drop("rare", "places").join(paths, "row").join(added, "row", "left").select(
        "doc_id", (~is_training()).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + logs).alias("base_score"), (F.col("shares") + F.col("path") + logs).alias("score"))


def shares(masses: dict[int, tuple[int, int]], ends: int, own: set[int]) -> tuple[np.ndarray, np.ndarray]:
    """(each place's tokens and distinct words, log10 of what a word's count plus a half is divided by to give its share of the place).

    A slot of its own is one word's whole, with the end for class 0; in the others one more word stands for the unseen.
    """
    masses = {**masses, 0: (ends, 1 if ends else 0)}
    mass = np.array([masses.get(k, (0, 0)) for k in range(TOKENS)], np.float64)
    alone = np.zeros(TOKENS)
    alone[list(own | {0})] = 1
    return mass, np.log10(mass[:, 0] + 0.5 * (mass[:, 1] + 1 - alone) + (mass[:, 1] == 0) * alone * 0.5)


def op5_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
