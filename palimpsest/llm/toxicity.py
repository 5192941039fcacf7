"""Toxicity: gradient-boosted trees over dense features of a text, calibrated by isotonic regression.

The lexicon has two parts: a short fixed list, and words and word beginnings that labelled toxic
texts have far more often than others. Densities, nearness to the second person, capitals,
punctuation and obfuscated words make a dozen numbers for each text. All learn from a bounded
sample of the labelled rows. No text lends its words to the lexicon that its own numbers come
from while the trees learn, and calibration learns from texts that the trees have not seen.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import arrow_map, bucket_of, checkpoint, table, texts

THRESHOLD = 0.5
#: Labelled documents that are learned from, at most: with label 1, and with label 0.
MOST_TOXIC = 4000
MOST_OTHER = 8000
#: Of ten parts of the sample, the trees learn from the first, calibration from the last.
PARTS = {"trees": (0, 7), "calibration": (8, 9)}
TREES = 20
DEPTH = 3
#: A learned entry is in so many toxic texts at least, and in this share of them; and is so many times likelier there.
LEAST_TEXTS = 3
LEAST_SHARE = 0.004
LEAST_ODDS = 12.0
MOST_ENTRIES = 3000
BEGINNINGS = (3, 4, 5, 6)
#: Words between a lexicon word and a second person that is near it, at most.
NEAR = 3
CACHED_WORDS = 400_000

#: Insults, and the second person in the corpus's languages.
INSULTS = frozenset("idiot idiots idiotic moron morons stupid dumb loser losers scum trash garbage worthless pathetic disgusting clown clowns fool fools jerk freak filth filthy vermin ugly imbecile".split())
SECOND_PERSON = frozenset("you your yours yourself u ur du dein deine dich dir ihr euch tu te toi ton vous votre tú ti usted ustedes vosotros".split())
#: Characters that stand for letters in disguised words.
DISGUISES = str.maketrans("013457@$!|", "oieastasil")

FEATURES = ("insults", "learned", "kinds", "hits", "strength", "near_you", "you", "capitals", "exclamations", "punctuation", "obfuscated", "disguised_insults", "log_words")
_MARKS = b"!?.,;:'\"()[]{}*#$%&|<>-_/\\+=~^@"
_EDGES = bytes(_MARKS)
_CAPITALS = bytes(range(65, 91))
_LETTERS = _CAPITALS.lower() + _CAPITALS

_PLAIN, _INSULT, _YOU, _OBFUSCATED, _DISGUISED = 0, 1, 2, 4, 8


class Lexicon(dict):
    """Lower-case raw word -> None, or (flags, log-odds, entry); words are looked at once and then kept."""

    def __init__(self, learned: dict[str, float]):
        super().__init__()
        self.learned = learned

    def __reduce__(self):
        return Lexicon, (self.learned,)

    def __missing__(self, raw: bytes):
        if len(self) > CACHED_WORDS:
            self.clear()
        found = self[raw] = self.look(raw)
        return found

    def look(self, raw: bytes) -> tuple[int, float, str] | None:
        word = raw.strip(_EDGES).decode().lower()
        flags = _INSULT * (word in INSULTS) | _YOU * (word in SECOND_PERSON)
        if not word.isalpha() and len(word) > 2:
            bare = "".join(c for c in word.translate(DISGUISES) if c.isalpha())
            letters = sum(c.isalpha() for c in word)
            if 2 <= letters < len(word) and word[0].isalpha() and not word.isalnum() or bare in INSULTS:
                flags |= _OBFUSCATED
            flags |= _DISGUISED * (bare in INSULTS or bare in self.learned)
        entries = [(self.learned[e], e) for e in entries_of(word) if e in self.learned]
        odds, entry = max(entries, default=(0.0, ""))
        return (flags, odds, entry) if flags or odds else None


def entries_of(word: str) -> list[str]:
    """The whole word, and its beginnings marked by a hyphen."""
    return [word, *(word[:k] + "-" for k in BEGINNINGS if len(word) >= k)]


def features(text: bytes, lexicon: Lexicon) -> tuple[float, ...]:
    """FEATURES of a text; all zero without words."""
    tokens = text.lower().split()
    if not tokens:
        return (0.0,) * len(FEATURES)
    found = [(i, *x) for i, x in enumerate(map(lexicon.__getitem__, tokens)) if x is not None]
    n, size = len(tokens), len(text)
    hits = [(i, odds, entry, flags) for i, flags, odds, entry in found if flags & (_INSULT | _DISGUISED) or odds]
    you = [i for i, flags, _, _ in found if flags & _YOU]
    near = sum(any(abs(i - j) <= NEAR for j in you) for i, *_ in hits) if len(hits) * len(you) < 100_000 else _near(hits, you)
    capitals = size - len(text.translate(None, _CAPITALS))
    letters = size - len(text.translate(None, _LETTERS))
    marks = size - len(text.translate(None, _MARKS))
    return (
        100 * sum(flags & _INSULT > 0 for _, _, _, flags in hits) / n, 100 * sum(odds > 0 for _, odds, _, _ in hits) / n, float(len({e for _, odds, e, _ in hits if odds})),
        math.log1p(len(hits)), max((odds for _, odds, _, _ in hits), default=0.0), near / max(len(hits), 1), 100 * len(you) / n, capitals / max(letters, 1),
        100 * (text.count(b"!") + text.count(b"?")) / size, 100 * marks / size, 100 * sum(flags & _OBFUSCATED > 0 for _, flags, _, _ in found) / n,
        float(sum(flags & _DISGUISED > 0 for _, flags, _, _ in found)), math.log1p(n),
    )


def _near(hits: list, you: list[int]) -> int:
    places, at = np.array([h[0] for h in hits]), np.array(you)
    k = np.searchsorted(at, places)
    return int(np.minimum(np.abs(places - at[np.minimum(k, len(at) - 1)]), np.abs(places - at[np.maximum(k - 1, 0)])).__le__(NEAR).sum())


def with_features(rows: DataFrame, learned: dict[str, float], keep: str) -> DataFrame:
    """``keep`` (a schema of columns of ``rows``) and FEATURES."""
    lexicon, names = Lexicon(learned), [c.split()[0] for c in keep.split(", ")]

    def batch(b: pa.RecordBatch) -> pa.Table:
        found = np.array([features(t, lexicon) for t in texts(b)], np.float64)
        return pa.table([*(b.column(c) for c in names), *(pa.array(found[:, k]) for k in range(len(FEATURES)))], names=[*names, *FEATURES])

    return arrow_map(rows.select(*names, "text"), batch, keep + "".join(f", {f} double" for f in FEATURES))


def sample(docs: DataFrame, labels: DataFrame, may_learn: Column) -> DataFrame:
    """(part, label, weight, text): labelled texts, once each, at most MOST_TOXIC and MOST_OTHER of them, by hashes of doc_id."""
    known = checkpoint(labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & may_learn).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label")))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    picked = [
        known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).withColumn("weight", F.lit(max(sizes.get(k, 0) / most, 1.0)))
        for k, most in ((1, MOST_TOXIC), (0, MOST_OTHER))
    ]
    chosen = picked[0].unionByName(picked[1])
    # At most MOST_TOXIC + MOST_OTHER rows of three numbers.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("h", F.xxhash64("text"))
    return checkpoint(rows.dropDuplicates(["h"]).select(F.pmod("h", F.lit(10)).cast("int").alias("part"), "label", "weight", "text"))


def of_part(rows: DataFrame, part: str) -> DataFrame:
    return rows.where(F.col("part").between(*PARTS[part]))


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Entry -> log-odds: the entries of toxic texts that others hardly have, the most telling MOST_ENTRIES."""
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not other:
        return {}

    def batch(b: pa.RecordBatch) -> pa.Table:
        counts = (Counter(), Counter())
        for t, k in zip(texts(b), b.column("label").to_pylist(), strict=True):
            counts[k].update({e for raw in set(t.lower().split()) for e in entries_of(raw.strip(_EDGES).decode().lower()) if e})
        every = sorted(counts[0].keys() | counts[1].keys())
        return pa.table({"entry": every, "toxic": [counts[1][e] for e in every], "other": [counts[0][e] for e in every]})

    share = (F.col("toxic") + 0.5) / (toxic + 1) / ((F.col("other") + 0.5) / (other + 1))
    found = arrow_map(rows.select("label", "text"), batch, "entry string, toxic long, other long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    found = found.where((F.col("toxic") >= max(LEAST_TEXTS, LEAST_SHARE * toxic)) & (share >= LEAST_ODDS)).withColumn("odds", F.log(share))
    return {r["entry"]: r["odds"] for r in found.orderBy(F.desc("odds"), "entry").limit(MOST_ENTRIES).collect()}


def may_learn() -> Column:
    return bucket_of(F.col("doc_id"), 5) != 0


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text).

    Edge cases: a null, empty or blank text has only zeros for features and is scored by
    them; a doc_id labelled twice counts as 1 if any label is; repeated rows are scored
    each; where the sample lacks one of the labels, every score is the share of label 1; an
    empty table gives no rows; other columns are ignored.
    """
    rows = sample(docs, labels, may_learn())
    learned = learn_lexicon(rows)
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    halves = [rows.where(F.col("part") % 2 == k).coalesce(4) for k in (0, 1)]
    crossed = [with_features(halves[k], learn_lexicon(halves[1 - k]), "part int, label int, weight double") for k in (0, 1)]
    dense = checkpoint(crossed[0].unionByName(crossed[1]))
    shares = {(r["part"], r["label"]): r["n"] for r in dense.groupBy("part", "label").agg(F.sum("weight").alias("n")).collect()}
    every = with_features(docs.select(F.col("doc_id").cast("long"), "text"), learned, "doc_id long")
    both = [{k for (p, k) in shares if PARTS[x][0] <= p <= PARTS[x][1]} == {0, 1} for x in ("trees", "calibration")]
    if all(both):
        trees = GBTClassifier(labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=1).fit(assembler.transform(of_part(dense, "trees")))
        raw = vector_to_array("probability")[1]
        held = trees.transform(assembler.transform(of_part(dense, "calibration"))).select(raw.alias("raw"), F.col("label").cast("double").alias("label"), "weight")
        isotonic = IsotonicRegression(featuresCol="raw", labelCol="label", weightCol="weight", predictionCol="calibrated").fit(held)
        ranked = trees.transform(assembler.transform(every)).select("doc_id", raw.alias("raw"))
        scored = isotonic.transform(ranked).select("doc_id", F.col("calibrated").alias("score"))
    else:
        total = sum(shares.values())
        scored = every.select("doc_id", F.lit(sum(n for (_, k), n in shares.items() if k == 1) / total if total else 0.0).alias("score"))
    return scored.select("doc_id", (~may_learn()).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op6_boosted_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
