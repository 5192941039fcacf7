"""Quality rules whose cutoffs come from the corpus.

Each document has a few integer measures. For every language and source, each measure's
distribution is kept as a sketch: counts by bucket, seven significant bits wide, so that any
two sketches merge by adding counts and a quantile is off by less than one part in 64. The
cutoffs are fences around a sketch's median; the fewer documents a source has, the nearer its quantiles are taken to
those of its language's merged sketch. A join of documents with the fences then gives the verdict.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.common import arrow_map, checkpoint, table, texts
from palimpsest.llm.text_counts import WHITE, count_of, numbered, repeated_lines, words_in_repeats

SYMBOLS = b"#*$%&|<>"
LEAST_WORDS = 10
MOST_REPEATS = 20
#: Measure: (its count, how much of it is 1 for a word, the narrowest upper fence, the narrowest lower fence or None).
MEASURES = {
    "symbols": ("n_symbols", 1000, 100, None),
    "word_length": ("word_chars", 100, 400, 250),
    "dup_lines": ("n_dup_lines", 1000, 50, None),
    "repeats": ("n_repeat_words", 1000, 190, None),
    "stutter": ("n_stutter", 1000, 150, None),
}
#: A fence is this many times the distance from the median to the tenth on its far side.
SPREAD = 6
#: A source of so many documents stands half way between its language's quantiles and its own.
HALF_WAY = 50
#: As many (language, source, measure) fences are broadcast at most.
BROADCAST_FENCES = 200_000
BUCKET_BITS = 7


def measures(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stutter)."""
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stutter"]

    def one(text: bytes) -> tuple[int, ...]:
        tokens = text.split()
        if not tokens:
            return 0, 0, 0, 0, 0, 0
        ids = numbered(tokens)
        characters = len(text.decode()) - count_of(text, WHITE)
        return len(tokens), characters, count_of(text, SYMBOLS), repeated_lines(text), words_in_repeats(ids), int(np.count_nonzero(ids[1:] == ids[:-1]))

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([one(t) for t in texts(b)], np.int64)
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *(pa.array(found[:, i]) for i in range(len(counts)))], ["doc_id", "lang", "source", *counts])

    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    return arrow_map(docs.select(F.col("doc_id").cast("long"), *named, "text"), batch, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in counts))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATS * F.col("n_words"))


def value(name: str) -> Column:
    """The measure; of a text without words, which the base rules reject anyway, as if it had one."""
    count, unit, _, _ = MEASURES[name]
    return F.expr(f"{unit} * {count} div greatest(n_words, 1)")


def bucket(v: Column) -> Column:
    """The least number with the same seven leading bits, and zeros after them."""
    shift = F.greatest(F.length(F.bin(v)) - BUCKET_BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n) of the documents that pass the base rules."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), bucket(value(m)).alias("bucket")) for m in MEASURES)))
    return measured.where(~base_failed()).select("lang", "source", each.alias("m")).groupBy("lang", "source", "m.measure", "m.bucket").agg(F.count("*").alias("n"))


def merged(parts: DataFrame, *by: str) -> DataFrame:
    """Sketches merge by adding the counts of equal buckets."""
    return parts.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, *by: str) -> DataFrame:
    """(by, measure, total, q10, q50, q90): the least bucket up to which so many tenths of the documents lie."""
    keys = W.partitionBy(*by, "measure")
    ranked = sketch.withColumn("total", F.sum("n").over(keys)).withColumn("upto", F.sum("n").over(keys.orderBy("bucket")))
    tenth = [F.min(F.when(10 * F.col("upto") >= k * F.col("total"), F.col("bucket"))).alias(f"q{k}0") for k in (1, 5, 9)]
    return ranked.groupBy(*by, "measure").agg(F.max("total").alias("total"), *tenth)


def fences(parts: DataFrame) -> DataFrame:
    """A row for each language and source, with ``<measure>_low`` and ``<measure>_high``."""
    own = quantiles(parts, "lang", "source")
    wide = quantiles(merged(parts, "lang"), "lang").select("lang", "measure", *(F.col(q).alias(f"lang_{q}") for q in ("q10", "q50", "q90")))
    both = own.join(wide, ["lang", "measure"])
    q = {k: F.expr(f"(total * {k} + {HALF_WAY} * lang_{k}) div (total + {HALF_WAY})") for k in ("q10", "q50", "q90")}
    out = []
    for m, (_, _, above, below) in MEASURES.items():
        mine = F.col("measure") == m
        out.append(F.max(F.when(mine, q["q50"] + F.greatest(F.lit(above), SPREAD * (q["q50"] - q["q10"])))).alias(f"{m}_high"))
        if below is not None:
            out.append(F.max(F.when(mine, q["q50"] - F.greatest(F.lit(below), SPREAD * (q["q90"] - q["q50"])))).alias(f"{m}_low"))
    return both.groupBy("lang", "source").agg(*out)


def judge(docs: DataFrame) -> DataFrame:
    """Measures and verdict of every row of ``docs`` (doc_id, text, lang, source).

    Edge cases: a null, empty or blank text has no words and fails; a null lang or source
    is the empty one; repeated rows count as often as they come; a measure equal to its
    fence passes; an empty table gives no rows; other columns are ignored.
    """
    measured = checkpoint(measures(docs))
    limits = checkpoint(fences(sketches(measured)))
    if limits.count() * len(MEASURES) <= BROADCAST_FENCES:
        limits = F.broadcast(limits)
    inside = F.lit(True)
    for m, (_, _, _, below) in MEASURES.items():
        inside &= value(m) <= F.col(f"{m}_high")
        if below is not None:
            inside &= value(m) >= F.col(f"{m}_low")
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    judged = measured.join(limits, ["lang", "source"], "left").withColumn("base_failed", base_failed())
    return judged.select("doc_id", *counts, "base_failed", F.coalesce(~F.col("base_failed") & inside, F.lit(False)).alias("kept"))


def op3_adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """The same in DuckDB's SQL."""
    values = {m: f"({unit} * {count} // n_words)" for m, (count, unit, _, _) in MEASURES.items()}
    rows = " union all ".join(f"select lang, source, '{m}' as measure, {v} as v from passed" for m, v in values.items())
    high = ", ".join(f"max(case when measure = '{m}' then q50 + greatest({g}, {SPREAD} * (q50 - q10)) end) as {m}_high" for m, (_, _, g, _) in MEASURES.items())
    low = ", ".join(f"max(case when measure = '{m}' then q50 - greatest({g}, {SPREAD} * (q90 - q50)) end) as {m}_low" for m, (_, _, _, g) in MEASURES.items() if g is not None)
    inside = " and ".join([f"{v} <= {m}_high" for m, v in values.items()] + [f"{values[m]} >= {m}_low" for m, x in MEASURES.items() if x[3] is not None])
    tenths = ", ".join(f"min(case when 10 * upto >= {k} * total then bucket end) as q{k}0" for k in (1, 5, 9))
    shrunk = ", ".join(f"((total * own.q{k}0 + {HALF_WAY} * wide.q{k}0) // (total + {HALF_WAY}))::bigint as q{k}0" for k in (1, 5, 9))
    return rf"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
w as (select rid, unnest(ws) as w, generate_subscripts(ws, 1) as i from (select rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from d)),
g as (select rid, i, w, lag(w) over p as prev, w || ' ' || lead(w, 1) over p || ' ' || lead(w, 2) over p || ' ' || lead(w, 3) over p || ' ' || lead(w, 4) over p as g from w window p as (partition by rid order by i)),
t as (select *, case when g is not null and count(*) over (partition by rid, g) > 1 then 1 else 0 end as twice from g),
c as (select *, max(twice) over (partition by rid order by i rows between 4 preceding and current row) as covered from t),
n as (select rid, count(*) as n_words, sum(length(w)) as word_chars, sum(covered) as n_repeat_words, sum(case when w = prev then 1 else 0 end) as n_stutter from c group by rid),
l as (select rid, count(*) - count(distinct line) as n_dup_lines from (select rid, unnest(string_split(text, chr(10))) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]') group by rid),
m as (select doc_id, lang, source, coalesce(n_words, 0)::bigint as n_words, coalesce(word_chars, 0)::bigint as word_chars,
    case when n_words is null then 0 else length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) end::bigint as n_symbols,
    coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(n_stutter, 0)::bigint as n_stutter
    from d left join n using (rid) left join l using (rid)),
b as (select *, n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATS} * n_words as base_failed from m),
passed as (select * from b where not base_failed),
v as ({rows}),
s as (select lang, source, measure, (v >> shift) << shift as bucket, count(*)::bigint as n from (select *, greatest(length(bin(v)) - {BUCKET_BITS}, 0) as shift from v) group by all),
own as (select lang, source, measure, max(total) as total, {tenths} from (
    select *, sum(n) over (partition by lang, source, measure) as total, sum(n) over (partition by lang, source, measure order by bucket) as upto from s) group by all),
wide as (select lang, measure, {tenths} from (
    select *, sum(n) over (partition by lang, measure) as total, sum(n) over (partition by lang, measure order by bucket) as upto
    from (select lang, measure, bucket, sum(n) as n from s group by all)) group by all),
q as (select own.lang, own.source, own.measure, {shrunk} from own join wide using (lang, measure)),
f as (select lang, source, {high}, {low} from q group by lang, source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(not base_failed and {inside}, false) as kept
from b left join f using (lang, source)"""
