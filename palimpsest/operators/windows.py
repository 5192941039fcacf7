"""Which versions of each key a query sees.

Every function maps cells to cells. The newest version of a key comes from ``max_by``, an
aggregate that combines before the shuffle, so that a key with very many versions costs a
task no more than any other. Predicates on values must come after these functions: the
newest version may be a tombstone that hides older values. Predicates on keys may come before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.model import MIN_TIME, Bound, exclusive, inclusive


def newest(cells: DataFrame, *keys: str) -> DataFrame:
    """The newest cell of every key. A key has one cell at a time at most: dedupe() first where it may have more.

    One ``max_by`` a column, not one of a struct: buffers of plain numbers allow a hash
    aggregate, where a struct would have each task sort its cells.
    """
    keys = keys or ("key",)
    rest = [F.max_by(c, "time").alias(c) for c in cells.columns if c not in (*keys, "time")]
    return cells.groupBy(*keys).agg(F.max("time").alias("time"), *rest).select(*cells.columns)


def between(cells: DataFrame, later: Bound, earlier: Bound = inclusive(MIN_TIME)) -> DataFrame:
    """Every cell in the range."""
    return cells.where(earlier.below(F.col("time")) & later.above(F.col("time")))


def latest(cells: DataFrame, later: Bound, earlier: Bound = inclusive(MIN_TIME)) -> DataFrame:
    """The newest cell of every key in the range, be it a tombstone."""
    return newest(between(cells, later, earlier))


def through(cells: DataFrame, later: Bound, earlier: int) -> DataFrame:
    """Every cell after ``earlier`` in the range, and for each key the newest one up to ``earlier``."""
    return between(cells, later, exclusive(earlier)).unionByName(newest(cells.where(F.col("time") <= earlier)))


def everything(cells: DataFrame, now: int) -> DataFrame:
    return between(cells, inclusive(now))


def live(cells: DataFrame) -> DataFrame:
    """Without tombstones."""
    return cells.where(F.col("value").isNotNull())


def retire(cells: DataFrame, limit: int) -> DataFrame:
    """What retention keeps: cells from ``limit`` on, and for each key the newest one before."""
    return cells.where(F.col("time") >= limit).unionByName(newest(cells.where(F.col("time") < limit)))


def dedupe(cells: DataFrame, rank: str) -> DataFrame:
    """One cell for each key and time: that of the least ``rank`` (the newest tier)."""
    rest = [F.min_by(c, rank).alias(c) for c in cells.columns if c not in ("key", "time", rank)]
    return cells.groupBy("key", "time").agg(F.min(rank).alias(rank), *rest).select(*cells.columns)


def clean(cells: DataFrame, limit: int, rank: str, resident: Column) -> DataFrame:
    """Repeats dropped, history retired, and only the keys that live here: in that order, before slices and windows."""
    return retire(dedupe(cells, rank), limit).where(resident)


def overlaps(kind: str, later: Bound, earlier: Bound, first: Column, last: Column) -> Column:
    """Whether files with times ``first``..``last`` can matter to a window; ``through`` looks below its lower bound."""
    upper = later.above(first)
    return upper if kind == "through" else upper & earlier.below(last)


#: How long history is kept: the instant before which versions may be retired, from "now" as a timestamp.
RETENTION = {
    "unix_epoch": lambda now: F.timestamp_seconds(F.lit(0)),
    "start_of_previous_hour": lambda now: F.date_trunc("hour", now - F.expr("INTERVAL 1 HOUR")),
    "start_of_yesterday": lambda now: F.date_trunc("day", now - F.expr("INTERVAL 1 DAY")),
    "start_of_previous_week": lambda now: F.date_trunc("week", now - F.expr("INTERVAL 7 DAY")),
    "start_of_previous_month": lambda now: F.date_trunc("month", F.add_months(now, -1)),
}


def retention_limit(policy: str, now: Column) -> Column:
    """Microseconds since the epoch."""
    return F.unix_micros(RETENTION[policy](now).cast("timestamp"))
