"""Scans: ranges, slices, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.model import MAX_TIME, MIN_TIME, Bound, exclusive, in_key_order, inclusive
from palimpsest.operators import windows


def from_start(cells: DataFrame, key: object, time: int = MAX_TIME) -> DataFrame:
    """From a coordinate on, inclusive: of that key, versions newer than ``time`` are skipped."""
    return cells.where((F.col("key") > key) | (F.col("key") == key) & (F.col("time") <= time))


def to_end(cells: DataFrame, end: object) -> DataFrame:
    """Keys before ``end``, exclusive."""
    return cells.where(F.col("key") < end)


def power_of_two(n: int) -> bool:
    return n > 0 and n & (n - 1) == 0


def in_slice(number: Column, index: int, count: int) -> Column:
    """Whether a number falls in slice ``index`` of ``count``, a power of two."""
    if not power_of_two(count) or not 0 <= index < count:
        raise ValueError(f"slice {index} of {count}")
    return number.bitwiseAND(count - 1) == index


def merge(parts: list[DataFrame], rank: str = "source_rank") -> DataFrame:
    """All rows of all parts, each with its part's number; equal rows are all kept."""
    tagged = [p.withColumn(rank, F.lit(i)) for i, p in enumerate(parts)]
    out = tagged[0]
    for p in tagged[1:]:
        out = out.unionByName(p)
    return out


def page(cells: DataFrame, rows: int) -> DataFrame:
    """The first ``rows`` cells in order, and the next one, marked as where the next page begins.

    A top-k: each task keeps rows + 1 cells at most, and so many are numbered.
    """
    first = in_key_order(cells).limit(rows + 1)
    place = F.row_number().over(W.orderBy(F.col("key").asc(), F.col("time").desc()))
    return first.select(*cells.columns, (place > rows).alias("is_next"))


def http_scan(
    cells: DataFrame, now: int, pick: str = "latest", since: int = MIN_TIME, until: int | None = None, key: object = None,
    time: int = MAX_TIME, end: object = None, index: int | None = None, count: int | None = None, slice_of: Column | None = None,
) -> DataFrame:
    """A scan by its request parameters: ``since`` is exclusive, ``until`` (default now) inclusive.

    In order: key range, slice, window, and for ``latest`` only, tombstones go. All of these
    but the last commute with the window, as they look at keys and upper time bounds alone.
    The start key prunes the scan; its time is looked at once the window has chosen.
    """
    until = now if until is None else until
    if since > until or (index is None) != (count is None) or pick.lower() not in ("latest", "between", "through"):
        raise ValueError("bad request")
    if key is not None:
        cells = cells.where(F.col("key") >= key)
    if end is not None:
        cells = to_end(cells, end)
    if index is not None:
        cells = cells.where(in_slice(F.col("key") if slice_of is None else slice_of, index, count))
    window = pick.lower()
    later, earlier = inclusive(until), Bound(None) if since == MIN_TIME else exclusive(since)
    if window == "latest":
        found = windows.live(windows.latest(cells, later, earlier))
    elif window == "between":
        found = windows.between(cells, later, earlier)
    else:
        found = windows.through(cells, later, since)
    return found if key is None else from_start(found, key, time)
