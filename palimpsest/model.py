"""The data model: cells, bounds and windows.

A table is a log of cells ``(key, time, value)``. ``time`` is the commit time in microseconds since
the epoch, a signed long below 2**63; a null ``value`` is a tombstone. Cells are ordered by key
ascending, then time descending.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_TIME = 0
MAX_TIME = 2**63 - 1
#: A clock may be ahead of the server's by so many microseconds.
MAX_SKEW = 5 * 60 * 1_000_000
CELL = "key {key}, time long, value {value}"


@dataclass(frozen=True)
class Bound:
    """One end of a range: a value, inclusive or exclusive, or no limit at all (None)."""

    value: object = None
    inclusive: bool = True

    def below(self, column: Column) -> Column:
        """The bound lies below the column."""
        if self.value is None:
            return F.lit(True)
        return column >= self.value if self.inclusive else column > self.value

    def above(self, column: Column) -> Column:
        """The bound lies above the column."""
        if self.value is None:
            return F.lit(True)
        return column <= self.value if self.inclusive else column < self.value


def exclusive(value: object) -> Bound:
    return Bound(value, False)


def inclusive(value: object) -> Bound:
    return Bound(value, True)


def in_key_order(cells: DataFrame) -> DataFrame:
    """Key ascending, time descending: a range-partitioned total order."""
    return cells.orderBy(F.col("key").asc(), F.col("time").desc())


def micros(column: str) -> Column:
    """Microseconds since the epoch of a timestamp without a time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {column})")
