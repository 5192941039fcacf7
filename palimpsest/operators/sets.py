"""Merges, set operations, prefixes of an order, and collecting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def novel(cells: DataFrame, known: DataFrame) -> DataFrame:
    """The received cells whose key and time are not there yet."""
    return cells.join(known.select("key", "time"), ["key", "time"], "left_anti")


def received(cells: DataFrame, known: DataFrame) -> DataFrame:
    """What is there after cells are received: repeats are not added."""
    return known.unionByName(novel(cells, known))


def union_of_sets(rows: DataFrame, by: str, items: str) -> DataFrame:
    """(by, items): all items of all rows' sets, in order, each once."""
    return rows.select(by, F.explode(items).alias("item")).distinct().groupBy(by).agg(F.array_sort(F.collect_list("item")).alias(items))


def take_while(rows: DataFrame, by: str, order: list[Column], holds: Column) -> DataFrame:
    """Of each group in order, the rows before the first for which the condition fails, and that row, marked ``stopped``."""
    failed = F.sum(F.when(holds, 0).otherwise(1)).over(W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    marked = rows.withColumns({"_failed": failed, "stopped": ~holds})
    return marked.where((F.col("_failed") == 0) | (F.col("_failed") == 1) & F.col("stopped")).drop("_failed")


def to_map(rows: DataFrame, by: str, name: Column, value: Column, position: Column) -> DataFrame:
    """(by, entries): a map of each group; of entries with the same name the last one, by position, stays."""
    last = rows.select(by, name.alias("_name"), value.alias("_value"), position.alias("_at")).groupBy(by, "_name").agg(F.max_by("_value", "_at").alias("_value"))
    return last.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_name", "_value")))).alias("entries"))
