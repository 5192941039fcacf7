"""Point reads as of an instant, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Microseconds of a bucket of times, within which one task puts reads and versions of a key in order.
BUCKET = 86_400_000_000


def newest_upto(ops: DataFrame, versions: DataFrame, by: tuple[str, ...], time: str = "time", width: int = BUCKET) -> DataFrame:
    """``ops`` (with rt) and ``found``, a struct of the newest of ``versions`` up to rt with equal ``by``; null if there is none.

    No read meets all versions of its key: reads and versions are put in one order within
    each key and bucket of times, and what the buckets before ended with is carried into the
    next ones, a row a bucket. So a key may have any share of the reads and versions.
    """
    asked = ops.select(*by).distinct()
    rest = [c for c in versions.columns if c not in by]
    v = versions.join(asked, [*by], "left_semi").select(*by, F.col(time).alias("_at"), F.struct(*rest).alias("_version"), F.lit(None).cast(ops.select(F.struct("*")).schema[0].dataType).alias("_op"))
    o = ops.select(*by, F.col("rt").alias("_at"), F.lit(None).cast(v.schema["_version"].dataType).alias("_version"), F.struct("*").alias("_op"))
    rows = v.unionByName(o).withColumn("_bucket", F.floor(F.col("_at") / width).cast("long"))
    # Of equal times, versions come first.
    so_far = W.partitionBy(*by, "_bucket").orderBy("_at", F.col("_op").isNotNull()).rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = rows.withColumn("_own", F.last("_version", ignorenulls=True).over(so_far)).where(F.col("_op").isNotNull())
    ends = rows.groupBy(*by, "_bucket").agg(F.max_by("_version", F.when(F.col("_version").isNotNull(), F.col("_at"))).alias("_end"))
    earlier = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(earlier)).select(*by, "_bucket", "_carried")
    return inside.join(carried, [*by, "_bucket"]).select("_op.*", F.coalesce("_own", "_carried").alias("found"))


def read_asof(ops: DataFrame, cells: DataFrame, by: tuple[str, ...] = ("key",)) -> DataFrame:
    """For each of ``ops`` (op_index, keys ``by``, rt): value_time and value of the newest cell up to rt; (0, null) if there is none."""
    found = newest_upto(ops.select("op_index", *by, "rt"), cells.select(*by, "time", "value"), by)
    return found.select("op_index", *by, "rt", F.coalesce("found.time", F.lit(0)).alias("value_time"), F.col("found.value").alias("value"))


def newest_time(reads: DataFrame) -> DataFrame:
    """The condition time of a transaction that did these reads."""
    return reads.agg(F.coalesce(F.max("value_time"), F.lit(0)).alias("vt"))


def read_status(value: Column, value_time: Column, condition: Column) -> Column:
    """404 for no value; 200 if it changed after the condition time; else 304."""
    return F.when(value.isNull(), 404).when(condition < value_time, 200).otherwise(304)


def quorum(replies: DataFrame, by: tuple[str, ...] = ("key",)) -> DataFrame:
    """Of the replicas' replies to each read, the one with the greatest time."""
    return replies.groupBy(*by).agg(F.max("value_time").alias("value_time"), F.max_by("value", "value_time").alias("value"))


def cache_put(entries: DataFrame) -> DataFrame:
    """Entries of a client's cache: one for each version, known to hold up to the greatest cached_time."""
    return entries.groupBy("key", "value_time").agg(F.max("cached_time").alias("cached_time"), F.max_by("value", "cached_time").alias("value"))


def cache_get(ops: DataFrame, cache: DataFrame) -> DataFrame:
    """For each read, the cached entry of the greatest value_time up to its rt, with the cached_time it is good for."""
    return newest_upto(ops, cache, ("key",), "value_time").where(F.col("found").isNotNull()).select("op_index", "found.value_time", "found.cached_time", "found.value")


def evict(cache: DataFrame, most: int) -> DataFrame:
    """The ``most`` entries last known good."""
    return cache.orderBy(F.desc("cached_time"), "key", F.desc("value_time")).limit(most)
