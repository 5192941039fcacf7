"""Figures about tables, tiers and hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A tier's distinct keys are taken to grow by this much until it is merged.
KEY_ALLOWANCE = 1.1
#: A host that has fewer of a tier's buckets than this share should give the tier up.
EXODUS = 0.2


def digest(cells: DataFrame, by: list[str], size: Column) -> DataFrame:
    """Distinct keys, entries, first and last time, and bytes."""
    return cells.groupBy(*by).agg(
        F.countDistinct("key").alias("keys"), F.count("*").alias("entries"), F.min("time").alias("earliest"), F.max("time").alias("latest"), F.sum(size).cast("long").alias("bytes"))


def approximate_keys(cells: DataFrame, by: list[str], error: float = 0.02) -> DataFrame:
    return cells.groupBy(*by).agg(F.approx_count_distinct("key", error).alias("keys"))


def stability(buckets: Column, mask: Column, resident: list[int], count: int) -> Column:
    """Share of a tier's buckets (numbers modulo mask + 1) that a host with ``resident`` buckets of ``count`` has."""
    own = F.array(*(F.lit(b) for b in resident)) if resident else F.array().cast("array<int>")
    wide = F.flatten(F.transform(buckets, lambda b: F.filter(F.sequence(F.lit(0), F.lit(count - 1)), lambda x: x.bitwiseAND(mask) == b)))
    return F.when(F.size(wide) == 0, 0.0).otherwise(F.size(F.array_intersect(wide, own)) / F.size(wide))


def estimated_keys(keys: Column, share: Column) -> Column:
    return (keys * share * KEY_ALLOWANCE).cast("long")


def chosen_tiers(tiers: DataFrame, also: Column | None = None) -> DataFrame:
    """The tiers to compact: from the newest down to the oldest that is smaller than all newer ones together, or that ``also`` asks for.

    ``tiers`` has a row for each tier of a table (gen, bytes), so its size does not follow the data's.
    """
    newer = F.coalesce(F.sum("bytes").over(W.orderBy(F.desc("gen")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    picked = F.col("bytes") < newer if also is None else (F.col("bytes") < newer) | also
    oldest = tiers.withColumn("_pick", picked).where("_pick").agg(F.min("gen"))
    return tiers.where(F.col("gen") >= oldest.scalar())


def audit(snapshot: DataFrame) -> DataFrame:
    """Rows and the sum of values in a snapshot."""
    return snapshot.agg(F.count("*").alias("rows"), F.sum("value").alias("total"))


def changes(cells: DataFrame) -> DataFrame:
    """(key, time, change): what each version added to its key's value, a tombstone being nothing."""
    value = F.coalesce("value", F.lit(0))
    before = F.coalesce(F.lag(value).over(W.partitionBy("key").orderBy("time")), F.lit(0))
    return cells.select("key", "time", (value - before).alias("change"))


def history(cells: DataFrame, bucket: Column) -> DataFrame:
    """(bucket, changed, total): the sum of all current values after each bucket of commit times.

    Changes are first added up by bucket; the running sum is over one row for each bucket.
    """
    by = changes(cells).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("changed"), F.sum("change").alias("delta"))
    return by.select("bucket", "changed", F.sum("delta").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)).alias("total"))


def hosts_of(cohorts: DataFrame) -> DataFrame:
    """(host, weight) of an atlas (bucket, hosts): in how many cohorts each host is."""
    return cohorts.select(F.explode("hosts").alias("host")).groupBy("host").agg(F.count("*").alias("weight"))


def has_quorum(cohorts: DataFrame, replies: DataFrame) -> DataFrame:
    """(bucket, replied, needed, reached) of an atlas: whether more than half of a cohort's hosts replied."""
    members = cohorts.select("bucket", F.explode("hosts").alias("host"))
    got = members.join(replies.select("host").distinct().withColumn("_in", F.lit(1)), "host", "left").groupBy("bucket").agg(F.count("_in").alias("replied"), F.count("*").alias("n"))
    needed = F.floor(F.col("n") / 2) + 1
    return got.select("bucket", "replied", needed.alias("needed"), (F.col("replied") >= needed).alias("reached"))


def may_contain(probes: DataFrame, keys: DataFrame, error: float = 0.01) -> DataFrame:
    """Probes whose key may be among ``keys``: a semi-join, which Spark may run through a Bloom filter of its own.

    The answer is exact, where a sketch alone would let a share ``error`` of others pass.
    """
    return probes.join(keys.select("key").distinct(), "key", "left_semi")
