"""A table on disk: Parquet files of cells, partitioned by commit day, appended batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86_400_000_000


def append(cells: DataFrame, path: str, by_key: int | None = None) -> None:
    """Appends cells; within a day's files they are sorted by key, then by time, the newest first, so that row groups prune."""
    rows = cells.withColumn("day", F.floor(F.col("time") / DAY).cast("long"))
    rows = rows.repartition(by_key, "day", "key") if by_key else rows.repartition("day", "key")
    rows.sortWithinPartitions("day", "key", F.desc("time")).write.mode("append").partitionBy("day").parquet(path)


def read(spark: SparkSession, path: str, since: int | None = None, until: int | None = None) -> DataFrame:
    """Cells with times in (since, until]; whole days outside of it are not listed."""
    rows = spark.read.parquet(path)
    if since is not None:
        rows = rows.where((F.col("day") >= since // DAY) & (F.col("time") > since))
    if until is not None:
        rows = rows.where((F.col("day") <= until // DAY) & (F.col("time") <= until))
    return rows.drop("day")


def compact(spark: SparkSession, path: str, target: str, limit: int) -> None:
    """Writes what retention keeps into a new folder."""
    from palimpsest.operators.windows import retire

    append(retire(read(spark, path), limit), target)


def json_lines(cells: DataFrame) -> DataFrame:
    """Each cell as a JSON object, tombstones with a null value."""
    return cells.select(F.to_json(F.struct("key", "time", "value"), {"ignoreNullFields": "false"}).alias("json"))
