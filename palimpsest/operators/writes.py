"""Conditional batches: what conflicts, and what a batch that does not conflict appends.

Checks are joins of a batch with the current versions, so that a batch may be as large as a
table. A batch is all or nothing: any conflict, and nothing is appended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.windows import newest

COLLISION, STALE = "collision", "stale"
KINDS = ("create", "hold", "update", "delete")


def current(ops: DataFrame, cells: DataFrame) -> DataFrame:
    """``ops`` (op_index, op, key, value, ct) with now_time (0 if none) and now_value."""
    # Versions combine before any shuffle; only one row of a key is joined, so no task sorts cells.
    now = newest(cells).select("key", F.col("time").alias("now_time"), F.col("value").alias("now_value"))
    return ops.join(now, "key", "left").withColumn("now_time", F.coalesce("now_time", F.lit(0)))


def conflict() -> Column:
    """create collides with a value that is there; the others are stale if the key changed after their condition time."""
    return F.when((F.col("op") == "create") & F.col("now_value").isNotNull(), COLLISION).when((F.col("op") != "create") & (F.col("ct") < F.col("now_time")), STALE)


def conflicts(ops: DataFrame, cells: DataFrame) -> DataFrame:
    """(op_index, key, conflict, now_time) of the ops that cannot be applied."""
    return current(ops, cells).withColumn("conflict", conflict()).where(F.col("conflict").isNotNull()).select("op_index", "key", "conflict", "now_time")


def outcome(ops: DataFrame, cells: DataFrame, clock: int) -> DataFrame:
    """One row: how many ops collide or are stale, the newest time among stale ones, and the write time if there is none.

    The write time is after everything that the batch saw and after ``clock``. Collisions are reported before stale ops.
    """
    found = current(ops, cells).withColumn("conflict", conflict())
    counts = found.agg(
        F.count(F.when(F.col("conflict") == COLLISION, 1)).alias("collisions"), F.count(F.when(F.col("conflict") == STALE, 1)).alias("stale"),
        F.max(F.when(F.col("conflict") == STALE, F.col("now_time"))).alias("stale_time"), F.coalesce(F.max("now_time"), F.lit(0)).alias("seen"))
    status = F.when(F.col("collisions") > 0, COLLISION).when(F.col("stale") > 0, STALE).otherwise("committed")
    return counts.select(status.alias("status"), "collisions", "stale", "stale_time", F.when(status == "committed", F.greatest("seen", F.lit(clock)) + 1).alias("wt"))


def appended(ops: DataFrame, cells: DataFrame, clock: int) -> DataFrame:
    """The cells that the batch adds: none if anything conflicts. hold adds nothing, delete a tombstone."""
    wt = outcome(ops, cells, clock).select("wt").scalar()
    value = F.when(F.col("op") != "delete", F.col("value"))
    return ops.where(F.col("op") != "hold").select("key", wt.alias("time"), value.alias("value")).where(F.col("time").isNotNull())


def appliable(ops: DataFrame, cells: DataFrame) -> DataFrame:
    """The ops that conflict with nothing, each taken as a batch of its own."""
    return current(ops, cells).where(conflict().isNull()).select(*ops.columns)


def batch_errors(ops: DataFrame, tables: DataFrame) -> DataFrame:
    """(error, what, n) of a request's ops (op_index, op, table, key): unknown op, unknown table, a row named twice, and holds alone."""
    op = F.lower("op")
    unknown_op = ops.where(~op.isin(*KINDS)).groupBy(op.alias("what")).count().select(F.lit("unknown op").alias("error"), "what", F.col("count").alias("n"))
    unknown_table = ops.join(tables.select("table"), "table", "left_anti").groupBy(F.col("table").alias("what")).count().select(F.lit("unknown table").alias("error"), "what", F.col("count").alias("n"))
    twice = ops.groupBy("table", "key").count().where("count > 1").select(F.lit("row named twice").alias("error"), F.concat_ws("/", "table", F.col("key").cast("string")).alias("what"), F.col("count").alias("n"))
    holds = ops.agg(F.count("*").alias("n"), F.count(F.when(op != "hold", 1)).alias("changes")).where("n > 0 AND changes = 0").select(F.lit("holds alone").alias("error"), F.lit("").alias("what"), "n")
    return unknown_op.unionByName(unknown_table).unionByName(twice).unionByName(holds)


def overlay(reads: DataFrame, changes: DataFrame) -> DataFrame:
    """A transaction's own view: what it read, under what it has changed since."""
    mine = changes.select("key", F.col("op").alias("own_op"), F.col("value").alias("own_value"))
    both = reads.select("key", "value").join(mine, "key", "full_outer")
    value = F.when(F.col("own_op") == "delete", F.lit(None)).when(F.col("own_op").isin("create", "update"), F.col("own_value")).otherwise(F.col("value"))
    state = F.when(F.col("own_op") == "delete", "deleted").when(F.col("own_op") == "create", "created").when(F.col("own_op") == "update", "updated").when(F.col("value").isNull(), "not found").otherwise("found")
    return both.select("key", state.alias("state"), value.alias("value"))


def executed(view: DataFrame) -> DataFrame:
    """The batch of a transaction: its changes, and a hold for every row that it only read."""
    op = F.when(F.col("state") == "created", "create").when(F.col("state") == "updated", "update").when(F.col("state") == "deleted", "delete").otherwise("hold")
    return view.select("key", op.alias("op"), F.when(op.isin("create", "update"), F.col("value")).alias("value"))


def row_status(op: Column, found: Column) -> Column:
    """HTTP status of a single row's write: 409 for a collision, 412 if stale, else 200."""
    return F.when(found == COLLISION, 409).when(found == STALE, 412).otherwise(200)
