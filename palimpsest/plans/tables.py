"""The model's tables as views of the driver's, in Spark and (``SQL``) in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.model import micros

#: 2024-01-08 and 2024-01-15, 00:00 UTC.
EARLIER, LATER = 1_704_672_000_000_000, 1_705_276_800_000_000
HOUR, DAY = 3_600_000_000, 86_400_000_000
START = 1_704_067_200_000_000
#: Rows that a task is meant to hold where rows are dealt by number.
TASK_ROWS = 500_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` by their keys, in as many partitions as their number takes: what a task holds does not grow with the table."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-rows.count() // TASK_ROWS)), *keys)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events are the versions of a key; errors play the tombstones."""
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), micros("ts").alias("time"), F.when(F.col("event_type") != "error", F.col("value")).alias("value"))


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cells with the event's number, kind and properties."""
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("key"), micros("ts").alias("time"), F.when(F.col("event_type") != "error", F.col("value")).alias("value"), "event_id", F.col("event_type").alias("kind"), "props")


def read_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer reads the key of its own number, eight hours later for each nation."""
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("op_index"), F.col("c_custkey").alias("key"), (F.lit(EARLIER) + F.col("c_nationkey").cast("long") * (8 * HOUR)).alias("rt"))


def write_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer writes the key of its own number, in the way of its market segment."""
    op = F.when(F.col("c_mktsegment") == "AUTOMOBILE", "create").when(F.col("c_mktsegment") == "BUILDING", "hold").when(F.col("c_mktsegment") == "FURNITURE", "delete").otherwise("update")
    return read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("op_index"), op.alias("op"), F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"), (F.lit(START) + F.col("c_nationkey").cast("long") * (32 * HOUR)).alias("ct"))


def movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("movie_id"), F.col("p_name").alias("title"), F.date_format(F.date_add(F.lit("1950-01-01").cast("date"), F.col("p_size") * 365), "yyyy-MM-dd").alias("released"))


def actors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("actor_id"), F.col("s_name").alias("name"), F.date_format(F.date_add(F.lit("1930-01-01").cast("date"), F.col("s_nationkey") * 365), "yyyy-MM-dd").alias("born"))


def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One role for each part and supplier that an order has together; it stands where its first order line does."""
    lines = dealt(read(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")
    return lines.groupBy(F.col("l_partkey").alias("movie_id"), F.col("l_suppkey").alias("actor_id")).agg(F.min("l_orderkey").alias("position"), F.min("l_returnflag").alias("role"))


SQL = {
    "cells": "cells as (select user_id as key, epoch_us(ts) as time, case when event_type <> 'error' then value end as value from events)",
    "tagged": "tagged as (select user_id as key, epoch_us(ts) as time, case when event_type <> 'error' then value end as value, event_id, event_type as kind, props from events)",
    "read_ops": f"read_ops as (select c_custkey as op_index, c_custkey as key, {EARLIER} + c_nationkey::bigint * {8 * HOUR} as rt from customer)",
    "write_ops": f"""write_ops as (select c_custkey as op_index, case c_mktsegment when 'AUTOMOBILE' then 'create' when 'BUILDING' then 'hold' when 'FURNITURE' then 'delete' else 'update' end as op,
        c_custkey as key, c_acctbal as value, {START} + c_nationkey::bigint * {32 * HOUR} as ct from customer)""",
    "movies": "movies as (select p_partkey as movie_id, p_name as title, strftime(date '1950-01-01' + (p_size * 365)::integer, '%Y-%m-%d') as released from part)",
    "actors": "actors as (select s_suppkey as actor_id, s_name as name, strftime(date '1930-01-01' + (s_nationkey * 365)::integer, '%Y-%m-%d') as born from supplier)",
    "roles": "roles as (select l_partkey as movie_id, l_suppkey as actor_id, min(l_orderkey) as position, min(l_returnflag) as role from lineitem group by all)",
    "newest": "newest as (select * from cells qualify row_number() over (partition by key order by time desc) = 1)",
}


def sql(names: str, body: str) -> str:
    """``body`` under the named views."""
    return "with " + ",\n".join(SQL[n] for n in names.split()) + "\n" + body
