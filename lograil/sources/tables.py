"""Adapters that turn the supplied tables into logs, keyspaces and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR = 3_600_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")  # zone-less timestamps are read as UTC
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mutation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as mutation_log(lsn, created_at_ms, rec_type, key, value, expire_at_ms).

    view, click and purchase set a key, error deletes it, signup moves its deadline.
    """
    e = table(spark, sf_dir, "events")
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    kind = F.col("event_type")
    rec_type = F.when(kind == "error", "DEL").when(kind == "signup", "EXPIRE").otherwise("SET")
    deadline = F.when(kind == "click", at + 6 * HOUR).when(kind == "signup", at + 12 * HOUR).otherwise(F.lit(0))
    return e.select(
        (F.col("event_id") + 1).alias("lsn"), at.alias("created_at_ms"), rec_type.alias("rec_type"),
        F.format_string("user:%06d", "user_id").alias("key"), F.when(rec_type == "SET", F.col("props")).alias("value"),
        deadline.cast("long").alias("expire_at_ms"),
    )


def order_keyspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as kv_state(key, value, expire_at_ms, last_access_ms); one in three has a deadline."""
    o = table(spark, sf_dir, "orders")
    at = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    return o.select(
        F.format_string("order:%09d", "o_orderkey").alias("key"), F.concat_ws("|", "o_orderstatus", "o_orderpriority").alias("value"),
        F.when(F.col("o_orderkey") % 3 == 0, at + 30 * 24 * HOUR).otherwise(F.lit(0)).cast("long").alias("expire_at_ms"), at.alias("last_access_ms"),
    )


def latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events.value as latency(worker, ns)."""
    e = table(spark, sf_dir, "events")
    return e.select((F.col("event_id") % 8).cast("int").alias("worker"), F.round(F.col("value") * 1_000_000).cast("long").alias("ns"))


def command_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as command_log(seq, at_ms, op, key, value, ttl_ms): GET, SET, EXISTS, DELETE, EXPIRE."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    op = F.when(kind == "view", "GET").when(kind == "click", "SET").when(kind == "purchase", "TTL").when(kind == "error", "DELETE").otherwise("EXPIRE")
    ttl = F.when(kind == "click", 6 * HOUR).when(kind == "signup", 12 * HOUR).otherwise(F.lit(0))
    return e.select(
        (F.col("event_id") + 1).alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), op.alias("op"),
        F.format_string("user:%06d", "user_id").alias("key"), F.when(op == "SET", F.col("props")).alias("value"), ttl.cast("long").alias("ttl_ms"),
    )
