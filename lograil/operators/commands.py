"""Results of a command log: each command sees its key as the commands before it left it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .replay import before_each

MUTATIONS = ("SET", "DELETE", "EXPIRE")
MAX_KEY, MAX_VALUE, MAX_TTL = 65_535, 16 * 1024 * 1024, 1 << 50


def deadline(now: Column, ttl: Column) -> Column:
    """Absolute deadline; ttl 0 means none, and longer ones are clamped."""
    return F.when(ttl == 0, F.lit(0)).otherwise(now + F.least(ttl, F.lit(MAX_TTL))).cast("long")


def validation_status(key: Column, value: Column) -> Column:
    """Why a SET is refused: the key's length is looked at first."""
    size = F.octet_length(key)
    return (
        F.when(F.coalesce(size, F.lit(0)) == 0, "BAD_REQUEST")
        .when(size > MAX_KEY, "TOO_LARGE")
        .when(F.coalesce(F.octet_length(value), F.lit(0)) > MAX_VALUE, "TOO_LARGE")
        .otherwise("OK")
    )


def results(commands: DataFrame) -> DataFrame:
    """command_log -> seq, op, key, status, value, ttl_left_ms, bool_result; one shuffle by key."""
    kind = F.when(F.col("op") == "DELETE", "DEL").otherwise(F.col("op"))
    log = commands.select(
        F.col("seq").alias("lsn"), F.col("at_ms").alias("created_at_ms"), kind.alias("rec_type"), "key", "value",
        F.when(F.col("op").isin(*MUTATIONS), deadline(F.col("at_ms"), F.col("ttl_ms"))).alias("expire_at_ms"), "op",
    )
    seen = before_each(log)
    live, op = F.col("live_before"), F.col("op")
    found = op.isin("GET", "TTL")
    left = F.when(F.col("deadline_before") == 0, F.lit(-1)).otherwise(F.greatest(F.lit(0), F.col("deadline_before") - F.col("created_at_ms")))
    return seen.select(
        F.col("lsn").alias("seq"), "op", "key", F.when(found & ~live, "NOT_FOUND").otherwise("OK").alias("status"),
        F.when((op == "GET") & live, F.col("value_before")).alias("value"), F.when((op == "TTL") & live, left).cast("long").alias("ttl_left_ms"),
        F.when(op.isin("EXISTS", "DELETE", "EXPIRE"), live).alias("bool_result"),
    )


def read_only_gate(commands: DataFrame, read_only: Column) -> DataFrame:
    """seq, op, status: mutations on a read-only node are refused."""
    return commands.select("seq", "op", F.when(F.col("op").isin(*MUTATIONS) & read_only, "READ_ONLY").otherwise("OK").alias("status"))
