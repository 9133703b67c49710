"""Synthetic load: preloaded entries, and operations whose keys are drawn uniformly or by Zipf's law."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys whose cumulated weights are sent to all tasks, eight bytes each, at most.
MAX_KEYSPACE = 10_000_000


def key_for(i: Column) -> Column:
    return F.format_string("bench:key:%09d", i)


def preload(spark: SparkSession, keyspace: int, value_size: int) -> DataFrame:
    """key, value of every key once; all values are the alphabet over and over."""
    value = ("abcdefghijklmnopqrstuvwxyz" * (value_size // 26 + 1))[:value_size]
    return spark.range(keyspace).select(key_for(F.col("id")).alias("key"), F.lit(value).alias("value"))


def uniform(i: Column, seed: int, stream: int = 0) -> Column:
    """A number in [0, 1) that depends on i, seed and stream alone, so a task that is run again draws the same."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(stream), i), F.lit(1 << 52)) / float(1 << 52)


def operations(spark: SparkSession, count: int, keyspace: int, reads: float, seed: int = 1, zipf_s: float | None = None) -> DataFrame:
    """seq, op, key of so many operations; the k-th key has a weight of (1 + k)^-zipf_s, or all keys the same."""
    rows = spark.range(count).select(F.col("id").alias("seq"), F.when(uniform(F.col("id"), seed, 1) < reads, "GET").otherwise("SET").alias("op"), uniform(F.col("id"), seed).alias("u"))
    if zipf_s is None:
        return rows.select("seq", "op", key_for(F.floor(F.col("u") * keyspace)).alias("key"))
    if keyspace > MAX_KEYSPACE:
        raise ValueError(f"keyspace is over {MAX_KEYSPACE}")
    upto = np.cumsum((1.0 + np.arange(keyspace)) ** -zipf_s)
    upto /= upto[-1]
    table = spark.sparkContext.broadcast(upto)

    @F.pandas_udf("long")
    def rank(u: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(table.value, u.to_numpy(), side="right").clip(max=keyspace - 1))

    return rows.select("seq", "op", key_for(rank("u")).alias("key"))
