"""Self-consistency of a store's settings, as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The names that a setting may have, and bounds.
ENGINES = ("sharded", "global", "actor")
FSYNC = ("always", "everysec", "no")
POLICIES = ("allkeys-lru", "volatile-lru", "noeviction")
EXPIRY = ("lazy", "sampled", "wheel")
CONNECTIONS = ("goroutine", "pool")
ROLES = ("primary", "replica")
MAX_VALUE_LEN, MIN_SEGMENT = 16 << 20, 4096


def config_error(c=F.col) -> Column:
    """The first setting that is wrong, in the order of the rules, or null; c gives the column of a setting."""
    named = [("engine", ENGINES), ("fsync", FSYNC), ("max_memory_policy", POLICIES), ("expiry", EXPIRY), ("conn_mode", CONNECTIONS), ("role", ROLES)]
    rules = [("shards", (c("shards") <= 0) | (c("shards").bitwiseAND(c("shards") - 1) != 0)), *((name, ~F.coalesce(c(name).isin(*known), F.lit(False))) for name, known in named)]
    rules += [
        ("replicaof", (c("role") == "replica") & (F.coalesce(c("replicaof"), F.lit("")) == "")), ("evict_sample_k", c("evict_sample_k") < 1),
        ("low_water_ratio", (c("low_water_ratio") <= 0) | (c("low_water_ratio") > 1)), ("max_value_len", (c("max_value_len") <= 0) | (c("max_value_len") > MAX_VALUE_LEN)),
        ("segment_size", c("segment_size") < MIN_SEGMENT), ("workers", c("workers") < 1), ("data_dir", F.coalesce(c("data_dir"), F.lit("")) == ""),
    ]
    out = F.when(F.lit(False), "")
    for name, wrong in rules:
        out = out.when(wrong, name)
    return out
