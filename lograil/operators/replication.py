"""Catch-up, fencing, lag and audits between a primary's log and its followers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def catch_up(log: DataFrame, live_feed: DataFrame, position: int) -> DataFrame:
    """Records after position from the log and an overlapping live feed, each once."""
    return log.where(F.col("lsn") > position).unionByName(live_feed.where(F.col("lsn") > position)).dropDuplicates(["lsn"])


def full_resync(live: DataFrame, lsn: Column) -> DataFrame:
    """BEGIN, every live entry as a SET at one lsn, END, in this order by `ord`."""
    one = live.sparkSession.range(1)
    edge = lambda kind, ord_: one.select(F.lit(kind).alias("msg_type"), lsn.alias("lsn"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value"), F.lit(ord_).alias("ord"))
    body = live.select(F.lit("RECORD").alias("msg_type"), lsn.alias("lsn"), "key", "value", F.lit(1).alias("ord"))
    return edge("FULL_BEGIN", 0).unionByName(body).unionByName(edge("FULL_END", 2))


def resync_kind(position: Column, first_lsn: Column) -> Column:
    """full iff the follower is new, there are no segments, or they begin after position + 1."""
    return F.when((position == 0) | first_lsn.isNull() | (position + 1 < first_lsn), "full").otherwise("partial")


def fence(messages: DataFrame, order: str = "lsn", stream: str = "stream") -> DataFrame:
    """Adds accepted: a message of an epoch below the highest one seen before it on its stream is refused."""
    seen = Window.partitionBy(stream).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumn("accepted", F.col("epoch") >= F.max("epoch").over(seen))


def peer_state(acks: DataFrame, now: Column, timeout_ms: int) -> DataFrame:
    """addr, acked_lsn, silent_ms, state: alive, suspect beyond timeout_ms, dead beyond twice that."""
    last = acks.groupBy("addr").agg(F.max("lsn").alias("acked_lsn"), F.max("at_ms").alias("last_ms")).crossJoin(F.broadcast(now))
    silent = F.col("now") - F.col("last_ms")
    state = F.when(silent > 2 * timeout_ms, "dead").when(silent > timeout_ms, "suspect").otherwise("alive")
    return last.select("addr", "acked_lsn", silent.alias("silent_ms"), state.alias("state"))


def lag(applied: DataFrame, log: DataFrame) -> DataFrame:
    """addr, applied_lsn, lag: how far each follower is behind the log's last lsn, never below 0."""
    end = log.agg(F.max("lsn").alias("end"))
    return applied.crossJoin(F.broadcast(end)).select("addr", "applied_lsn", F.greatest(F.lit(0).cast("long"), F.col("end") - F.col("applied_lsn")).alias("lag"))


def missing_writes(acked: DataFrame, state: DataFrame) -> DataFrame:
    return acked.join(state, "key", "left_anti")


def wrong_writes(acked: DataFrame, state: DataFrame) -> DataFrame:
    """key, expected, actual of acknowledged writes that are there with another value."""
    s = state.select("key", F.col("value").alias("actual"))
    return acked.join(s, "key").where(~F.col("value").eqNullSafe(F.col("actual"))).select("key", F.col("value").alias("expected"), "actual")


def compare_states(a: DataFrame, b: DataFrame) -> DataFrame:
    """key, verdict: left only, right only or different; equal keys are left out."""
    left = a.select("key", F.struct("value").alias("l"))
    right = b.select("key", F.struct("value").alias("r"))
    both = left.join(right, "key", "full")
    verdict = F.when(F.col("r").isNull(), "left only").when(F.col("l").isNull(), "right only").when(~F.col("l").eqNullSafe(F.col("r")), "different")
    return both.select("key", verdict.alias("verdict")).where("verdict is not null")


def deletes_of_expired(state: DataFrame, now: Column) -> DataFrame:
    """A synthetic DEL for each expired entry, with the deadline it is about.

    A DEL whose deadline isn't the key's any more must be ignored, so a later SET is never lost.
    """
    rows = state.crossJoin(F.broadcast(now)).where((F.col("expire_at_ms") != 0) & (F.col("expire_at_ms") <= F.col("now")))
    return rows.select("key", F.lit("DEL").alias("rec_type"), F.col("expire_at_ms").alias("about_deadline"))
