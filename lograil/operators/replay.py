"""The fold of a mutation log into a keyspace, and everything that reads it.

Records of a key apply in the order of lsn, each with its own created_at_ms as the time. SET replaces value and
deadline, DEL removes the key, EXPIRE moves the deadline of a key that is live then and else does nothing. A
record whose deadline has passed (`expire_at_ms <= now`, 0 means never) is dead for good until the next SET.

An epoch is a SET or DEL with the EXPIREs after it; within it, an EXPIRE that comes after the deadline before it
ends the epoch's life. What a key is at each record takes one shuffle of the log by key; what it is at the end
needs its last epoch only, and partial aggregation finds that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_KEYS, MAX_KEYS = 100, 10_000


def expired(now: Column | int) -> Column:
    return (F.col("expire_at_ms") != 0) & (F.col("expire_at_ms") <= (F.lit(now) if isinstance(now, int) else now))


def remaining(now: Column) -> Column:
    """Milliseconds left, -1 without a deadline."""
    return F.when(F.col("expire_at_ms") == 0, F.lit(-1)).otherwise(F.greatest(F.lit(0), F.col("expire_at_ms") - now)).cast("long")


WRITES = ("SET", "DEL", "EXPIRE")


def with_epochs(log: DataFrame, order: tuple[str, ...] = ("lsn",)) -> DataFrame:
    """Adds epoch, lead (the type that began it) and dead to each record.

    Records of other types (reads) change nothing and see the state they meet.
    """
    by_key = Window.partitionBy("key").orderBy(*order)
    log = log.withColumn("epoch", F.sum(F.col("rec_type").isin("SET", "DEL").cast("int")).over(by_key))
    in_epoch = Window.partitionBy("key", "epoch").orderBy(*order)
    written = F.when(F.col("rec_type").isin(*WRITES), F.col("expire_at_ms"))
    before = F.last(written, ignorenulls=True).over(in_epoch.rowsBetween(Window.unboundedPreceding, -1))
    late = (F.col("rec_type") == "EXPIRE") & (before != 0) & (before <= F.col("created_at_ms"))
    log = log.withColumns({"lead": F.first("rec_type").over(in_epoch), "late": F.coalesce(late, F.lit(False)).cast("int")})
    return log.withColumn("dead", F.max("late").over(in_epoch)).drop("late")


def keyspace(log: DataFrame) -> DataFrame:
    """kv_state(key, value, expire_at_ms, last_lsn) at the end of the log; deadlines still to be compared with a time.

    Each key's last SET or DEL is found by partial aggregation, so a key with a third of the records sends a row from
    each task. Only the EXPIREs that come after a last SET are ordered: one that comes after the deadline before it
    ends the entry's life.
    """
    lead = F.max(F.when(F.col("rec_type").isin("SET", "DEL"), F.struct("lsn", "rec_type", "value", "expire_at_ms"))).alias("s")
    lead = log.groupBy("key").agg(lead, F.max("lsn").alias("last_lsn")).where("s.rec_type = 'SET'")
    moves = log.where("rec_type = 'EXPIRE'").select("key", F.col("lsn").alias("at"), "created_at_ms", F.col("expire_at_ms").alias("moved"))
    moves = moves.join(lead.select("key", "s.lsn", "s.expire_at_ms"), "key").where("at > lsn")
    before = F.coalesce(F.lag("moved").over(Window.partitionBy("key").orderBy("at")), "expire_at_ms")
    moves = moves.withColumn("late", (before != 0) & (before <= F.col("created_at_ms")))
    ends = moves.groupBy("key").agg(F.max(F.struct("at", "moved"))["moved"].alias("moved"), F.max("late").alias("dead"))
    state = lead.join(ends, "key", "left").where(~F.coalesce("dead", F.lit(False)))
    return state.select("key", "s.value", F.coalesce("moved", "s.expire_at_ms").alias("expire_at_ms"), "last_lsn")


def log_end(log: DataFrame) -> DataFrame:
    """One row: the time of the log's last record."""
    return log.agg(F.max("created_at_ms").alias("now"))


def at_end(state: DataFrame, log: DataFrame) -> DataFrame:
    """state with the scalar `now`."""
    return state.crossJoin(F.broadcast(log_end(log)))


def live_at_end(log: DataFrame) -> DataFrame:
    return at_end(keyspace(log), log).where(~expired(F.col("now"))).drop("now")


def as_of_lsn(log: DataFrame, lsn: int) -> DataFrame:
    """Live keys right after the record with that lsn."""
    return live_at_end(log.where(F.col("lsn") <= lsn))


def keys_with_prefix(live: DataFrame, prefix: str, limit: int) -> DataFrame:
    """Up to limit keys in byte order; limit <= 0 means DEFAULT_KEYS and MAX_KEYS bounds it."""
    limit = DEFAULT_KEYS if limit <= 0 else min(limit, MAX_KEYS)
    return live.where(F.col("key").startswith(prefix)).select("key").orderBy("key").limit(limit)


def listing(live: DataFrame, shown: int) -> DataFrame:
    """ord, line: the first `shown` keys in byte order, and how many more there are."""
    top = live.select("key").orderBy("key").limit(shown)
    lines = top.groupBy().agg(F.array_sort(F.collect_list("key")).alias("k")).select(F.posexplode("k").alias("ord", "key"))
    more = live.agg(F.count("*").alias("n")).where(F.col("n") > shown)
    last = more.select(F.lit(shown).alias("ord"), F.concat(F.lit("  ... and "), (F.col("n") - shown).cast("string"), F.lit(" more")).alias("line"))
    return lines.select("ord", F.concat(F.lit("  "), "key").alias("line")).unionByName(last).withColumn("ord", F.col("ord").cast("long"))


def before_each(log: DataFrame, order: tuple[str, ...] = ("lsn",)) -> DataFrame:
    """Adds live_before, value_before and deadline_before: what the key was when the record came."""
    by_key = Window.partitionBy("key").orderBy(*order)
    past = by_key.rowsBetween(Window.unboundedPreceding, -1)
    value = F.last(F.when(F.col("rec_type") == "SET", F.struct("value")), ignorenulls=True).over(past)["value"]
    deadline = F.last(F.when(F.col("rec_type").isin(*WRITES), F.col("expire_at_ms")), ignorenulls=True).over(past)
    e = with_epochs(log, order).withColumns({
        "p_lead": F.lag("lead").over(by_key), "p_dead": F.lag("dead").over(by_key), "p_deadline": deadline, "p_value": value,
    })
    due = (F.col("p_deadline") != 0) & (F.col("p_deadline") <= F.col("created_at_ms"))
    live = F.coalesce((F.col("p_lead") == "SET") & (F.col("p_dead") == 0) & ~due, F.lit(False))
    e = e.withColumn("live_before", live)
    return e.withColumns({
        "value_before": F.when(F.col("live_before"), F.col("p_value")), "deadline_before": F.when(F.col("live_before"), F.col("p_deadline")),
    }).select(*log.columns, "live_before", "value_before", "deadline_before")


def as_of_probes(log: DataFrame, probes: DataFrame) -> DataFrame:
    """probes(probe, key, at_lsn) -> probe, key, found, value: the key right after at_lsn, at that record's time.

    Probes go into the log as reads, so any number of them takes one shuffle by key.
    """
    times = log.select(F.col("lsn").alias("at_lsn"), "created_at_ms")
    reads = probes.join(times, "at_lsn").select("probe", "key", F.col("at_lsn").alias("lsn"), "created_at_ms", F.lit("PROBE").alias("rec_type"))
    every = log.withColumn("probe", F.lit(-1).cast("long")).unionByName(reads, allowMissingColumns=True)
    seen = before_each(every, ("lsn", "probe")).where("rec_type = 'PROBE'")
    return seen.select("probe", "key", F.col("live_before").alias("found"), F.col("value_before").alias("value"))


def snapshot_rows(live: DataFrame, lsn: Column, at: Column) -> DataFrame:
    """A snapshot's entries as SET records at its last lsn."""
    return live.select(lsn.alias("lsn"), at.alias("created_at_ms"), F.lit("SET").alias("rec_type"), "key", "value", "expire_at_ms")


def recover(snapshot: DataFrame, log: DataFrame, snapshot_lsn: int) -> DataFrame:
    """Keyspace from a snapshot that includes all up to snapshot_lsn, and the log's tail."""
    tail = log.where(F.col("lsn") > snapshot_lsn)
    rows = snapshot_rows(snapshot, F.lit(snapshot_lsn).cast("long"), F.lit(0).cast("long"))
    return keyspace(rows.unionByName(tail))


def with_flushes(log: DataFrame, flush_type: str = "FLUSH") -> DataFrame:
    """Drops all records up to the last FLUSH, a record without a key."""
    last = log.where(F.col("rec_type") == flush_type).agg(F.coalesce(F.max("lsn"), F.lit(0)).alias("flushed"))
    return log.where(F.col("rec_type") != flush_type).crossJoin(F.broadcast(last)).where("lsn > flushed").drop("flushed")
