"""Every registered query of the keyed-log engine, and the DuckDB SQL that yields the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import commands, generate, histogram, memory, replay, replication, wal
from ..sources import tables as src
from . import sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
MID, TAIL, SHARDS = 0.5, 100, 16
QS = [0.5, 0.9, 0.99, 0.999]


def query(oracle: str | None = None):
    """Registers a function of (spark, sf_dir) under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _log(spark: SparkSession, d: str) -> DataFrame:
    return src.mutation_log(spark, d)


def _live(spark: SparkSession, d: str) -> DataFrame:
    return replay.live_at_end(_log(spark, d))


def _now(spark: SparkSession, d: str) -> DataFrame:
    return replay.log_end(_log(spark, d))


# Reads and the fold.


@query(sql.live("SELECT key, value, expire_at AS expire_at_ms, last_lsn FROM live"))
def kv_replay(spark, d):
    return _live(spark, d)


@query(sql.live("SELECT key, value FROM live WHERE key = 'user:000007'"))
def kv_get(spark, d):
    # The filter on the key goes below the fold's windows, into the scan.
    log = _log(spark, d)
    state = replay.at_end(replay.keyspace(log.where(F.col("key") == "user:000007")), log)
    return state.where(~replay.expired(F.col("now"))).select("key", "value")


@query(sql.live("SELECT p.key, l.key IS NOT NULL AS found FROM (SELECT printf('user:%06d', c_custkey) AS key FROM customer) p LEFT JOIN live l ON p.key = l.key"))
def kv_exists(spark, d):
    probes = src.table(spark, d, "customer").select(F.format_string("user:%06d", "c_custkey").alias("key"))
    return probes.join(_live(spark, d).select("key", F.lit(True).alias("hit")), "key", "left").select("key", F.coalesce("hit", F.lit(False)).alias("found"))


@query(sql.log(f"SELECT key, CASE WHEN expire_at = 0 THEN -1 ELSE expire_at - {sql.NOW} END::BIGINT AS ttl_ms FROM live", sql.fold(), sql.LIVE))
def kv_ttl(spark, d):
    log = _log(spark, d)
    state = replay.at_end(replay.keyspace(log), log).where(~replay.expired(F.col("now")))
    return state.select("key", replay.remaining(F.col("now")).alias("ttl_ms"))


@query(sql.live("SELECT key, value FROM live"))
def kv_range(spark, d):
    return _live(spark, d).select("key", "value")


@query(sql.live("SELECT key FROM live WHERE starts_with(key, 'user:00001') ORDER BY key LIMIT 100"))
def kv_keys_prefix(spark, d):
    return replay.keys_with_prefix(_live(spark, d), "user:00001", 0)


@query(sql.live("SELECT key FROM live ORDER BY key LIMIT 7"))
def kv_keys_limit(spark, d):
    return replay.keys_with_prefix(_live(spark, d), "", 7)


@query(sql.live("SELECT key FROM live ORDER BY key LIMIT 10000"))
def kv_keys_sorted(spark, d):
    return replay.keys_with_prefix(_live(spark, d), "", replay.MAX_KEYS + 1)


@query(sql.live("SELECT key, value FROM live ORDER BY key LIMIT 20"))
def kv_replay_top(spark, d):
    return _live(spark, d).select("key", "value").orderBy("key").limit(20)


@query(sql.live("""SELECT i AS ord, CASE WHEN i < 20 THEN '  ' || key ELSE '  ... and ' || (n - 20) || ' more' END AS line
FROM (SELECT key, row_number() OVER (ORDER BY key) - 1 AS i, count(*) OVER () AS n FROM live) WHERE i <= 20"""))  # fmt: skip
def kv_replay_more(spark, d):
    return replay.listing(_live(spark, d), 20)


def _cut(log: DataFrame) -> int:
    """The lsn in the middle of the log, read first, so that filters on it reach the scan as literals."""
    return int((log.agg(F.max("lsn")).first()[0] or 0) * MID)


def _half(spark, d) -> DataFrame:
    """The log's first half by lsn."""
    log = _log(spark, d)
    return log.where(F.col("lsn") <= _cut(log))


HALF = "half AS (SELECT * FROM log WHERE lsn <= (SELECT floor(max(lsn) * 0.5) FROM log))"
REST = "rest AS (SELECT * FROM log WHERE lsn > (SELECT floor(max(lsn) * 0.5) FROM log))"
LIVE_HALF = "livehalf AS (SELECT * FROM kvh WHERE expire_at = 0 OR expire_at > (SELECT max(tm) FROM half))"


@query(sql.log("SELECT key, value, expire_at AS expire_at_ms, last_lsn FROM livehalf", HALF, sql.fold("half", "h"), LIVE_HALF))
def kv_asof_lsn(spark, d):
    return replay.live_at_end(_half(spark, d))


@query(
    sql.log(
        """SELECT p.probe, p.key, coalesce(g.lead_type = 'SET' AND g.dead = 0 AND (g.expire_at = 0 OR g.expire_at > p.tm), FALSE) AS found,
  CASE WHEN g.lead_type = 'SET' AND g.dead = 0 AND (g.expire_at = 0 OR g.expire_at > p.tm) THEN v.value END AS value
FROM probes p ASOF LEFT JOIN g ON p.key = g.key AND p.lsn >= g.lsn
ASOF LEFT JOIN (SELECT * FROM log WHERE rec_type = 'SET') v ON p.key = v.key AND p.lsn >= v.lsn""",
        sql.fold(),
        "probes AS (SELECT o_orderkey AS probe, printf('user:%06d', o_custkey % 150) AS key, l.lsn, l.tm FROM orders JOIN log l ON l.lsn = 1 + o_orderkey % (SELECT max(lsn) FROM log))",
    )
)
def kv_asof_probe(spark, d):
    log = _log(spark, d)
    end = F.broadcast(log.agg(F.max("lsn").alias("end")))
    probes = src.table(spark, d, "orders").crossJoin(end).select(
        F.col("o_orderkey").alias("probe"), F.format_string("user:%06d", F.col("o_custkey") % 150).alias("key"), (F.col("o_orderkey") % F.col("end") + 1).alias("at_lsn")
    )
    return replay.as_of_probes(log, probes)


@query(sql.log(f"SELECT lsn, key, expire_at AS expire_at_ms FROM log WHERE expire_at = 0 OR expire_at > {sql.NOW}"))
def live_filter(spark, d):
    log = _log(spark, d)
    return replay.at_end(log, log).where(~replay.expired(F.col("now"))).select("lsn", "key", "expire_at_ms")


@query(sql.log(f"SELECT count(*)::BIGINT AS purged, coalesce(sum(strlen(key) + strlen(value) + 160), 0)::BIGINT AS bytes FROM kv WHERE expire_at <> 0 AND expire_at <= {sql.NOW}", sql.fold()))
def purge_expired(spark, d):
    log = _log(spark, d)
    gone = replay.at_end(replay.keyspace(log), log).where(replay.expired(F.col("now")))
    return gone.agg(F.count("*").alias("purged"), F.coalesce(F.sum(memory.entry_cost()), F.lit(0)).alias("bytes"))


FLUSHED = "flushed AS (SELECT * FROM log WHERE lsn > (SELECT floor(max(lsn) * 0.5) FROM log))"


@query(sql.log(f"SELECT key, value FROM kvf WHERE expire_at = 0 OR expire_at > {sql.NOW}", FLUSHED, sql.fold("flushed", "f")))
def kv_flush(spark, d):
    log = _log(spark, d)
    # A FLUSH takes the place of the record in the middle of the log.
    kinds = log.withColumn("rec_type", F.when(F.col("lsn") == _cut(log), "FLUSH").otherwise(F.col("rec_type")))
    kept = replay.with_flushes(kinds)
    return replay.at_end(replay.keyspace(kept), log).where(~replay.expired(F.col("now"))).select("key", "value")


# Commands.


@query("WITH " + sql.COMMANDS + """
SELECT lsn AS seq, op, key, CASE WHEN op IN ('GET', 'TTL') AND NOT live THEN 'NOT_FOUND' ELSE 'OK' END AS status,
  CASE WHEN op = 'GET' AND live THEN v END AS value,
  CASE WHEN op = 'TTL' AND live THEN CASE WHEN d = 0 THEN -1 ELSE greatest(0, d - tm) END END::BIGINT AS ttl_left_ms,
  CASE WHEN op IN ('DELETE', 'EXPIRE') THEN live END AS bool_result FROM r""")  # fmt: skip
def cmd_results(spark, d):
    return commands.results(src.command_log(spark, d))


@query("WITH " + sql.COMMANDS + " SELECT op, count(*) AS answers FROM r WHERE lsn % 4 <> 0 GROUP BY op")
def cmd_noreply(spark, d):
    # Every fourth command carries the no-reply flag, so it runs without an answer.
    answers = commands.results(src.command_log(spark, d)).where(F.col("seq") % 4 != 0)
    return answers.groupBy("op").agg(F.count("*").alias("answers"))


@query("WITH " + sql.COMMANDS + " SELECT lsn AS seq, op, CASE WHEN op IN ('SET', 'DELETE', 'EXPIRE') AND lsn % 2 = 0 THEN 'READ_ONLY' ELSE 'OK' END AS status FROM cmd")
def cmd_readonly(spark, d):
    return commands.read_only_gate(src.command_log(spark, d), F.col("seq") % 2 == 0)


CANDIDATE = "CASE WHEN doc_id % 10 = 0 THEN '' WHEN doc_id % 10 = 1 THEN repeat('k', 70000) ELSE printf('doc:%d', doc_id) END"


@query(f"""SELECT doc_id, CASE WHEN strlen(k) = 0 THEN 'BAD_REQUEST' WHEN strlen(k) > 65535 THEN 'TOO_LARGE' WHEN strlen(text) > 16777216 THEN 'TOO_LARGE' ELSE 'OK' END AS status
FROM (SELECT doc_id, {CANDIDATE} AS k, text FROM documents)""")  # fmt: skip
def cmd_validate(spark, d):
    docs = src.table(spark, d, "documents")
    key = F.when(F.col("doc_id") % 10 == 0, "").when(F.col("doc_id") % 10 == 1, F.repeat(F.lit("k"), 70_000)).otherwise(F.format_string("doc:%d", "doc_id"))
    return docs.select("doc_id", commands.validation_status(key, F.col("text")).alias("status"))


@query("WITH " + sql.COMMANDS + " SELECT c.lsn AS seq, c.op, r.live AS answered_live FROM cmd c JOIN r ON c.lsn = r.lsn WHERE c.op IN ('DELETE', 'EXPIRE')")
def req_resp_match(spark, d):
    requests = src.command_log(spark, d)
    responses = commands.results(requests).select("seq", F.col("bool_result").alias("answered_live"))
    return requests.where(F.col("op").isin("DELETE", "EXPIRE")).select("seq", "op").join(responses, "seq")


# The log itself.


@query(sql.log("SELECT lsn, rec_type, key, coalesce(strlen(value), 0)::BIGINT AS value_bytes, expire_at AS expire_at_ms, tm AS created_at_ms FROM log WHERE lsn BETWEEN 10 AND 300"))
def wal_dump_range(spark, d):
    log = _log(spark, d).where(F.col("lsn").between(10, 300))
    return log.select("lsn", "rec_type", "key", F.coalesce(F.octet_length("value"), F.lit(0)).cast("long").alias("value_bytes"), "expire_at_ms", "created_at_ms")


@query(sql.log("SELECT lsn, rec_type, key, expire_at AS expire_at_ms FROM log ORDER BY lsn LIMIT 50"))
def wal_dump(spark, d):
    return _log(spark, d).select("lsn", "rec_type", "key", "expire_at_ms").orderBy("lsn").limit(50)


@query(sql.log("SELECT rec_type, count(*) AS records FROM log GROUP BY 1"))
def wal_by_type(spark, d):
    return wal.by_type(_log(spark, d))


@query(sql.log("""SELECT count(*) AS records, sum(strlen(key))::BIGINT AS key_bytes, coalesce(sum(strlen(value)), 0)::BIGINT AS value_bytes,
  min(lsn) AS min_lsn, max(lsn) AS max_lsn, sum(40 + strlen(key) + coalesce(strlen(value), 0)) / count(*) AS avg_record_bytes,
  max(lsn) - min(lsn) + 1 = count(*) AS dense FROM log"""))  # fmt: skip
def wal_stats(spark, d):
    return wal.stats(_log(spark, d))


@query(sql.log("SELECT max(lsn) - min(lsn) + 1 = count(*) AS dense, max(lsn) - min(lsn) + 1 - count(*) AS missing FROM log WHERE lsn % 97 <> 0"))
def wal_density(spark, d):
    log = _log(spark, d).where("lsn % 97 <> 0")
    span = F.max("lsn") - F.min("lsn") + 1
    return log.agg((span == F.count("*")).alias("dense"), (span - F.count("*")).alias("missing"))


@query(sql.log("""SELECT before AS after_lsn, lsn AS next_lsn, lsn - before - 1 AS missing
FROM (SELECT lsn, lag(lsn) OVER (ORDER BY lsn) AS before FROM log WHERE lsn % 97 > 1) WHERE lsn - before <> 1"""))  # fmt: skip
def wal_gaps(spark, d):
    return wal.gaps(_log(spark, d).where("lsn % 97 > 1"), 1000)


SEGMENTS = """seg AS (SELECT min(lsn) AS segment_first_lsn, count(*) AS records, sum(bytes)::BIGINT AS bytes FROM (
  SELECT lsn, bytes, floor((sum(bytes) OVER (ORDER BY lsn) - bytes) / 65536) AS s
  FROM (SELECT lsn, 40 + strlen(key) + coalesce(strlen(value), 0) AS bytes FROM log)) GROUP BY s)"""


def _segments(spark, d):
    return wal.assign_segments(_log(spark, d), 65_536, 20_000)


@query(sql.log("SELECT * FROM seg", SEGMENTS))
def wal_segment_assign(spark, d):
    return _segments(spark, d).select("segment_first_lsn", "records", "bytes")


@query(sql.log("SELECT segment_first_lsn, coalesce(lead(segment_first_lsn) OVER (ORDER BY segment_first_lsn) <= 5001, FALSE) AS dropped FROM seg", SEGMENTS))
def wal_truncate_below(spark, d):
    return wal.truncatable(_segments(spark, d).select("segment_first_lsn"), 5000)


@query(sql.log("SELECT key, lsn FROM log WHERE lsn > 500"))
def wal_replay(spark, d):
    return _log(spark, d).where("lsn > 500").select("key", "lsn")


@query(sql.log("SELECT count(*) AS records, min(l)::BIGINT AS min_lsn, max(l)::BIGINT AS max_lsn, count(DISTINCT l) AS lsns FROM (SELECT 1000 + row_number() OVER (ORDER BY tm, key, rec_type) AS l FROM log)"))
def wal_append(spark, d):
    out = wal.append(_log(spark, d), 1000)
    return out.agg(F.count("*").alias("records"), F.min("new_lsn").alias("min_lsn"), F.max("new_lsn").alias("max_lsn"), F.countDistinct("new_lsn").alias("lsns"))


@query(sql.log("SELECT (lsn - 1) // 1024 AS batch, count(*) AS records, min(lsn) AS first_lsn, max(lsn) AS last_lsn FROM log GROUP BY 1"))
def group_commit_batches(spark, d):
    return wal.commit_batches(_log(spark, d), 1024)


@query(sql.log("SELECT count(*) AS batches, sum(n)::BIGINT AS records, sum(n) / count(*) AS avg_batch FROM (SELECT count(*) AS n FROM log GROUP BY (lsn - 1) // 1024)"))
def group_commit_stats(spark, d):
    b = wal.commit_batches(_log(spark, d), 1024)
    return b.agg(F.count("*").alias("batches"), F.sum("records").alias("records"), (F.sum("records") / F.count("*")).alias("avg_batch"))


# Snapshots and recovery.


@query(sql.log("SELECT key, value, expire_at AS expire_at_ms, (SELECT max(lsn) FROM half) AS last_included_lsn FROM livehalf", HALF, sql.fold("half", "h"), LIVE_HALF))
def snapshot_build(spark, d):
    log = _log(spark, d)
    last = _cut(log)  # the lsn is fixed before the entries are read
    return replay.live_at_end(log.where(F.col("lsn") <= last)).select("key", "value", "expire_at_ms", F.lit(last).cast("long").alias("last_included_lsn"))


RECOVERED = """snap AS (SELECT (SELECT max(lsn) FROM half) AS lsn, 0::BIGINT AS tm, key, 'SET' AS rec_type, value, expire_at FROM livehalf),
joined AS (SELECT * FROM snap UNION ALL SELECT lsn, tm, key, rec_type, value, expire_at FROM rest)"""


@query(sql.log(f"SELECT key, value, expire_at AS expire_at_ms FROM kvj WHERE expire_at = 0 OR expire_at > {sql.NOW}", HALF, REST, sql.fold("half", "h"), LIVE_HALF, RECOVERED, sql.fold("joined", "j")))
def recover_snapshot_plus_log(spark, d):
    log = _log(spark, d)
    cut = _cut(log)
    state = replay.recover(replay.live_at_end(log.where(F.col("lsn") <= cut)), log, cut)
    return replay.at_end(state, log).where(~replay.expired(F.col("now"))).select("key", "value", "expire_at_ms")


@query(sql.log("""SELECT count(*) AS scanned, count(*) FILTER (lsn > 500) AS applied, count(*) FILTER (lsn <= 500) AS skipped,
  max(lsn) AS last_lsn, greatest(max(lsn), 500) + 1 AS next_lsn FROM log"""))  # fmt: skip
def recovery_report(spark, d):
    log = _log(spark, d)
    return log.agg(
        F.count("*").alias("scanned"), F.count_if(F.col("lsn") > 500).alias("applied"), F.count_if(F.col("lsn") <= 500).alias("skipped"),
        F.max("lsn").alias("last_lsn"), (F.greatest(F.max("lsn"), F.lit(500)) + 1).alias("next_lsn"),
    )


@query(sql.log("SELECT lsn, tm AS created_at_ms, rec_type, key, coalesce(value, '') AS value, expire_at AS expire_at_ms FROM log"))
def wal_files(spark, d):
    # The log is written as segments and recovered from them.
    from ..sources import folders, formats, recovery

    formats.register(spark)
    folder = folders.shared_folder(spark, "segments").removeprefix("file://")
    binary = [F.col(c).cast("binary").alias(c) for c in ("key", "value")]
    rows = _log(spark, d).select("lsn", "created_at_ms", "rec_type", F.lit(0).alias("flags"), *binary, "expire_at_ms")
    rows.repartitionByRange("lsn").sortWithinPartitions("lsn").write.format("keyed_log").option("segment_size", 256 << 10).mode("append").save(folder)
    _, log, plan = recovery.recover(spark, folder)
    assert plan.verdict == "continue"
    return log.select("lsn", "created_at_ms", "rec_type", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "expire_at_ms")


@query(sql.live("SELECT key, value, expire_at AS expire_at_ms, (SELECT max(lsn) FROM log) AS last_included_lsn FROM live"))
def snapshot_files(spark, d):
    # The live entries are written as a snapshot and loaded from it.
    from ..sources import folders, formats

    formats.register(spark)
    folder = folders.shared_folder(spark, "snapshots").removeprefix("file://")
    last = _log(spark, d).agg(F.max("lsn")).first()[0] or 0
    entries = _live(spark, d).select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), "expire_at_ms")
    entries.write.format("keyed_snapshot").option("last_lsn", last).mode("append").save(folder)
    got = spark.read.format("keyed_snapshot").load(folder)
    return got.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "expire_at_ms", "last_included_lsn")


@query(sql.log("""SELECT 'p' || (lsn % 4) AS stream, 'RECORD' AS msg_type, lsn, NULL::BIGINT AS epoch, rec_type, key FROM log
UNION ALL SELECT 'p' || i, 'HEARTBEAT', (SELECT max(lsn) FROM log), 3, NULL, NULL FROM range(4) t(i)"""))  # fmt: skip
def repl_messages(spark, d):
    # Four captures of a primary's stream, each ending in a heartbeat, are decoded.
    import pandas as pd

    from ..sources import captures, formats

    log = _log(spark, d)
    end = log.agg(F.max("lsn")).first()[0] or 0

    def encode(batches):
        for pdf in batches:
            raw = [captures.encode_message("RECORD", record=formats.Record(r.lsn, r.created_at_ms, r.rec_type, 0, r.key.encode(), (r.value or "").encode(), r.expire_at_ms)) for r in pdf.itertuples()]
            yield pd.DataFrame({"stream": "p" + (pdf["lsn"] % 4).astype(str), "lsn": pdf["lsn"], "data": raw})

    messages = log.select("lsn", "created_at_ms", "rec_type", "key", "value", "expire_at_ms").mapInPandas(encode, "stream string, lsn long, data binary")
    # A capture is cut into pieces of some thousand messages, so no row holds a whole stream.
    pieces = messages.groupBy("stream", F.floor(F.col("lsn") / 8000).alias("piece")).agg(F.array_sort(F.collect_list(F.struct("lsn", "data"))).alias("m"))
    data = pieces.select("stream", F.aggregate("m", F.lit(b""), lambda a, x: F.concat(a, x["data"])).alias("data"))
    beats = spark.range(4).select(F.concat(F.lit("p"), "id").alias("stream"), F.lit(captures.encode_message("HEARTBEAT", end, 3)).alias("data"))
    got = captures.replication_messages(data.unionByName(beats))
    return got.select("stream", "msg_type", "lsn", "epoch", "rec_type", F.col("key").cast("string").alias("key"))


MANIFEST = "man AS (SELECT lsn, tm FROM log WHERE lsn % 500 = 0)"


@query(sql.log("SELECT lsn, row_number() OVER (ORDER BY lsn DESC) <= 2 AS kept FROM man", MANIFEST))
def snapshot_prune(spark, d):
    return wal.newest(_log(spark, d).where("lsn % 500 = 0").select("lsn"), 2)


@query(sql.log("SELECT tm // 3600000 AS hour, count(*) AS changes, count(*) >= 5 AS due FROM log GROUP BY 1"))
def snapshot_due(spark, d):
    # A snapshot is due in an interval with at least five changes.
    by_hour = _log(spark, d).groupBy(F.floor(F.col("created_at_ms") / src.HOUR).alias("hour")).agg(F.count("*").alias("changes"))
    return by_hour.withColumn("due", F.col("changes") >= 5)


# Deadlines.


@query(sql.log(
    f"""SELECT t.lsn, t.key, CASE WHEN k.key IS NULL THEN 'stale' WHEN t.expire_at <= {sql.NOW} THEN 'expired' ELSE 'pending' END AS verdict
FROM (SELECT lsn, key, expire_at FROM log WHERE expire_at <> 0) t LEFT JOIN kv k ON t.key = k.key AND t.expire_at = k.expire_at""", sql.fold()))  # fmt: skip
def ttl_timer_validate(spark, d):
    log = _log(spark, d)
    timers = log.where("expire_at_ms <> 0").select("lsn", "key", "expire_at_ms")
    state = replay.keyspace(log).select("key", "expire_at_ms", F.lit(True).alias("match"))
    verdict = F.when(F.col("match").isNull(), "stale").when(F.col("expire_at_ms") <= F.col("now"), "expired").otherwise("pending")
    return replay.at_end(timers.join(state, ["key", "expire_at_ms"], "left"), log).select("lsn", "key", verdict.alias("verdict"))


@query(sql.log("""SELECT lsn, level, ((target >> (8 * level)) & 255)::INT AS slot FROM (SELECT *, CASE WHEN delta < 256 THEN 0 WHEN delta < 65536 THEN 1
  WHEN delta < 16777216 THEN 2 WHEN delta < 4294967296 THEN 3 WHEN delta < 1099511627776 THEN 4 ELSE 5 END AS level FROM (
  SELECT lsn, (expire_at - 1704067200000) // 10 AS target, (expire_at - 1704067200000) // 10 - (tm - 1704067200000) // 10 AS delta FROM log WHERE expire_at <> 0))"""))  # fmt: skip
def ttl_wheel_slot(spark, d):
    log, epoch = _log(spark, d).where("expire_at_ms <> 0"), 1_704_067_200_000
    target, now = fn.wheel_tick(F.col("expire_at_ms"), epoch, 10), fn.wheel_tick(F.col("created_at_ms"), epoch, 10)
    rows = log.select("lsn", target.alias("target"), fn.wheel_level(target - now).alias("level"))
    slot = F.coalesce(*[F.when(F.col("level") == i, fn.wheel_slot(F.col("target"), i)) for i in range(6)])
    return rows.select("lsn", "level", slot.alias("slot"))


@query(sql.log(f"SELECT key, 'DEL' AS rec_type, expire_at AS about_deadline FROM kv WHERE expire_at <> 0 AND expire_at <= {sql.NOW}", sql.fold()))
def ttl_delete_stream(spark, d):
    return replication.deletes_of_expired(replay.keyspace(_log(spark, d)), _now(spark, d))


# Memory and eviction, over the keyspace of orders.


@query(sql.orders("SELECT sum(cost)::BIGINT AS bytes, count(*) AS keys FROM kv"))
def memory_bytes(spark, d):
    return memory.with_cost(src.order_keyspace(spark, d)).agg(F.sum("size_bytes").alias("bytes"), F.count("*").alias("keys"))


@query(sql.orders("SELECT count(*) AS keys, count(*) FILTER (expire_at <> 0) AS keys_with_ttl, sum(cost)::BIGINT AS bytes FROM kv"))
def store_stats(spark, d):
    rows = memory.with_cost(src.order_keyspace(spark, d))
    return rows.agg(F.count("*").alias("keys"), F.count_if(F.col("expire_at_ms") != 0).alias("keys_with_ttl"), F.sum("size_bytes").alias("bytes"))


HASHED = sql.xxhash("kv", "hx", "key", len("order:000000000"))


@query(sql.orders("SELECT (h % 16)::INT AS shard, count(*) AS keys, sum(cost)::BIGINT AS bytes FROM hx GROUP BY 1", HASHED))
def shard_breakdown(spark, d):
    rows = memory.with_cost(src.order_keyspace(spark, d)).groupBy(memory.shard_of(F.col("key"), SHARDS).alias("shard"))
    return rows.agg(F.count("*").alias("keys"), F.sum("size_bytes").alias("bytes"))


@query(sql.orders("""SELECT sum(b)::BIGINT AS bytes, sum(k)::BIGINT AS keys, count(*) AS shards, min(k) AS fewest, max(k) AS most, max(b) * 16 / sum(b) AS skew
  FROM (SELECT h % 16 AS s, count(*) AS k, sum(cost)::BIGINT AS b FROM hx GROUP BY 1)""", HASHED))  # fmt: skip
def shard_skew(spark, d):
    rows = memory.with_cost(src.order_keyspace(spark, d)).groupBy(memory.shard_of(F.col("key"), SHARDS).alias("shard"))
    each = rows.agg(F.count("*").alias("k"), F.sum("size_bytes").alias("b"))
    return each.agg(
        F.sum("b").alias("bytes"), F.sum("k").alias("keys"), F.count("*").alias("shards"), F.min("k").alias("fewest"), F.max("k").alias("most"),
        (F.max("b") * SHARDS / F.sum("b")).alias("skew"),
    )


@query(sql.orders("SELECT sum(o)::BIGINT AS keys, sum(o * o) * 256 / sum(o) - sum(o) AS chi2, sum(o * o) * 256 / sum(o) - sum(o) <= 331 AS uniform FROM (SELECT count(*) AS o FROM hx GROUP BY h % 256)", HASHED))
def shard_chi2(spark, d):
    each = src.order_keyspace(spark, d).groupBy(memory.shard_of(F.col("key"), 256).alias("shard")).agg(F.count("*").alias("o"))
    total = each.agg(F.sum("o").alias("n"), F.sum(F.col("o") * F.col("o")).alias("sq"))
    chi2 = F.col("sq") * 256 / F.col("n") - F.col("n")
    return total.select(F.col("n").alias("keys"), chi2.alias("chi2"), (chi2 <= 331).alias("uniform"))


EVICT = """ev AS (SELECT key, can, sum(cost) OVER () AS total, coalesce(sum(cost) OVER (PARTITION BY can ORDER BY access, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed
  FROM (SELECT *, {can} AS can FROM kv))"""


def _evict(spark, d, **how) -> DataFrame:
    return memory.evict_exact_store(src.order_keyspace(spark, d), 200_000, **how).select("key", "victim")


@query(sql.orders("SELECT key, can AND total - freed > 200000 AS victim FROM ev", EVICT.format(can="TRUE")))
def evict_to_limit(spark, d):
    return _evict(spark, d)


@query(sql.orders("SELECT key, can AND total - freed > 200000 AS victim FROM ev", EVICT.format(can="expire_at <> 0")))
def evict_volatile(spark, d):
    return _evict(spark, d, volatile=True)


@query(sql.orders("""SELECT key, can AND total - freed > 2000 AS victim FROM (SELECT key, can, sum(cost) OVER (PARTITION BY c) AS total,
  coalesce(sum(cost) OVER (PARTITION BY c, can ORDER BY access, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed
  FROM (SELECT *, o_custkey % 64 AS c, key <> 'order:000000007' AS can FROM kv))"""))  # fmt: skip
def evict_exact_lru(spark, d):
    # Partitions by customer stand in for shards, which SQL can't hash.
    custs = src.table(spark, d, "orders").select(F.format_string("order:%09d", "o_orderkey").alias("key"), (F.col("o_custkey") % 64).alias("c"))
    rows = src.order_keyspace(spark, d).join(custs, "key")
    return memory.evict_exact(rows, 2_000, ["c"], protect="order:000000007").select("key", "victim")


TO_MARK = """m AS (SELECT *, h % 16 AS s, {can} AS can FROM hx),
mark AS (SELECT *, sum(cost) OVER (PARTITION BY s) AS total, row_number() OVER w AS r, coalesce(sum(cost) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed
  FROM m WINDOW w AS (PARTITION BY s, can ORDER BY access, key))"""
GOES = "SELECT key, can AND total > 150000 AND total - freed > 142500 AND r <= 200 AS victim FROM mark"


@query(sql.orders(GOES, HASHED, TO_MARK.format(can="TRUE")))
def evict_to_mark(spark, d):
    # Each shard to its low-water mark, at most 200 victims.
    rows = src.order_keyspace(spark, d).withColumn("shard", memory.shard_of(F.col("key"), SHARDS))
    return memory.evict_to_mark(rows, 150_000, ["shard"]).select("key", "victim")


@query(sql.orders(GOES, HASHED, TO_MARK.format(can="expire_at <> 0")))
def evict_to_mark_volatile(spark, d):
    rows = src.order_keyspace(spark, d).withColumn("shard", memory.shard_of(F.col("key"), SHARDS))
    return memory.evict_to_mark(rows, 150_000, ["shard"], volatile=True).select("key", "victim")


@query()
def evict_sampled_lru(spark, d):
    return memory.evict_sampled(src.order_keyspace(spark, d), SHARDS, 1_600_000)


@query("WITH RECURSIVE " + sql.orders("", """o AS (SELECT key, o_custkey % 64 AS part, cost, row_number() OVER (PARTITION BY o_custkey % 64 ORDER BY key) AS i FROM kv),
r AS (SELECT part, i, key, cost <= 2000 AS admitted, CASE WHEN cost <= 2000 THEN cost ELSE 0 END AS used FROM o WHERE i = 1
  UNION ALL SELECT o.part, o.i, o.key, used + cost <= 2000, used + CASE WHEN used + cost <= 2000 THEN cost ELSE 0 END FROM r JOIN o ON o.part = r.part AND o.i = r.i + 1)
SELECT key, admitted FROM r""").removeprefix("WITH "))  # fmt: skip
def admit_noeviction(spark, d):
    # Costs differ, so a later insert may fit after one that was refused. Partitions by customer stand in for shards.
    custs = src.table(spark, d, "orders").select(F.format_string("order:%09d", "o_orderkey").alias("key"), (F.col("o_custkey") % 64).alias("part"))
    return memory.admit_noeviction(src.order_keyspace(spark, d).join(custs, "key"), 2_000, "part", "key")


@query()
def replay_with_limit(spark, d):
    return memory.replay_with_limit(_log(spark, d), 16_000, 4)


@query(sql.orders("""SELECT c, CASE WHEN logical <= 0 OR held <= 0 THEN 0.0::DOUBLE ELSE held / logical END AS ratio FROM (
  SELECT (o_custkey % 8)::INT AS c, sum(cost)::DOUBLE AS held, coalesce(sum(cost - 160) FILTER (o_custkey % 8 < 6), 0)::DOUBLE AS logical FROM kv GROUP BY 1)"""))  # fmt: skip
def safe_ratio(spark, d):
    # Accounted bytes to bytes of keys and values; groups without any of those have ratio 0.
    custs = src.table(spark, d, "orders").select(F.format_string("order:%09d", "o_orderkey").alias("key"), (F.col("o_custkey") % 8).cast("int").alias("c"))
    rows = memory.with_cost(src.order_keyspace(spark, d)).join(custs, "key")
    logical = F.sum(F.when(F.col("c") < 6, F.col("size_bytes") - memory.ENTRY_OVERHEAD).otherwise(0))
    return rows.groupBy("c").agg(memory.safe_ratio(F.sum("size_bytes"), logical).alias("ratio"))


@query("WITH " + sql.COMMANDS + " SELECT 100.0::DOUBLE * count(*) FILTER (live) / greatest(count(*), 1) AS hit_rate FROM r WHERE op IN ('GET', 'TTL')")
def hit_rate(spark, d):
    reads = commands.results(src.command_log(spark, d)).where(F.col("op").isin("GET", "TTL"))
    return reads.agg((F.lit(100.0) * F.count_if(F.col("status") == "OK") / F.greatest(F.count("*"), F.lit(1))).alias("hit_rate"))


@query("WITH " + sql.COMMANDS + ",\n" + sql.orders("", sql.xxhash("kv", "hx", "key", 15)).removeprefix("WITH ") + """,
s AS (SELECT h % 16 AS s, count(*) AS k, sum(cost)::BIGINT AS b FROM hx GROUP BY 1)
SELECT 16::BIGINT AS shards, (SELECT count(*) FROM kv) AS keys, (SELECT count(*) FROM kv WHERE expire_at <> 0) AS keys_with_ttl,
  (SELECT sum(cost)::BIGINT FROM kv) AS logical_bytes, (SELECT string_agg(k, ',' ORDER BY s) FROM s) AS shard_keys, (SELECT string_agg(b, ',' ORDER BY s) FROM s) AS shard_bytes,
  (SELECT count(*) FROM r WHERE op = 'GET' AND live) AS hits, (SELECT count(*) FROM r WHERE op = 'GET' AND NOT live) AS misses""")  # fmt: skip
def stats_json(spark, d):
    # The document is written and read again; the rows are what it holds.
    doc = memory.stats_document(src.order_keyspace(spark, d), commands.results(src.command_log(spark, d)), SHARDS)
    kind = "shards long, keys long, keys_with_ttl long, logical_bytes long, shard_keys array<long>, shard_bytes array<long>, hits long, misses long"
    one = doc.select(F.from_json("stats", f"store struct<{kind.replace(' ', ':').replace(',:', ',')}>")["store"].alias("s")).select("s.*")
    flat = {c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",") for c in ("shard_keys", "shard_bytes")}
    return one.withColumns(flat)


@query("SELECT (props::JSON->>'k')::BIGINT AS k, count(*) AS n FROM events GROUP BY 1")
def stats_parse(spark, d):
    parsed = src.table(spark, d, "events").select(F.from_json("props", "k long")["k"].alias("k"))
    return parsed.groupBy("k").agg(F.count("*").alias("n"))


# Histograms and runs.


@query(sql.latency("SELECT bucket, count, low AS low_ns FROM v"))
def latency_hist(spark, d):
    h = histogram.build(src.latencies(spark, d))
    return h.select("bucket", "count", histogram.lower_bound(F.col("bucket")).alias("low_ns"))


@query(sql.latency("SELECT bucket, count FROM h"))
def latency_hist_merge(spark, d):
    return histogram.merge(histogram.build(src.latencies(spark, d), ["worker"]))


@query(sql.latency("""SELECT q::DOUBLE AS q, min(low) AS ns FROM (SELECT *, sum(count) OVER (ORDER BY bucket) AS upto, sum(count) OVER () AS n FROM v),
  (VALUES (0.5), (0.9), (0.99), (0.999)) t(q) WHERE upto >= greatest(1, ceil(q::DOUBLE * n)) GROUP BY q"""))  # fmt: skip
def latency_quantiles(spark, d):
    return histogram.quantiles(histogram.build(src.latencies(spark, d)), QS)


@query(sql.latency("SELECT count(*) AS n, min(ns) AS min_ns, max(ns) AS max_ns, (sum(ns) // count(*))::BIGINT AS mean_ns FROM lat"))
def latency_summary(spark, d):
    return histogram.summary(src.latencies(spark, d))


@query(sql.latency("""SELECT a.min, min(low) FILTER (upto >= ceil(0.5 * v.n)) AS p50, min(low) FILTER (upto >= ceil(0.9 * v.n)) AS p90, min(low) FILTER (upto >= ceil(0.99 * v.n)) AS p99,
  min(low) FILTER (upto >= ceil(0.999 * v.n)) AS p999, a.max, a.mean FROM (SELECT *, sum(count) OVER (ORDER BY bucket) AS upto, sum(count) OVER () AS n FROM v) v,
  (SELECT min(ns) AS min, max(ns) AS max, (sum(ns) // count(*))::BIGINT AS mean FROM lat) a GROUP BY ALL"""))  # fmt: skip
def latency_percentile_map(spark, d):
    m = histogram.percentiles(src.latencies(spark, d))
    return m.select(*[F.col("p")[k].alias(k.replace(".", "")) for k in histogram.PERCENTILES])


RUNS = "runs AS (SELECT worker AS run, count(*)::DOUBLE / (sum(ns) / 1000000000.0) AS ops FROM lat GROUP BY 1)"


def _runs(spark, d) -> DataFrame:
    return src.latencies(spark, d).groupBy(F.col("worker").alias("run")).agg((F.count("*") / (F.sum("ns") / 1e9)).alias("ops"))


@query(sql.latency("SELECT run::INT AS run, ops FROM runs", RUNS))
def throughput(spark, d):
    return _runs(spark, d)


@query(sql.latency("SELECT ops FROM (SELECT *, row_number() OVER (ORDER BY ops, run) AS i, count(*) OVER () AS n FROM runs) WHERE i = n // 2 + 1", RUNS))
def run_median(spark, d):
    everything = Window.partitionBy(F.lit(0))
    rows = _runs(spark, d).withColumn("i", F.row_number().over(everything.orderBy("ops", "run"))).withColumn("n", F.count("*").over(everything))
    return rows.where(F.col("i") == F.floor(F.col("n") / 2) + 1).select("ops")


@query(sql.latency("SELECT min(ops) AS low, max(ops) AS high FROM runs", RUNS))
def run_spread(spark, d):
    return _runs(spark, d).agg(F.min("ops").alias("low"), F.max("ops").alias("high"))


def _us(ns: str) -> str:
    """DuckDB SQL for nanoseconds as microseconds with two places, ties up."""
    return f"((({ns} + 5) // 10) // 100 || '.' || lpad(((({ns} + 5) // 10) % 100)::VARCHAR, 2, '0'))"


def _half_up_rate(n: str, ns: str) -> str:
    """DuckDB SQL for n a second of ns, with one place, ties up, in whole numbers."""
    tenths = f"((2 * {n}::HUGEINT * 10000000000 + {ns}) // (2 * {ns}::HUGEINT))"
    return f"({tenths} // 10 || '.' || ({tenths} % 10))"


@query(sql.latency(f"""SELECT 0 AS ord, '{",".join(histogram.CSV_COLUMNS)}' AS line UNION ALL
SELECT 1 + worker::INT, 'run' || worker || ',2024-01-01T00:00:00Z,closed,95/5,uniform,16,1,64,100000,0,' || ops || ',0,' || {_half_up_rate("ops", "total")} || ',' ||
  {" || ',' || ".join(_us(c) for c in ("lo", "p50", "p90", "p99", "p999", "hi", "mean"))} || ',0,linux,amd64,8' FROM (
  SELECT worker, count(*) AS ops, sum(ns)::BIGINT AS total, min(ns) AS lo, max(ns) AS hi, (sum(ns) // count(*))::BIGINT AS mean, {", ".join(f"min(low) FILTER (upto >= greatest(1, ceil({q}::DOUBLE * n))) AS p{str(q)[2:].ljust(2, '0')}" for q in (0.5, 0.9, 0.99, 0.999))}
  FROM (SELECT b.*, CASE WHEN bucket < 64 THEN bucket ELSE (bucket % 64 + 64)::BIGINT << (bucket // 64 - 1) END::BIGINT AS low,
    count(*) OVER (PARTITION BY worker ORDER BY bucket) AS upto, count(*) OVER (PARTITION BY worker) AS n FROM b) GROUP BY worker)"""))  # fmt: skip
def bench_csv(spark, d):
    run = {"timestamp": "2024-01-01T00:00:00Z", "mode": "closed", "workload": "95/5", "distribution": "uniform", "conns": 16, "pipeline": 1, "value_size": 64, "keyspace": 100_000, "client_os": "linux", "client_arch": "amd64", "client_cpus": 8}
    rows = histogram.csv_rows(src.latencies(spark, d), F.concat(F.lit("run"), "worker"), run, ["worker"])
    return histogram.csv_header(spark).unionByName(rows.select((F.col("worker") + 1).alias("ord"), "line"))


OPEN = """o AS (SELECT event_id AS seq, (epoch_us(ts) // 1000) AS done, (SELECT min((epoch_us(ts) // 1000)) FROM events) + event_id * 60000 AS due FROM events)"""


@query(f"WITH {OPEN} SELECT seq, greatest(0, done - due) AS latency_ms, due - done < -60000 AS omitted FROM o")
def open_loop_latency(spark, d):
    # Latency counts from when a request was due, so a stalled sender can't hide it.
    e = src.table(spark, d, "events").select(F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("done"))
    e = e.crossJoin(F.broadcast(e.agg(F.min("done").alias("begin")))).withColumn("due", F.col("begin") + F.col("seq") * 60_000)
    late = F.col("done") - F.col("due")
    return e.select("seq", F.greatest(F.lit(0).cast("long"), late).alias("latency_ms"), (-late < -60_000).alias("omitted"))


# Comparison and replication.

ACKED = "acked AS (SELECT key, arg_max(value, lsn) AS value FROM log WHERE rec_type = 'SET' GROUP BY key)"


def _acked(spark, d) -> DataFrame:
    return _log(spark, d).where("rec_type = 'SET'").groupBy("key").agg(F.max_by("value", "lsn").alias("value"))


@query(sql.live("SELECT key, value FROM acked ANTI JOIN live USING (key)", ACKED))
def audit_missing(spark, d):
    return replication.missing_writes(_acked(spark, d), _live(spark, d))


@query(sql.log("SELECT a.key, a.value AS expected, h.value AS actual FROM acked a JOIN livehalf h ON a.key = h.key WHERE a.value IS DISTINCT FROM h.value", ACKED, HALF, sql.fold("half", "h"), LIVE_HALF))
def audit_wrong(spark, d):
    return replication.wrong_writes(_acked(spark, d), replay.live_at_end(_half(spark, d)))


BOTH = (HALF, sql.fold("half", "h"), LIVE_HALF)


@query(sql.live("""SELECT coalesce(l.key, h.key) AS key, CASE WHEN h.key IS NULL THEN 'left only' WHEN l.key IS NULL THEN 'right only' ELSE 'different' END AS verdict
FROM live l FULL JOIN livehalf h ON l.key = h.key WHERE l.key IS NULL OR h.key IS NULL OR l.value IS DISTINCT FROM h.value""", *BOTH))  # fmt: skip
def state_diff(spark, d):
    return replication.compare_states(_live(spark, d), replay.live_at_end(_half(spark, d)))


@query(sql.live("SELECT key FROM live EXCEPT SELECT key FROM livehalf", *BOTH))
def state_only_left(spark, d):
    return _live(spark, d).select("key").subtract(replay.live_at_end(_half(spark, d)).select("key"))


@query(sql.live("SELECT key FROM live INTERSECT SELECT key FROM livehalf", *BOTH))
def state_common(spark, d):
    return _live(spark, d).select("key").intersect(replay.live_at_end(_half(spark, d)).select("key"))


@query(sql.log("SELECT lsn, key FROM log WHERE lsn > 300"))
def repl_catchup(spark, d):
    log = _log(spark, d)
    return replication.catch_up(log.where("lsn <= 800"), log.where("lsn >= 500"), 300).select("lsn", "key")


@query(sql.live("""SELECT 'RECORD' AS msg_type, (SELECT max(lsn) FROM log) AS lsn, key, value FROM live
UNION ALL SELECT 'FULL_BEGIN', (SELECT max(lsn) FROM log), NULL, NULL UNION ALL SELECT 'FULL_END', (SELECT max(lsn) FROM log), NULL, NULL"""))  # fmt: skip
def repl_full_resync(spark, d):
    log = _log(spark, d)
    end = F.broadcast(log.agg(F.max("lsn").alias("end")))
    body = replication.full_resync(_live(spark, d), F.lit(0).cast("long")).drop("lsn", "ord")
    return body.crossJoin(end).select("msg_type", F.col("end").alias("lsn"), "key", "value")


@query("SELECT c_custkey AS position, CASE WHEN c_custkey = 0 OR c_custkey + 1 < 100 THEN 'full' ELSE 'partial' END AS kind FROM customer")
def repl_decide(spark, d):
    p = src.table(spark, d, "customer").select(F.col("c_custkey").alias("position"))
    return p.withColumn("kind", replication.resync_kind(F.col("position"), F.lit(100)))


@query("""SELECT event_id AS lsn, user_id % 8 AS stream, epoch, epoch >= max(epoch) OVER (PARTITION BY user_id % 8 ORDER BY event_id) AS accepted
FROM (SELECT *, event_id // 1000 - CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END AS epoch FROM events)""")  # fmt: skip
def epoch_fence(spark, d):
    e = src.table(spark, d, "events")
    epoch = F.floor(F.col("event_id") / 1000) - F.when(F.col("event_id") % 13 == 0, 1).otherwise(0)
    return replication.fence(e.select(F.col("event_id").alias("lsn"), (F.col("user_id") % 8).alias("stream"), epoch.alias("epoch")))


@query(sql.log(f"""SELECT addr, acked_lsn, silent_ms, CASE WHEN silent_ms > 7200000 THEN 'dead' WHEN silent_ms > 3600000 THEN 'suspect' ELSE 'alive' END AS state
FROM (SELECT key AS addr, max(lsn) AS acked_lsn, {sql.NOW} - max(tm) AS silent_ms FROM log GROUP BY key)"""))  # fmt: skip
def peer_state(spark, d):
    log = _log(spark, d)
    acks = log.select(F.col("key").alias("addr"), "lsn", F.col("created_at_ms").alias("at_ms"))
    return replication.peer_state(acks, replay.log_end(log), src.HOUR)


@query(sql.log("SELECT key AS addr, max(lsn) AS applied_lsn, (SELECT max(lsn) FROM log) - max(lsn) AS lag FROM log GROUP BY key"))
def repl_lag(spark, d):
    log = _log(spark, d)
    return replication.lag(log.groupBy(F.col("key").alias("addr")).agg(F.max("lsn").alias("applied_lsn")), log)


# Streams: the same rows as the batch form.


def _stream(spark, d) -> DataFrame:
    schema = src.table(spark, d, "events").schema
    e = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    kind, at = F.col("event_type"), F.unix_millis(F.col("ts").cast("timestamp"))
    rec = F.when(kind == "error", "DEL").when(kind == "signup", "EXPIRE").otherwise("SET")
    deadline = F.when(kind == "click", at + 6 * src.HOUR).when(kind == "signup", at + 12 * src.HOUR).otherwise(F.lit(0))
    return e.select(
        (F.col("event_id") + 1).alias("lsn"), at.alias("created_at_ms"), rec.alias("rec_type"), F.format_string("user:%06d", "user_id").alias("key"),
        F.when(rec == "SET", F.col("props")).alias("value"), deadline.cast("long").alias("expire_at_ms"),
    )


@query(sql.live("SELECT key, value, expire_at AS expire_at_ms, last_lsn FROM live"))
def stream_replay(spark, d):
    from ..streaming.replay_stream import run_fold

    state = run_fold(spark, _stream(spark, d), "fold").where("alive")
    return replay.at_end(state, _log(spark, d)).where(~replay.expired(F.col("now"))).select("key", "value", "expire_at_ms", "last_lsn")


@query(sql.log("SELECT lsn, key, rec_type FROM log"))
def stream_tail(spark, d):
    from ..streaming.replay_stream import drain

    return drain(spark, _stream(spark, d).select("lsn", "key", "rec_type"), "tail")


@query(sql.log("SELECT 'RECORD' AS msg_type, lsn, 1::BIGINT AS epoch, key FROM log WHERE lsn > 100"))
def stream_publish(spark, d):
    from ..streaming.replay_stream import drain

    messages = _stream(spark, d).where("lsn > 100").select(F.lit("RECORD").alias("msg_type"), "lsn", F.lit(1).cast("long").alias("epoch"), "key")
    return drain(spark, messages, "publish")


# Scalars.


@query(sql.log("SELECT lsn, CASE WHEN ttl = 0 THEN 0 ELSE tm + least(ttl, 1125899906842624) END AS deadline FROM (SELECT lsn, tm, CASE lsn % 3 WHEN 0 THEN 0 WHEN 1 THEN 5000 ELSE 2251799813685248 END AS ttl FROM log)"))
def fn_deadline(spark, d):
    ttl = F.when(F.col("lsn") % 3 == 0, 0).when(F.col("lsn") % 3 == 1, 5000).otherwise(F.lit(1 << 51))
    return _log(spark, d).select("lsn", commands.deadline(F.col("created_at_ms"), ttl).alias("deadline"))


@query(sql.orders("SELECT key, (h % 16)::INT AS shard, CASE WHEN h >= 9223372036854775808::UHUGEINT THEN h::HUGEINT - 18446744073709551616 ELSE h::HUGEINT END::BIGINT AS hash FROM hx", HASHED))
def fn_shard(spark, d):
    return src.order_keyspace(spark, d).select("key", memory.shard_of(F.col("key"), SHARDS).alias("shard"), F.xxhash64("key").alias("hash"))


# xxHash64 of the number 9 in four bytes with seed 42, which a seeded shard hashes the key with.
_SEEDED = 15594711463369240873


@query(sql.orders("SELECT key, (h % 16)::INT AS shard FROM hx", sql.xxhash("kv", "hx", "key", 15, seed=_SEEDED)))
def fn_shard_seeded(spark, d):
    return src.order_keyspace(spark, d).select("key", memory.shard_of(F.col("key"), SHARDS, seed=9).alias("shard"))


SIZES = "SELECT o_orderkey AS k, (o_orderkey * o_orderkey * 7919 * (1 + o_orderkey % 5))::BIGINT AS n FROM orders"


_EVEN = "printf('%.2f', n / {0}.0) || '{1}'"


@query(f"""SELECT k, CASE WHEN n >= 1099511627776 THEN {_EVEN.format(1 << 40, "TiB")} WHEN n >= 1073741824 THEN {_EVEN.format(1 << 30, "GiB")}
  WHEN n >= 1048576 THEN {_EVEN.format(1 << 20, "MiB")} WHEN n >= 1024 THEN {_EVEN.format(1 << 10, "KiB")} ELSE n || 'B' END AS s FROM ({SIZES})""")  # fmt: skip
def fn_format_bytes(spark, d):
    k = F.col("o_orderkey")
    return src.table(spark, d, "orders").select(k.alias("k"), fn.format_bytes(k * k * 7919 * (1 + k % 5)).alias("s"))


WORDS = ["0", "512", "1KB", "1kib", "64MB", "16MiB", "2gb", "1.5MB", " 8 mb ", "", "MB", "12xb", "abc"]


@query("SELECT * FROM (VALUES ('0', 0::BIGINT), ('512', 512), ('1KB', 1024), ('1kib', 1024), ('64MB', 67108864), ('16MiB', 16777216), ('2gb', 2147483648), ('1.5MB', 1572864), (' 8 mb ', 8388608), ('', NULL), ('MB', NULL), ('12xb', NULL), ('abc', NULL)) t(s, n)")
def fn_parse_bytes(spark, d):
    rows = spark.range(1).select(F.explode(F.array(*map(F.lit, WORDS))).alias("s"))
    return rows.select("s", fn.parse_bytes(F.col("s")).alias("n"))


@query("SELECT doc_id, CASE WHEN length(t) >= 40 THEN left(t, 37) || '...' ELSE t END AS p FROM (SELECT doc_id, left(text, 60) AS t FROM documents WHERE regexp_full_match(left(text, 60), '[ -~]*'))")
def fn_printable(spark, d):
    docs = src.table(spark, d, "documents").select("doc_id", F.substring("text", 1, 60).alias("t")).where(F.col("t").rlike(r"^[ -~]*\z"))
    return docs.select("doc_id", fn.printable(F.col("t").cast("binary"), 40).alias("p"))


@query("""SELECT doc_id, CASE WHEN length(t) >= 40 THEN left(t, 37) || '...' ELSE t END AS p FROM (
  SELECT doc_id, array_to_string(list_transform(range(1, length(h), 2), lambda i: CASE WHEN substr(h, i, 2) BETWEEN '20' AND '7E'
    THEN chr(('0x' || substr(h, i, 2))::INTEGER) ELSE '\\x' || CASE WHEN substr(h, i, 1) = '0' THEN lower(substr(h, i + 1, 1)) ELSE lower(substr(h, i, 2)) END END), '') AS t
  FROM (SELECT doc_id, hex(encode(left(text, 40))) AS h FROM documents))""")  # fmt: skip
def fn_printable_all(spark, d):
    return src.table(spark, d, "documents").select("doc_id", fn.printable(F.col("text").cast("binary"), 40).alias("p"))


@query(sql.log("SELECT lsn, CASE WHEN expire_at = 0 THEN '-' ELSE strftime(make_timestamp(expire_at * 1000), '%Y-%m-%dT%H:%M:%S.%g') END AS t FROM log"))
def fn_ms_time(spark, d):
    return _log(spark, d).select("lsn", fn.ms_time(F.col("expire_at_ms")).alias("t"))


def _half_up(unit: int, places: int) -> str:
    """DuckDB SQL for n / unit with so many places, ties up, in whole numbers."""
    c = f"((n * {10**places} + {unit // 2}) // {unit})"
    return f"{c} // {10**places} || '.' || lpad(({c} % {10**places})::VARCHAR, {places}, '0')"


@query(sql.latency(f"""SELECT event_id, CASE WHEN n < 1000 THEN n || 'ns' WHEN n < 1000000 THEN {_half_up(10**3, 1)} || 'us'
  WHEN n < 1000000000 THEN {_half_up(10**6, 2)} || 'ms' ELSE {_half_up(10**9, 2)} || 's' END AS s
  FROM (SELECT event_id, ns * CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 7 ELSE 113 END AS n FROM lat)"""))  # fmt: skip
def fn_fmt_dur(spark, d):
    e = src.table(spark, d, "events")
    ns = F.round(F.col("value") * 1_000_000).cast("long") * F.when(F.col("event_id") % 4 == 0, 1).when(F.col("event_id") % 4 == 1, 7).otherwise(113)
    return e.select("event_id", fn.format_duration(ns).alias("s"))


_FMT = f"""CASE WHEN n < 1000 THEN n || 'ns' WHEN n < 1000000 THEN {_half_up(10**3, 1)} || 'us' WHEN n < 1000000000 THEN {_half_up(10**6, 2)} || 'ms' ELSE {_half_up(10**9, 2)} || 's' END"""


@query(sql.latency(f"""SELECT ord, '  ' || lpad({_FMT}, 10, ' ') || ' |' || CASE WHEN w < 40 THEN rpad(repeat('#', w), 40, ' ') ELSE repeat('#', w) END || ' ' || c AS line FROM (
  SELECT i // step AS ord, min(low) AS n, sum(count)::BIGINT AS c, floor(sum(count)::DOUBLE / any_value(peak) * 40)::INT AS w FROM (
    SELECT *, CASE WHEN total > 20 THEN total // 20 ELSE 1 END AS step FROM (
      SELECT *, row_number() OVER (ORDER BY bucket) - 1 AS i, count(*) OVER () AS total, max(count) OVER () AS peak FROM v)) GROUP BY 1)"""))  # fmt: skip
def latency_bars(spark, d):
    return histogram.bars(histogram.build(src.latencies(spark, d)), 40)


@query(sql.log("SELECT lsn, lpad(lsn::VARCHAR, 16, '0') || '.log' AS name FROM log"))
def fn_segment_name(spark, d):
    return _log(spark, d).select("lsn", fn.segment_name(F.col("lsn")).alias("name"))


@query(sql.log("SELECT name, CASE WHEN regexp_full_match(name, '[0-9]{16}\\.log') THEN substr(name, 1, 16)::BIGINT END AS lsn FROM (SELECT CASE WHEN lsn % 5 = 0 THEN lsn || '.log' ELSE lpad(lsn::VARCHAR, 16, '0') || '.log' END AS name FROM log)"))
def fn_parse_segment(spark, d):
    name = F.when(F.col("lsn") % 5 == 0, F.concat(F.col("lsn").cast("string"), F.lit(".log"))).otherwise(fn.segment_name(F.col("lsn")))
    return _log(spark, d).select(name.alias("name")).select("name", fn.parse_segment_name(F.col("name")).alias("lsn"))


_OPS = ", ".join(f"('{k.lower()}', {v}, '{k}', FALSE)" for k, v in fn.OPCODES.items())


@query(f"SELECT * FROM (VALUES {_OPS}, ('nope', NULL, 'UNKNOWN', NULL)) t(name, code, back, fatal)")
def fn_opcode(spark, d):
    rows = spark.range(1).select(F.explode(F.array(*[F.lit(k.lower()) for k in fn.OPCODES], F.lit("nope"))).alias("name"))
    rows = rows.withColumn("code", fn.opcode(F.col("name")))
    return rows.select("name", "code", fn.opcode_name(F.col("code")).alias("back"), fn.fatal_status(F.col("code")).alias("fatal"))


_STATUS = ", ".join(f"('{k.lower()}', {v}, '{k}', {v >= 0x80})" for k, v in fn.STATUSES.items())


@query(f"SELECT * FROM (VALUES {_STATUS}, ('nope', NULL, 'UNKNOWN', FALSE)) t(name, code, back, fatal)")
def fn_status(spark, d):
    rows = spark.range(1).select(F.explode(F.array(*[F.lit(k.lower()) for k in fn.STATUSES], F.lit("nope"))).alias("name"))
    rows = rows.withColumn("code", fn.status(F.col("name")))
    return rows.select("name", "code", fn.status_name(F.col("code")).alias("back"), F.coalesce(fn.fatal_status(F.col("code")), F.lit(False)).alias("fatal"))


@query("SELECT o_orderkey AS n, CASE WHEN o_orderkey <= 1 THEN 1 ELSE 1::BIGINT << length(bin(o_orderkey - 1)) END::BIGINT AS p FROM orders")
def fn_next_pow2(spark, d):
    return src.table(spark, d, "orders").select(F.col("o_orderkey").alias("n"), fn.next_power_of_two(F.col("o_orderkey")).alias("p"))


@query("SELECT * FROM (VALUES ('get', 1.0::DOUBLE), ('SET', 0.0), ('95/5', 0.95), ('1/3', 0.25), ('x', NULL), ('0/0', NULL)) t(w, reads)")
def fn_workload(spark, d):
    rows = spark.range(1).select(F.explode(F.array(*map(F.lit, ["get", "SET", "95/5", "1/3", "x", "0/0"]))).alias("w"))
    return rows.select("w", fn.workload_reads(F.col("w")).alias("reads"))


# One setting in sixteen is changed for each customer; the SQL says which change is an error.
CHANGES = {
    "shards": ("12", True), "engine": ("'striped'", True), "fsync": ("'never'", True), "max_memory_policy": ("'lfu'", True), "expiry": ("'eager'", True),
    "conn_mode": ("'fiber'", True), "role": ("'witness'", True), "replicaof": ("''", False), "evict_sample_k": ("0", True), "low_water_ratio": ("1.5", True),
    "max_value_len": ("16777217", True), "segment_size": ("4095", True), "workers": ("0", True), "data_dir": ("''", True),
}
SETTINGS = {
    "shards": "16", "engine": "'sharded'", "fsync": "'everysec'", "max_memory_policy": "'allkeys-lru'", "expiry": "'wheel'", "conn_mode": "'pool'", "role": "'primary'",
    "replicaof": "''", "evict_sample_k": "5", "low_water_ratio": "0.95", "max_value_len": "1048576", "segment_size": "65536", "workers": "4", "data_dir": "'data'",
}


@query("SELECT c_custkey AS k, CASE c_custkey % 16 " + " ".join(f"WHEN {i} THEN '{n}'" for i, (n, (_, bad)) in enumerate(CHANGES.items()) if bad) + " WHEN 14 THEN 'replicaof' WHEN 15 THEN 'shards' END AS error FROM customer")
def cfg_validate(spark, d):
    from ..functions.validation import config_error

    rows = src.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 16).alias("i"))
    for i, (name, normal) in enumerate(SETTINGS.items()):
        rows = rows.withColumn(name, F.expr(f"CASE WHEN i = {i} THEN {CHANGES[name][0]} ELSE {normal} END"))
    # A replica without a primary; and of two errors the first one counts.
    rows = rows.withColumn("role", F.when(F.col("i") == 14, "replica").otherwise(F.col("role")))
    rows = rows.withColumn("shards", F.when(F.col("i") == 15, 0).otherwise(F.col("shards"))).withColumn("workers", F.when(F.col("i") == 15, 0).otherwise(F.col("workers")))
    return rows.select("k", config_error().alias("error"))


@query("SELECT * FROM (VALUES ('max-memory', 'KV_MAX_MEMORY'), ('port', 'KV_PORT')) t(flag, env)")
def fn_env_name(spark, d):
    rows = spark.range(1).select(F.explode(F.array(F.lit("max-memory"), F.lit("port"))).alias("flag"))
    return rows.select("flag", fn.env_name(F.col("flag")).alias("env"))


@query("SELECT printf('bench:key:%09d', i) AS key, repeat(chr((97 + i % 26)::INT), 8) AS value FROM range(1000) t(i)")
def gen_keys(spark, d):
    letter = F.char(F.lit(97) + F.col("id") % 26)
    return spark.range(1000).select(F.format_string("bench:key:%09d", "id").alias("key"), F.repeat(letter, F.lit(8)).alias("value"))


@query("SELECT printf('bench:key:%09d', i) AS key, repeat('abcdefghijklmnopqrstuvwxyz', 2) || 'abcdefghijkl' AS value FROM range(20000) t(i)")
def gen_preload(spark, d):
    return generate.preload(spark, 20_000, 64)


@query()
def gen_zipf(spark, d):
    return generate.operations(spark, 100_000, 10_000, 0.95, zipf_s=1.01).groupBy("key", "op").agg(F.count("*").alias("n"))
