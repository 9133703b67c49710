import random

import pytest
from pyspark.sql import functions as F

from lograil.operators import commands, replay

LOG = "lsn long, created_at_ms long, rec_type string, key string, value string, expire_at_ms long"


def model(log, now=None):
    """A sequential fold, and whether each record found its key live."""
    state, found = {}, {}
    for lsn, at, kind, key, value, expire in sorted(log):
        live = key in state and (state[key][1] == 0 or state[key][1] > at)
        found[lsn] = (live, state[key][0] if live else None)
        if not live:
            state.pop(key, None)
        if kind == "SET":
            state[key] = (value, expire)
        elif kind == "DEL":
            state.pop(key, None)
        elif kind == "EXPIRE" and live:
            state[key] = (state[key][0], expire)
    end = max((r[1] for r in log), default=0) if now is None else now
    return {k: v for k, v in state.items() if v[1] == 0 or v[1] > end}, found


def generate(seed, n=600, keys=40):
    rng, at, out = random.Random(seed), 1_000_000_000, []
    for lsn in range(1, n + 1):
        at += rng.randint(0, 59)
        kind = rng.choice(["SET", "SET", "DEL", "EXPIRE", "EXPIRE", "GET"])
        ttl = rng.choice([0, 0, 1, rng.randint(1, 200), rng.randint(1, 2000)])
        expire = 0 if kind == "DEL" or ttl == 0 else at + ttl
        out.append((lsn, at, kind, f"k{rng.randrange(keys):03d}", "x" * rng.randint(0, 39) if kind == "SET" else None, None if kind == "GET" else expire))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_fold_equals_the_model(spark, seed):
    log = generate(seed)
    want, found = model(log)
    df = spark.createDataFrame(log, LOG)
    writes = df.where("rec_type <> 'GET'")
    end = df.agg(F.max("created_at_ms")).first()[0]
    got = replay.keyspace(writes).where(~replay.expired(end)).collect()
    assert {r.key: (r.value, r.expire_at_ms) for r in got} == want
    seen = replay.before_each(df).collect()
    assert {r.lsn: (r.live_before, r.value_before) for r in seen} == found


def test_twice_the_log_is_the_same(spark):
    log = spark.createDataFrame(generate(9), LOG).where("rec_type <> 'GET'")
    once = replay.keyspace(log)
    twice = replay.keyspace(log.union(log).dropDuplicates(["lsn"]))
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_probes(spark):
    log = generate(5, n=200, keys=6)
    writes = [r for r in log if r[2] != "GET"]
    probes = [(i, f"k{i % 6:03d}", writes[i * 7 % len(writes)][0]) for i in range(40)]
    got = {r.probe: (r.found, r.value) for r in replay.as_of_probes(spark.createDataFrame(writes, LOG), spark.createDataFrame(probes, "probe long, key string, at_lsn long")).collect()}
    for probe, key, lsn in probes:
        upto = [r for r in writes if r[0] <= lsn]
        state, _ = model(upto)
        assert got[probe] == (key in state, state[key][0] if key in state else None)


def test_ttl_boundary_and_clearing(spark):
    log = spark.createDataFrame([
        (1, 0, "SET", "soon", "v", 100), (2, 0, "SET", "never", "v", 0), (3, 0, "SET", "cleared", "v", 50), (4, 10, "EXPIRE", "cleared", None, 0),
        (5, 0, "EXPIRE", "missing", None, 70), (6, 0, "SET", "late", "v", 5), (7, 6, "EXPIRE", "late", None, 0),
    ], LOG)
    state = replay.keyspace(log)
    at = lambda now: {r.key for r in state.where(~replay.expired(now)).collect()}
    assert at(99) == {"soon", "never", "cleared"} and at(100) == {"never", "cleared"}


def test_flush_and_recovery(spark):
    log = generate(3, n=300)
    writes = [r for r in log if r[2] != "GET"]
    df = spark.createDataFrame(writes, LOG)
    cut = writes[len(writes) // 2][0]
    flushed = replay.with_flushes(df.unionByName(spark.createDataFrame([(cut, 0, "FLUSH", None, None, 0)], LOG)))
    assert flushed.count() == sum(r[0] > cut for r in writes)
    snapshot = replay.as_of_lsn(df, cut)
    whole = {(r.key, r.value, r.expire_at_ms) for r in replay.live_at_end(df).collect()}
    end = max(r[1] for r in writes)
    again = replay.recover(snapshot, df, cut).where(~replay.expired(end))
    assert {(r.key, r.value, r.expire_at_ms) for r in again.collect()} == whole


def test_validation_boundaries(spark):
    rows = spark.createDataFrame([("", "v"), ("k" * 65_535, "v"), ("k" * 65_536, "v"), ("k", ""), (None, "v")], "k string, v string")
    got = [r[0] for r in rows.select(commands.validation_status(F.col("k"), F.col("v"))).collect()]
    assert got == ["BAD_REQUEST", "OK", "TOO_LARGE", "OK", "BAD_REQUEST"]


def test_empty_log(spark):
    assert replay.live_at_end(spark.createDataFrame([], LOG)).count() == 0
