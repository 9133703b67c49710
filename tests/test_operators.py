from pyspark.sql import functions as F

from lograil.functions import scalars as fn
from lograil.operators import histogram, memory, wal
from lograil.plans import registry
from lograil.sources import tables


def test_buckets(spark):
    values = [0, 63, 64, 127, 128, 129, 255, 1 << 40, (1 << 62) + 12345]
    df = spark.createDataFrame([(v,) for v in values], "ns long").select("ns", histogram.bucket(F.col("ns")).alias("b"))
    rows = df.select("ns", "b", histogram.lower_bound(F.col("b")).alias("low")).collect()
    assert [r.b for r in rows[:7]] == [0, 63, 64, 127, 128, 128, 191]
    assert [r.low for r in rows[:7]] == [0, 63, 64, 127, 128, 128, 254]
    assert all(0 <= r.ns - r.low <= r.ns / 64 for r in rows)


def test_quantiles_of_nothing(spark):
    assert histogram.quantiles(histogram.build(spark.createDataFrame([], "ns long")), [0.5]).count() == 0


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(fn.printable(F.lit(b"a\x00\xffz"), 40)) == "a\\x0\\xffz"
    assert get(fn.printable(F.lit(b"abcdefgh"), 8)) == "abcde..." and get(fn.printable(F.lit(b""), 8)) == ""
    assert get(fn.format_bytes(F.lit(1152))) == "1.12KiB" and get(fn.format_bytes(F.lit(-2048))) == "-2.00KiB"
    assert get(fn.wheel_level(F.lit(256))) == 1 and get(fn.ms_time(F.lit(0))) == "-"
    assert get(fn.next_power_of_two(F.lit(17))) == 32


def test_noeviction_and_lru(spark):
    rows = [(f"k{i:03d}", "v" * 100, 0 if i % 2 else 5, i) for i in range(100)]
    state = spark.createDataFrame(rows, "key string, value string, expire_at_ms long, last_access_ms long").withColumn("s", F.lit(0))
    cost = 264
    gone = {r.key for r in memory.evict_exact(state, cost * 90, ["s"]).where("victim").collect()}
    assert gone == {f"k{i:03d}" for i in range(10)}
    gone = {r.key for r in memory.evict_exact(state, cost * 95, ["s"], volatile=True, protect="k000").where("victim").collect()}
    assert gone == {f"k{i:03d}" for i in (2, 4, 6, 8, 10)}


def test_limited_replay_keeps_the_limit(spark):
    log = [(i, 0, "SET", f"k{i % 500}", "v" * 100, 0) for i in range(1, 3000)]
    df = spark.createDataFrame(log, "lsn long, created_at_ms long, rec_type string, key string, value string, expire_at_ms long")
    for policy in ("allkeys-lru", "volatile-lru", "noeviction"):
        out = memory.replay_with_limit(df, 40_000, 4, policy).collect()
        assert all(r.bytes <= 10_000 for r in out)
        assert (sum(r.evicted for r in out) > 0) == (policy == "allkeys-lru")


def test_sequential_shards_are_passed_in_batches(spark):
    rows = [(f"k{i * 37 % 900:03d}", "v" * (i % 60), i % 3, i * 91 % 401, "SET" if i % 7 else "DEL", i) for i in range(900)]
    log = spark.createDataFrame(rows, "key string, value string, expire_at_ms long, last_access_ms long, rec_type string, lsn long")
    state = log.drop("rec_type", "lsn")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for volatile in (False, True):
            out = memory.evict_sampled(state, 4, 120_000, volatile=volatile)
            assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()
            got, shard = sorted(tuple(r) for r in out.collect()), memory.shard_of(F.col("key"), 4).alias("shard")
            by: dict = {}
            for r in memory.with_cost(state).select(shard, "key", "size_bytes", "last_access_ms", "expire_at_ms").orderBy("key").collect():
                by.setdefault(r.shard, []).append(tuple(r)[1:])
            want = [(s, i, k) for s, e in by.items() for i, k in enumerate(memory.sampled_victims(e, 30_000, 5, 7 + s, volatile=volatile))]
            assert len(want) > 20 and got == sorted(want)
        out = memory.admit_noeviction(state.withColumn("part", F.col("expire_at_ms") % 2), 40_000, "part", "key")
        assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()
        used, want = [0, 0], {}
        for key, value, part, *_ in sorted(rows):
            cost = len(key) + len(value) + memory.ENTRY_OVERHEAD
            want[key] = used[part % 2] + cost <= 40_000
            used[part % 2] += cost * want[key]
        assert {r.key: r.admitted for r in out.collect()} == want
        out = memory.replay_with_limit(log, 40_000, 4)
        assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()
        small = sorted(tuple(r) for r in out.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(small) == 4 and small == sorted(tuple(r) for r in memory.replay_with_limit(log, 40_000, 4).collect())


def test_append_is_dense(spark, sf_dir):
    out = [r.new_lsn for r in wal.append(tables.mutation_log(spark, sf_dir), 7).select("new_lsn").collect()]
    assert sorted(out) == list(range(8, 8 + len(out)))


def test_fold_shuffles_partial_results_and_moves_only(spark, sf_dir):
    from lograil.operators.replay import keyspace

    plan = keyspace(tables.mutation_log(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    below = [p.split("\n")[1] for p in plan.split("Exchange hashpartitioning(key")[1:]]  # what each exchange takes
    assert below and all("partial_max" in x or "EXPIRE" in x or "signup" in x or "Project" in x for x in below)
    assert sum("partial_max" in x for x in below) >= 1 and "Window" in plan
    # Values go through partial aggregation only: no exchange takes rows of the log with them.
    assert not any("Project" in x and "props" in x for x in below)


def test_fold_of_a_hot_key_equals_a_plain_loop(spark):
    import random

    from lograil.operators.replay import keyspace

    rng, rows = random.Random(3), []
    for lsn in range(1, 3000):
        kind = rng.choice(["SET", "EXPIRE", "EXPIRE", "DEL"])
        key = "hot" if rng.random() < 0.4 else f"k{rng.randrange(60)}"
        rows.append((lsn, lsn * 10, kind, key, f"v{lsn}" if kind == "SET" else None, 0 if rng.random() < 0.3 else lsn * 10 + rng.randrange(-50, 400)))
    want, last = {}, {}
    for lsn, now, kind, key, value, at in rows:
        last[key] = lsn
        if key in want and want[key][1] and want[key][1] <= now:
            del want[key]
        if kind == "SET":
            want[key] = (value, at)
        elif kind == "DEL":
            want.pop(key, None)
        elif key in want:
            want[key] = (want[key][0], at)
    log = spark.createDataFrame(rows, "lsn long, created_at_ms long, rec_type string, key string, value string, expire_at_ms long").repartition(7)
    now = rows[-1][1]
    got = {r.key: (r.value, r.expire_at_ms, r.last_lsn) for r in keyspace(log).collect() if not (r.expire_at_ms and r.expire_at_ms <= now)}
    assert got == {k: (*v, last[k]) for k, v in want.items() if not (v[1] and v[1] <= now)}


def test_sampled_victims():
    entries = [(f"k{i}", 100, i * 7 % 50, i % 2) for i in range(50)]
    g = memory.SplitMix(0)
    assert [g.next() for _ in range(2)] == [0xE220A8397B1DCDAF, 0x6E789E6AA1B965F4]  # known values of the generator
    gone = memory.sampled_victims(entries, 2500, 5, 1)
    assert 5000 - 100 * len(gone) <= 2375 < 5000 - 100 * (len(gone) - 1) and len(set(gone)) == len(gone)
    # With many draws it is the exact order, and the protected key never goes.
    exact = [e[0] for e in sorted(entries, key=lambda e: e[2])]
    many = memory.sampled_victims(entries, 2500, 2000, 1)
    assert [dict((e[0], e[2]) for e in entries)[k] for k in many] == [dict((e[0], e[2]) for e in entries)[k] for k in exact[: len(many)]]
    assert memory.sampled_victims([("a", 100, 0, 0)], 10, 5, 1, protect="a") == [] and memory.sampled_victims(entries, 5000, 5, 1) == []
    assert all(int(k[1:]) % 2 for k in memory.sampled_victims(entries, 100, 5, 1, volatile=True))
    assert len(memory.sampled_victims([(f"k{i}", 1, i, 0) for i in range(500)], 1, 5, 1)) == memory.MAX_VICTIMS


def test_whole_store_eviction_equals_the_plain_order(spark):
    import random

    rng = random.Random(1)
    rows = [(f"k{i:03d}", "v" * rng.randint(0, 50), rng.choice([0, 5]), rng.choice([3, 3, rng.randrange(10**9)])) for i in range(300)]
    state = spark.createDataFrame(rows, "key string, value string, expire_at_ms long, last_access_ms long")
    for budget in (0, 20_000, 30_000, 10**9):
        for volatile in (False, True):
            used, gone = sum(len(k) + len(v) + 160 for k, v, *_ in rows), set()
            for k, v, e, at in sorted(rows, key=lambda r: (r[3], r[0])):
                if used > budget and (e or not volatile):
                    gone.add(k)
                    used -= len(k) + len(v) + 160
            assert {r.key for r in memory.evict_exact_store(state, budget, volatile).where("victim").collect()} == gone
    assert memory.evict_exact_store(state.limit(0), 5).count() == 0


def test_gaps_over_several_levels(spark, monkeypatch):
    monkeypatch.setattr(wal, "SUPER", 3)
    lsns = [1, 2, 5, 30, 31, 200, 201, 202, 999]
    got = wal.gaps(spark.createDataFrame([(x,) for x in lsns], "lsn long"), 10).collect()
    assert sorted(map(tuple, got)) == [(a, b, b - a - 1) for a, b in zip(lsns, lsns[1:]) if b - a > 1]


def test_generated_operations(spark):
    import numpy as np

    from lograil.operators import generate

    for s in (None, 1.2):
        ops = generate.operations(spark, 40_000, 50, 0.9, seed=5, zipf_s=s)
        rows = ops.collect()
        assert rows == ops.repartition(3).orderBy("seq").collect() and abs(np.mean([r.op == "GET" for r in rows]) - 0.9) < 0.01
        seen = np.bincount([int(r.key[-9:]) for r in rows], minlength=50)
        share = (1.0 + np.arange(50)) ** -(s or 0)
        want = 40_000 * share / share.sum()
        assert ((seen - want) ** 2 / want).sum() < 90  # 49 degrees of freedom


def test_every_query_runs_and_equals_its_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in ("customer", "orders", "lineitem", "events", "documents", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")

    def plain(v):
        return "~" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)

    for name, q in registry.QUERIES.items():
        df = q(spark, sf_dir)
        got = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
        if name in registry.ORACLES:
            want = con.sql(registry.ORACLES[name])
            at = [want.columns.index(c) for c in sorted(want.columns)]
            assert sorted(want.columns) == sorted(df.columns), name
            assert got == sorted(tuple(plain(float(r[i]) if type(r[i]).__name__ == "Decimal" else r[i]) for i in at) for r in want.fetchall()), name


def test_printable_of_all_documents(spark, tmp_path):
    texts = [None, "", "plain", "é中", "tab\tend", "back\\slash", "a" * 39, "a" * 40, "a" * 59 + "é", "é" * 9 + "abc", "é" * 10, "\x00\x0f\x7f~ ", "🙂" * 5000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def plain(t):
        s = "".join(chr(b) if 32 <= b < 127 else f"\\x{b:x}" for b in t.encode())
        return s[:37] + "..." if len(s) >= 40 else s

    got = {r.doc_id: r.p for r in registry.QUERIES["fn_printable_all"](spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None else plain(t) for i, t in enumerate(texts)}
