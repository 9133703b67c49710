"""Sinks, recovery of a folder and captured streams."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from lograil.sources import captures, recovery
from lograil.sources import formats as w

LOG = "lsn long, created_at_ms long, rec_type string, flags int, key binary, value binary, expire_at_ms long"


def records(first, n):
    return [w.Record(first + i, i, "SET", 0, b"key%d" % i, b"v" * (i % 50), 0) for i in range(n)]


def segment(first, n):
    return w.segment_header(first) + b"".join(map(w.encode_record, records(first, n)))


def folder(tmp_path, *sizes):
    first = 1
    for n in sizes:
        (tmp_path / f"{first:016d}.log").write_bytes(segment(first, n))
        first += n
    return str(tmp_path), sorted(tmp_path.glob("*.log"))


def slow_crc(data):
    c = 0xFFFFFFFF
    for b in data:
        c ^= b
        for _ in range(8):
            c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


@pytest.mark.parametrize("n", [0, 1, 511, 4095, 4096, 4097, 9000, 20_000])
def test_checksum_of_any_length(n):
    import numpy as np

    data = random.Random(n).randbytes(n)
    assert w.crc32c(data) == slow_crc(data)
    k = n // 3
    assert w.crc32c_join(w.crc32c(data[:k]), w.crc32c(data[k:]), n - k) == w.crc32c(data) == w.crc32c(data[k:], w.crc32c(data[:k]))
    begin, size = np.array([0, k, n, 0]), np.array([n, n - k, 0, k])
    assert w.crc32c_many(data, begin, size).tolist() == [slow_crc(data[b : b + s]) for b, s in zip(begin, size)]


def test_segments_in_chunks(monkeypatch):
    data = segment(1, 400)
    whole = w.scan_segment(data)
    assert [r.lsn for r in whole[0]] == list(range(1, 401)) and whole[1:] == ("none", len(data))
    again = data[:5000] + w.segment_header(7) + data[5000:]
    for chunk in (64, 999, 1 << 20):
        monkeypatch.setattr(w, "CHUNK", chunk)
        assert w.scan_segment(data) == whole
        for cut in (0, 3, 30, 90, 5000, len(data) - 1):
            got = w.scan_segment(data[:cut])
            assert got[1] in ("torn", "none") and got[0] == whole[0][: len(got[0])] and got[2] <= cut
        broken = bytearray(data)
        broken[9000] ^= 4
        got = w.scan_segment(bytes(broken))
        assert got[1] == "corrupt" and got[0] == whole[0][: len(got[0])] and 8900 < got[2] <= 9000
        assert w.scan_segment(again)[1] == "corrupt"


def test_a_healthy_log_goes_on(spark, tmp_path):
    path, _ = folder(tmp_path, 10, 20, 5)
    _, log, p = recovery.recover(spark, path)
    assert (p.verdict, p.segments, p.records, p.applied, p.skipped, p.next_lsn) == ("continue", 3, 35, 35, 0, 36)
    assert log.count() == 35 and recovery.plan(spark, str(tmp_path / "none-here") if (tmp_path / "none-here").mkdir() is None else "").next_lsn == 1


@pytest.mark.parametrize("which", [0, 1, 2])
@pytest.mark.parametrize("fault", ["torn", "corrupt"])
def test_verdicts_of_a_folder(spark, tmp_path, which, fault):
    path, files = folder(tmp_path, 10, 20, 5)
    raw = bytearray(files[which].read_bytes())
    if fault == "torn":
        raw = raw[:-3]
    else:
        raw[len(raw) // 2] ^= 1
    files[which].write_bytes(bytes(raw))
    if fault == "torn" and which == 2:
        _, log, p = recovery.recover(spark, path)
        assert (p.verdict, p.next_lsn) == ("truncate", 35) and log.count() == 34
    else:
        with pytest.raises(recovery.Refused):
            recovery.recover(spark, path)
        assert files[which].read_bytes() == bytes(raw)  # refusing changes nothing
    _, log, p = recovery.recover(spark, path, unsafe=True)
    assert p.verdict == "truncate" and [r.lsn for r in log.orderBy("lsn").collect()] == list(range(1, p.next_lsn))
    recovery.repair(p)
    _, log, again = recovery.recover(spark, path)
    assert (again.verdict, again.next_lsn, again.segments) == ("continue", p.next_lsn, which + 1) and log.count() == p.next_lsn - 1


def test_written_segments_are_read_again(spark, tmp_path):
    w.register(spark)
    rows = [(r.lsn, r.created_at_ms, r.rec_type, 0, r.key, r.value, 0) for r in records(1, 500)]
    log = spark.createDataFrame(rows, LOG).repartitionByRange(4, "lsn").sortWithinPartitions("lsn")
    out = str(tmp_path / "log")
    log.write.format("keyed_log").option("segment_size", 4000).mode("append").save(out)
    assert spark.read.format("keyed_log").load(out).orderBy("lsn").collect() == log.orderBy("lsn").collect()
    p = recovery.plan(spark, out)
    assert p.verdict == "continue" and p.segments > 6 and p.next_lsn == 501
    assert not list((tmp_path / "log").glob("*.tmp"))
    with pytest.raises(Exception, match="begins at that lsn"):
        log.write.format("keyed_log").option("segment_size", 4000).mode("append").save(out)
    assert not list((tmp_path / "log").glob("*.tmp"))


def test_written_snapshots_are_read_again_and_pruned(spark, tmp_path):
    w.register(spark)
    out = str(tmp_path / "s")
    df = spark.range(3000).select(F.concat(F.lit("k"), "id").cast("binary").alias("key"), F.repeat(F.lit("x"), (F.col("id") % 9).cast("int")).cast("binary").alias("value"), F.col("id").alias("expire_at_ms"))
    for lsn in (10, 20, 30):
        df.where(F.col("id") < lsn * 100).repartition(3).write.format("keyed_snapshot").option("last_lsn", lsn).mode("append").save(out)
    got = spark.read.format("keyed_snapshot").load(out)
    assert got.drop("last_included_lsn").orderBy("expire_at_ms").collect() == df.orderBy("expire_at_ms").collect()
    assert [(r.last_included_lsn, r.entries, r.fault) for r in spark.read.format("keyed_snapshot").option("rows", "list").load(out).orderBy("last_included_lsn").collect()] == [(20, 2000, "none"), (30, 3000, "none")]
    assert {x.name for x in (tmp_path / "s").iterdir()} == {f"{20:016d}.snap", f"{30:016d}.snap"}


def test_recovery_takes_the_newest_valid_snapshot(spark, tmp_path):
    path, _ = folder(tmp_path, 10, 20, 5)
    (tmp_path / f"{12:016d}.snap").write_bytes(w.encode_snapshot([(b"a", b"b", 0)], 12))
    (tmp_path / f"{30:016d}.snap").write_bytes(w.encode_snapshot([(b"a", b"c", 0)], 30)[:-1])
    snapshot, log, p = recovery.recover(spark, path)
    assert (p.snapshot_lsn, p.applied, p.skipped, p.next_lsn) == (12, 23, 12, 36) and log.agg(F.min("lsn")).first()[0] == 13
    assert [(bytes(r.key), bytes(r.value)) for r in snapshot.collect()] == [(b"a", b"b")]


def test_replication_messages(spark):
    r = w.Record(7, 5, "SET", 0, b"k", b"v", 9)
    m = captures.encode_message
    data = m("FULL_BEGIN", 3) + m("RECORD", record=r) + m("FULL_END", 3) + m("HEARTBEAT", 8, 2) + m("ACK", 6) + m("REJECT", reason=b"x" * 2000)
    assert data[:9] == b"\x03" + struct.pack("<Q", 3)
    kinds = [x[0] for x in captures.decode_messages(data)]
    assert kinds == ["FULL_BEGIN", "RECORD", "FULL_END", "HEARTBEAT", "ACK", "REJECT"]
    flipped = bytearray(data)
    flipped[25] ^= 1
    rows = [("a", data), ("cut", data[:-1]), ("flip", bytes(flipped)), ("type", b"\x09"), ("none", None), ("long", b"\x01" + bytes(4) + b"\xff" * 4)]
    got = {}
    for x in captures.replication_messages(spark.createDataFrame(rows, "stream string, data binary")).orderBy("seq").collect():
        got.setdefault(x.stream, []).append(x)
    assert [x.msg_type for x in got["a"]] == kinds and got["a"][1].lsn == 7 and bytes(got["a"][1].key) == b"k" and got["a"][3].epoch == 2 and len(got["a"][5].reason) == 1024
    assert got["cut"][-1].fault.startswith("torn") and got["flip"][-1].fault.startswith("corrupt") and len(got["flip"]) == 2
    assert got["type"][0].fault.startswith("corrupt") and got["long"][0].fault == "corrupt: record length" and "none" not in got


def test_requests(spark):
    frame = w.encode_frame
    data = frame(0x03, w.encode_command(0x03, key=b"k", value=b"v", ttl_ms=5), 1) + frame(0x02, b"\x05\x00ab", 2, 1) + frame(0x7F, b"", 3) + frame(0x0B, w.encode_command(0x0B, key=b"p", limit=9), 4)
    got = captures.requests(spark.createDataFrame([("c", data), ("bad", b"XX" + data[2:]), ("cut", data[:-1])], "stream string, data binary")).orderBy("stream", "seq").collect()
    c = [x for x in got if x.stream == "c"]
    assert [(x.op, x.no_reply, x.fault) for x in c] == [("SET", False, None), ("GET", True, "corrupt: short body"), (None, False, "unknown operation"), ("KEYS", False, None)]
    assert (c[0].ttl_ms, c[3].limit) == (5, 9) and [x.fault for x in got if x.stream == "bad"] == ["corrupt: magic"]
    assert [x.fault for x in got if x.stream == "cut"][-1] == "torn: frame body"
