import random

import pytest

from lograil.sources import formats as w

CASES = [
    w.Record(1, 12345, "SET", 0, b"k", b"v", 0), w.Record(2, 0, "DEL", 0, b"gone", b"", 0), w.Record(3, 0, "EXPIRE", 0, b"k", b"", 999999),
    w.Record(4, 0, "SET", 0, b"", b"", 0), w.Record(5, 0, "SET", 0, b"k" * 65_535, b"v", 0), w.Record(7, 0, "SET", 0, b"\x00\xff\n", b"\x00", 0),
]


def test_crc():
    assert w.crc32c(b"123456789") == 0xE3069283


@pytest.mark.parametrize("record", CASES)
def test_round_trip_and_prefixes(record):
    raw = w.encode_record(record)
    assert w.decode_record(raw) == (record, len(raw)) and len(raw) == 40 + len(record.key) + len(record.value)
    for n in range(0, len(raw), max(1, len(raw) // 50)):
        with pytest.raises(ValueError):
            w.decode_record(raw[:n])


def test_every_bit_flip_is_seen():
    raw = w.encode_record(CASES[2])
    for bit in range(len(raw) * 8):
        broken = bytearray(raw)
        broken[bit // 8] ^= 1 << bit % 8
        with pytest.raises(ValueError):
            w.decode_record(bytes(broken))


def test_numbers_beyond_63_bits():
    with pytest.raises(w.Corrupt):
        w.decode_record(w.encode_record(w.Record((1 << 64) - 1, 0, "SET", 0xAB, b"max-lsn", b"v", 0)))


def segment(first, n):
    return w.segment_header(first) + b"".join(w.encode_record(w.Record(first + i, i, "SET", 0, b"key%d" % i, b"v" * i, 0)) for i in range(n))


def test_segment_faults_and_verdicts():
    good = segment(1, 10)
    assert w.scan_segment(good)[1:] == ("none", len(good))
    assert w.scan_segment(good[:-3])[1] == "torn" and len(w.scan_segment(good[:-3])[0]) == 9
    assert w.scan_segment(good + bytes.fromhex("DEADBEEF00"))[1] == "torn"
    assert w.scan_segment(b"")[1:] == ("torn", 0)
    flipped = bytearray(good)
    flipped[len(good) // 2] ^= 1
    assert w.scan_segment(bytes(flipped))[1] == "corrupt"
    assert w.verdict(["none", "torn"]) == "truncate" and w.verdict(["torn", "none"]) == "refuse"
    assert w.verdict(["none", "corrupt"]) == "refuse" and w.verdict(["corrupt", "none"], unsafe=True) == "truncate"
    assert w.verdict(["none"]) == "continue"


def test_log_source(spark, tmp_path):
    for first in (1, 11, 21):
        (tmp_path / f"{first:016d}.log").write_bytes(segment(first, 10))
    for stray in ("notes.txt", "123.log", f"{5:016d}.log.bak"):
        (tmp_path / stray).write_bytes(b"x")
    w.register(spark)
    log = spark.read.format("keyed_log").option("after_lsn", 12).load(str(tmp_path))
    assert sorted(r.lsn for r in log.collect()) == list(range(13, 31))
    assert len(w.LogReader({"path": str(tmp_path), "after_lsn": "20"}).partitions()) == 1
    last = tmp_path / f"{21:016d}.log"
    last.write_bytes(last.read_bytes()[:-3])
    faults = spark.read.format("keyed_log").option("rows", "faults").load(str(tmp_path)).orderBy("first_lsn").collect()
    assert [r.fault for r in faults] == ["none", "none", "torn"] and [r.records for r in faults] == [10, 10, 9]


def test_snapshots(spark, tmp_path):
    entries = [(b"", b"", 0), (b"\x00", b"\xff\x00", 5), (b"normal", b"v" * 100_000, 0)]
    raw = w.encode_snapshot(entries, 42)
    assert w.decode_snapshot(raw) == (42, entries) and w.decode_snapshot(w.encode_snapshot([], 1)) == (1, [])
    rng = random.Random(1)
    for broken in (raw[: len(raw) // 2], raw[:-20], b"", *(raw[:i] + bytes([raw[i] ^ 1]) + raw[i + 1 :] for i in [0, 9, *(rng.randrange(len(raw)) for _ in range(5))])):
        with pytest.raises(ValueError):
            w.decode_snapshot(broken)
    (tmp_path / f"{10:016d}.snap").write_bytes(w.encode_snapshot([(b"old", b"1", 0)], 10))
    (tmp_path / f"{42:016d}.snap").write_bytes(raw[:-1])
    w.register(spark)
    assert [(r.key, r.last_included_lsn) for r in spark.read.format("keyed_snapshot").load(str(tmp_path)).collect()] == [(b"old", 10)]


def test_frames_and_commands():
    body = w.encode_command(0x03, key=b"k", value=b"v" * 9, ttl_ms=7)
    assert w.decode_command(0x03, body) == {"key": b"k", "value": b"v" * 9, "ttl_ms": 7}
    frame = w.encode_frame(0x03, body, request_id=5, flags=1)
    assert len(frame) == 16 + len(body) and w.decode_frame(frame) == (0x03, 5, 1, body)
    for i, value in ((0, 0), (2, 0x99), (5, 0x80), (6, 1), (15, 0xFF)):
        broken = bytearray(frame)
        broken[i] = value
        with pytest.raises(ValueError):
            w.decode_frame(bytes(broken))
    for op in w._BODIES:
        for junk in (b"\x05", body + b"x"):
            with pytest.raises(ValueError):
                w.decode_command(op, junk)
    with pytest.raises(KeyError):
        w.decode_command(0x7F, b"")


def test_text_protocol(spark):
    lines = ["set a 1", "  GET   a ", "", "get", "dance x", "PING", "delete k", "DEL k", "exit", "set a b 7", "set a b x", "expire k 9", "expire k", f"expire k {2**63}", f"expire k {2**64}", "get a b"]
    got = {r.line: (r.op, r.key, r.status) for r in w.parse_text(spark.createDataFrame([(x,) for x in lines], "line string")).collect()}
    assert got["set a 1"] == ("SET", "a", "OK") and got["  GET   a "] == ("GET", "a", "OK") and got[""][2] == "EMPTY"
    assert got["delete k"] == got["DEL k"] == ("DELETE", "k", "OK") and got["exit"][::2] == ("QUIT", "OK")
    assert [got[x][2] for x in lines[9:]] == ["OK", "BAD_TTL", "OK", "ARGUMENTS", "OK", "BAD_TTL", "ARGUMENTS"]
    assert got["get"][2] == "ARGUMENTS" and got["dance x"][2] == "UNKNOWN" and got["PING"][2] == "OK"
