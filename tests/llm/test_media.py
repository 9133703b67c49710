import hashlib
import random
import zlib

import pytest

from lograil.llm.media import GROUP, PACKET, UNIT, crc32_mpeg, padded, read_ts, transport_streams, write_ts


def test_crc_known_value():
    assert crc32_mpeg(b"123456789") == 0x0376E6E7


@pytest.mark.parametrize("unit", [1, 64, 150, 163, 165, 169, 171, 184, 333, 4096])
def test_round_trip(unit):
    rng = random.Random(unit)
    for n in [64, 128, 192, 640, 64 * rng.randint(20, 90)]:
        payload = rng.randbytes(n)
        s = read_ts(write_ts(payload, unit=unit, group=3))
        assert s.payload == payload
        assert s.discontinuities == s.repeated == s.bad_tables == 0
        assert s.programs == {1: 0x1000} and s.streams == {0x100: 6}
        assert [u[2] for u in s.units] == [k % 3 == 0 for k in range(len(s.units))]
        assert all(d is not None and p > d for p, d, _, _ in s.units)


def test_faults_are_seen():
    ts = write_ts(random.Random(1).randbytes(64 * 40))
    assert read_ts(ts[: PACKET * 5] + ts[PACKET * 6 :]).discontinuities == 1
    again = read_ts(ts[: PACKET * 5] + ts[PACKET * 4 :])
    assert again.repeated == 1 and again.discontinuities == 0 and again.payload == read_ts(ts).payload
    broken = bytearray(ts)
    broken[10] ^= 1
    assert read_ts(bytes(broken)).bad_tables == 1
    with pytest.raises(ValueError):
        read_ts(ts[1:])


def by_hand(pid, start, counter, body, fill=b"\xff"):
    """A packet without adaptation field, by the bit layout of the standard."""
    assert len(body) <= 184
    bits = f"{0x47:08b}0{int(start)}0{pid:013b}0001{counter:04b}"
    return int(bits, 2).to_bytes(4, "big") + body + fill * (184 - len(body))


def test_a_stream_of_another_writer():
    def section(table, number, body):
        bits = f"{table:08b}1011{len(body) + 9:012b}{number:016b}11000001" + "0" * 16
        s = int(bits, 2).to_bytes(8, "big") + body
        c = 0xFFFFFFFF
        for byte in s:
            for k in range(7, -1, -1):
                top = (c >> 31) ^ (byte >> k & 1)
                c = (c << 1 & 0xFFFFFFFF) ^ (0x04C11DB7 if top else 0)
        return s + c.to_bytes(4, "big")

    pat = section(0, 7, bytes([0, 0, 0xE0, 0x10, 0, 9, 0xE1, 0x23]))  # network table, and program 9 on 0x123
    notes = bytes([0x0A, 250]) + bytes(250)  # a descriptor that makes the map longer than a packet
    pmt = section(2, 9, bytes([0xE2, 0, 0xF0 | len(notes) >> 8, len(notes) & 255]) + notes + bytes([0x1B, 0xE2, 0, 0xF0, 0]))
    payload = bytes(range(256)) * 2
    pes = b"\x00\x00\x01\xe0\x00\x00\x80\x80\x05" + bytes([0x21, 0, 5, 0xBF, 0x21]) + payload  # PTS 90000
    rest = len(pes) - 184 * 2
    last = bytes([0x47, 2, 0, 0x30 | 2, 183 - rest, 0]) + b"\xff" * (182 - rest) + pes[368:]
    one = lambda start, n, body: by_hand(0x200, start, n, body)
    ts = by_hand(0, True, 0, b"\0" + pat) + by_hand(0x1FFF, False, 0, b"") + by_hand(0x123, True, 0, (b"\0" + pmt)[:184]) + one(True, 0, pes[:184])
    ts += by_hand(0x123, False, 1, (b"\0" + pmt)[184:]) + one(False, 1, pes[184:368]) + last
    s = read_ts(ts)
    assert s.payload == payload and s.bad_tables == s.discontinuities == 0
    assert s.programs == {9: 0x123} and s.streams == {0x200: 0x1B} and s.units == [(90_000, 90_000, False, 0)]


def test_the_clock_goes_before_the_timestamps():
    s = read_ts(write_ts(bytes(64 * 30), unit=64, group=4))
    assert len(s.clocks) == sum(u[2] for u in s.units) == 8 and s.clocks == [u[1] for u in s.units if u[2]]


def test_rows(spark):
    big = "é" * (UNIT * GROUP)
    rows = [(1, "abc", 5), (2, None, 6), (3, "", None), (4, "abc", 7), (None, big, 8)]
    got = {r.doc_id: r for r in transport_streams(spark.createDataFrame(rows, "doc_id long, text string, n_bytes int"), True).collect()}
    assert got[1].feature == got[4].feature and got[1].media_sha256 == got[4].media_sha256
    for doc_id, text, _ in rows:
        raw = (text or "").encode()
        p, r = padded(raw), got[doc_id]
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(raw), len(p), len(r.media))
        assert r.payload_sha256 == hashlib.sha256(p).hexdigest() and r.tail_crc32 == zlib.crc32(p[-64:])
    assert sum(i.random_access for i in got[None]["index"]) == 2
    assert transport_streams(spark.createDataFrame([], "doc_id long, text string")).count() == 0
