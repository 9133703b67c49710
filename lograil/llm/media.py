"""MPEG transport streams: writing, and reading with program tables, continuity and access points.

A payload is cut into access units of UNIT bytes. Each becomes one PES packet of a private-data stream
with PTS and DTS; every GROUP-th unit is a random-access point and carries the program clock. Transport packets
have 188 bytes; program association and map tables come first and before every random-access point. Work is vectorised over the
packets of one document and holds about four times its bytes.

The reader takes any transport stream with one program: it checks sync bytes, puts tables together from any
number of packets and checks their CRC-32, the continuity counters (repeated packets are dropped, jumps are counted), strips adaptation fields and stuffing,
reassembles PES packets and returns their timestamps with the flags of random access.

Defined cases: null text is empty; every payload is padded with zero bytes to a positive multiple of 64; a null
doc_id is kept; equal rows are rows each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, small_batches

PACKET, SYNC = 188, 0x47
PMT_PID, MEDIA_PID, PROGRAM, STREAM_TYPE = 0x1000, 0x0100, 1, 0x06
#: Bytes of an access unit, units between random-access points, and ticks of 90 kHz between units.
UNIT, GROUP, TICKS = 16_384, 8, 3_600
#: The adaptation field of a random-access packet: length, flags and a program clock of six bytes.
CLOCK = 8


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, extension: int, body: bytes) -> bytes:
    head = bytes([table_id, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 0xFF])
    s = head + extension.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return s + crc32_mpeg(s).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    """Its continuity counter is 0 and is set when the stream is laid out."""
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0])
    return (head + section).ljust(PACKET, b"\xff")


_PAT = _table_packet(0, _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")))
_PMT = _table_packet(
    PMT_PID,
    _section(2, PROGRAM, (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\x00"),
)


def _stamp(mark: int, t: int) -> bytes:
    return bytes([mark << 4 | (t >> 29) & 0x0E | 1, (t >> 22) & 0xFF, (t >> 14) & 0xFE | 1, (t >> 7) & 0xFF, (t << 1) & 0xFE | 1])


def _pes(unit: bytes, number: int) -> bytes:
    pts, dts = (number + 1) * TICKS, number * TICKS
    length = len(unit) + 13
    head = b"\x00\x00\x01\xbd" + (length if length < 65_536 else 0).to_bytes(2, "big")
    return head + b"\x84\xc0\x0a" + _stamp(3, pts) + _stamp(1, dts) + unit


def _clock(t: int) -> bytes:
    """A program clock reference of t ticks of 90 kHz: 33 bits, 6 reserved ones and an extension of 0."""
    return ((t & ((1 << 33) - 1)) << 15 | 0x3F << 9).to_bytes(6, "big")


def _packets(pes: bytes, random_access: bool, clock: int = 0) -> np.ndarray:
    """The transport packets of one PES packet, without continuity counters."""
    have = CLOCK if random_access else 0
    first = 184 - have
    n = 1 + max(0, -(-(len(pes) - first) // 184))
    room = first + 184 * (n - 1)
    out = np.full((n, PACKET), 0xFF, np.uint8)
    out[:, 0], out[:, 1], out[:, 2], out[:, 3] = SYNC, MEDIA_PID >> 8, MEDIA_PID & 0xFF, 0x10
    out[0, 1] |= 0x40
    data = np.frombuffer(pes, np.uint8)
    if random_access:
        out[0, 3:6] = 0x30, CLOCK - 1, 0x50
        out[0, 6:12] = np.frombuffer(_clock(clock), np.uint8)
    spare = room - len(pes)
    if spare:  # stuffing goes into an adaptation field of the last packet
        total = spare + (have if n == 1 else 0)
        out[-1, 3] = 0x30
        out[-1, 4] = total - 1
        if total > 1:
            out[-1, 5] = 0x50 if have and n == 1 else 0
        out[-1, 4 + total :] = data[len(data) - (184 - total) :]
        if n > 1:
            out[0, PACKET - first :] = data[:first]
            if n > 2:
                out[1:-1, 4:] = data[first : first + 184 * (n - 2)].reshape(n - 2, 184)
    else:
        out[0, PACKET - first :] = data[:first]
        if n > 1:
            out[1:, 4:] = data[first:].reshape(n - 1, 184)
    return out


def write_ts(payload: bytes, unit: int = UNIT, group: int = GROUP) -> bytes:
    """The payload as a transport stream of one program."""
    parts: list[np.ndarray] = []
    tables = 0
    for k, at in enumerate(range(0, max(len(payload), 1), unit)):
        if k % group == 0:
            for table in (_PAT, _PMT):
                p = np.frombuffer(table, np.uint8).copy().reshape(1, PACKET)
                p[0, 3] |= tables & 15
                parts.append(p)
            tables += 1
        parts.append(_packets(_pes(payload[at : at + unit], k), k % group == 0, k * TICKS))
    out = np.concatenate(parts)
    media = np.flatnonzero((out[:, 1] & 0x1F) == MEDIA_PID >> 8)
    out[media, 3] |= (np.arange(len(media)) & 15).astype(np.uint8)
    return out.tobytes()


@dataclass
class Stream:
    """What a transport stream holds: elementary bytes, (pts, dts, random access, offset) for each PES packet."""

    payload: bytes = b""
    packets: int = 0
    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    units: list[tuple[int | None, int | None, bool, int]] = field(default_factory=list)
    clocks: list[int] = field(default_factory=list)
    discontinuities: int = 0
    repeated: int = 0
    bad_tables: int = 0


def _sections(rows: np.ndarray, start: np.ndarray) -> list[bytes]:
    """Whole sections of one table's packets; a section goes on through packets until its length is reached."""
    out, held = [], b""
    for row, at in zip(rows, start):
        b = row[at:].tobytes()
        parts = [b]
        if row[1] & 0x40 and b:
            parts = [b[1 : 1 + b[0]], b[1 + b[0] :]]  # the end of the section before, and a new one
        for k, part in enumerate(parts):
            held = part if k else held + part if held else b""
            while len(held) > 3 and held[0] != 0xFF and len(held) >= (size := 3 + ((held[1] & 0x0F) << 8 | held[2])):
                out.append(held[:size])
                held = held[size:]
            if held[:1] == b"\xff":
                held = b""
    return out


def _time(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def read_ts(data: bytes) -> Stream:
    """Reads a stream whose length is a multiple of 188 and whose packets begin with the sync byte."""
    if len(data) % PACKET:
        raise ValueError("a transport stream has a multiple of 188 bytes")
    rows = np.frombuffer(data, np.uint8).reshape(-1, PACKET)
    if not (rows[:, 0] == SYNC).all():
        raise ValueError("lost sync")
    s = Stream(packets=len(rows))
    pid = (rows[:, 1] & 0x1F).astype(np.int32) << 8 | rows[:, 2]
    control = rows[:, 3] >> 4 & 3
    start = np.where(control & 2, 5 + rows[:, 4].astype(np.int32), 4)
    start = np.where(control & 1, start, PACKET)

    def tables(of: int, table_id: int) -> list[bytes]:
        own = pid == of
        found = []
        for b in dict.fromkeys(_sections(rows[own], start[own])):
            if len(b) < 12 or b[0] != table_id or crc32_mpeg(b[:-4]) != int.from_bytes(b[-4:], "big"):
                s.bad_tables += 1
            else:
                found.append(b)
        return found

    for b in tables(0, 0):
        for i in range(8, len(b) - 4, 4):
            if number := int.from_bytes(b[i : i + 2], "big"):
                s.programs[number] = int.from_bytes(b[i + 2 : i + 4], "big") & 0x1FFF
    for map_pid in s.programs.values():
        for b in tables(map_pid, 2):
            i = 12 + (int.from_bytes(b[10:12], "big") & 0x0FFF)
            while i + 5 <= len(b) - 4:
                s.streams[int.from_bytes(b[i + 1 : i + 3], "big") & 0x1FFF] = b[i]
                i += 5 + (int.from_bytes(b[i + 3 : i + 5], "big") & 0x0FFF)

    body: list[bytes] = []
    offset = 0
    for es in s.streams:
        own = np.flatnonzero((pid == es) & ((control & 1) == 1))
        if not len(own):
            continue
        cc = rows[own, 3] & 15
        step = (cc[1:] - cc[:-1]) & 15
        again = np.concatenate(([False], (step == 0) & (rows[own[1:], 4:] == rows[own[:-1], 4:]).all(axis=1)))
        s.repeated += int(again.sum())
        own = own[~again]
        cc = rows[own, 3] & 15
        s.discontinuities += int((((cc[1:] - cc[:-1]) & 15) != 1).sum())
        begins = np.flatnonzero(rows[own, 1] & 0x40)
        keep = np.arange(PACKET)[None, :] >= start[own][:, None]
        flat, ends = rows[own][keep].tobytes(), np.cumsum(PACKET - np.minimum(start[own], PACKET))
        for k, b in enumerate(begins):
            lo = int(ends[b - 1]) if b else 0
            hi = int(ends[begins[k + 1] - 1]) if k + 1 < len(begins) else len(flat)
            pes = flat[lo:hi]
            if pes[:3] != b"\x00\x00\x01" or len(pes) < 9:
                s.discontinuities += 1
                continue
            row = rows[own[b]]
            access = bool(row[3] & 0x20 and row[4] and row[5] & 0x40)
            if row[3] & 0x20 and row[4] >= 7 and row[5] & 0x10:
                s.clocks.append(int.from_bytes(row[6:12].tobytes(), "big") >> 15)
            flags, unit = pes[7] >> 6, pes[9 + pes[8] :]
            pts = _time(pes[9:14]) if flags & 2 else None
            s.units.append((pts, _time(pes[14:19]) if flags == 3 else pts, access, offset))
            body.append(unit)
            offset += len(unit)
    s.payload = b"".join(body)
    return s


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64))


def feature(s: Stream) -> str:
    """Counts, timestamps and random-access points of what was read back."""
    points = [(t, at) for t, _, access, at in s.units if access]
    return (
        f"packets={s.packets};programs={len(s.programs)};streams={len(s.streams)};units={len(s.units)};"
        f"jumps={s.discontinuities};pts={s.units[0][0]}-{s.units[-1][0]};access={len(points)};"
        f"last_access={points[-1][0]}@{points[-1][1]}"
    )


OUT = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long,"
    " media_sha256 string, feature string"
)


def transport_streams(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """One row of OUT for each row of docs(doc_id, text), with the stream itself and its index with keep_media."""
    small_batches(docs.sparkSession)
    names = [c.split()[0] for c in OUT.split(", ")] + ["media", "index"] * keep_media

    def run(batches):
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                raw = text.encode("utf-8", "surrogatepass")
                media = write_ts(padded(raw))
                s = read_ts(media)
                sha = hashlib.sha256(s.payload).hexdigest()
                row = (doc_id, len(raw), len(s.payload), sha, zlib.crc32(s.payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(s))
                rows.append(row + ((media, [{"pts": p, "dts": d, "random_access": a, "offset": o} for p, d, a, o in s.units]) if keep_media else ()))
            out = pd.DataFrame(rows, columns=names)
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    schema = OUT + ", media binary, index array<struct<pts:long,dts:long,random_access:boolean,offset:long>>" * keep_media
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, schema)


def op7_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport_streams(read(spark, sf_dir, "documents"))
