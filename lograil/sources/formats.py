"""The binary log, snapshot and wire formats: encoding, decoding, and Spark data sources for them.

All integers are little-endian. A log record is CRC-32C u32, length u32, then the payload: lsn u64,
created_at_ms u64, type u8, flags u8, key length u16, value length u32, expire_at_ms u64, key, value.
Readers never write: a torn or corrupt segment gives a fault row with its offset instead.
"""

from __future__ import annotations

import io
import os
import re
import shutil
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SET, DEL, EXPIRE, SEGMENT_HDR = 1, 2, 3, 4
TYPES = {SET: "SET", DEL: "DEL", EXPIRE: "EXPIRE", SEGMENT_HDR: "SEGMENT_HDR"}
_CODES = {v: k for k, v in TYPES.items()}
MAX_KEY, MAX_VALUE = 65_535, 16 << 20
_FIXED = struct.Struct("<QQBBHIQ")
_HEAD = struct.Struct("<II")
MAX_RECORD = _FIXED.size + MAX_KEY + MAX_VALUE
# Fixed values of the file and wire formats.
SEGMENT_MAGIC, SEGMENT_VERSION = b"KVWALSEG", 1
SNAP_MAGIC, SNAP_END, SNAP_VERSION = b"KVSNAP01", b"KVSNAPFT", 1
_SNAP_HEAD, _SNAP_ENTRY, _SNAP_FOOT = struct.Struct("<8sIQQI"), struct.Struct("<HIQ"), struct.Struct("<8sQI")
FRAME = struct.Struct("<HBBHHII")
FRAME_MAGIC, FRAME_VERSION, MAX_FRAME = 0x564B, 1, MAX_KEY + MAX_VALUE + 64


def _table() -> list[int]:
    out = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0x82F63B78 if i & 1 else 0)
        out.append(i)
    return out


_CRC = _table()
_CRC_ARRAY = np.array(_CRC, np.uint32)
#: Bytes that are checked side by side, and lengths from which that pays.
_BLOCK, _LONG = 512, 4096


@lru_cache(maxsize=64)
def _shift(size: int) -> tuple[list[int], ...]:
    """Tables, for each byte of a checksum register, of what it becomes after size zero bytes."""

    def times(m: list[int], v: int) -> int:
        out = 0
        for i in range(32):
            if v >> i & 1:
                out ^= m[i]
        return out

    step = [_CRC[1 << i] if i < 8 else (1 << i) >> 8 for i in range(32)]  # one zero byte
    power, n = [1 << i for i in range(32)], size
    while n:
        if n & 1:
            power = [times(step, v) for v in power]
        step, n = [times(step, v) for v in step], n >> 1
    return tuple([times(power, b << 8 * k) for b in range(256)] for k in range(4))


def _advance(crc: int, size: int) -> int:
    t = _shift(size)
    return t[0][crc & 255] ^ t[1][crc >> 8 & 255] ^ t[2][crc >> 16 & 255] ^ t[3][crc >> 24]


def crc32c(data: bytes, crc: int = 0) -> int:
    """Long data is checked in blocks side by side, whose registers are then joined."""
    crc ^= 0xFFFFFFFF
    if len(data) >= _LONG:
        rows = np.frombuffer(data, np.uint8, len(data) // _BLOCK * _BLOCK).reshape(-1, _BLOCK)
        state = np.zeros(len(rows), np.uint32)
        for j in range(_BLOCK):
            state = _CRC_ARRAY[(state ^ rows[:, j]) & 0xFF] ^ state >> np.uint32(8)
        for part in state.tolist():
            crc = _advance(crc, _BLOCK) ^ part
        data = data[rows.size :]
    table = _CRC
    for b in data:
        crc = table[(crc ^ b) & 0xFF] ^ crc >> 8
    return crc ^ 0xFFFFFFFF


def crc32c_join(first: int, second: int, second_size: int) -> int:
    """The checksum of two pieces one after the other, from those of each."""
    return _advance(first, second_size) ^ second


def crc32c_many(data: bytes, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The checksum of each piece of data, all pieces side by side."""
    a = np.frombuffer(data, np.uint8)
    out = np.zeros(len(begin), np.uint32)
    big = np.flatnonzero(size >= _LONG)
    out[big] = [crc32c(data[begin[i] : begin[i] + size[i]]) for i in big]
    order = np.flatnonzero(size < _LONG)
    order = order[np.argsort(-size[order], kind="stable")]
    at, left = begin[order].astype(np.int64), -size[order].astype(np.int64)
    state = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for j in range(-int(left[0]) if len(order) else 0):
        n = int(np.searchsorted(left, -j, side="left"))  # pieces of more than j bytes
        state[:n] = _CRC_ARRAY[(state[:n] ^ a[at[:n] + j]) & 0xFF] ^ state[:n] >> np.uint32(8)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


class Torn(ValueError):
    """The file ends inside a record."""


class Corrupt(ValueError):
    """Bytes that no writer produces."""


@dataclass(frozen=True)
class Record:
    lsn: int
    created_at_ms: int
    rec_type: str
    flags: int
    key: bytes
    value: bytes
    expire_at_ms: int


def encode_record(r: Record) -> bytes:
    if len(r.key) > MAX_KEY or len(r.value) > MAX_VALUE:
        raise ValueError("key or value too long")
    body = _FIXED.pack(r.lsn, r.created_at_ms, _CODES[r.rec_type], r.flags, len(r.key), len(r.value), r.expire_at_ms) + r.key + r.value
    return _HEAD.pack(crc32c(body), len(body)) + body


def decode_record(buf: bytes, at: int = 0) -> tuple[Record, int]:
    """(record, end); bounds are looked at before the checksum, this before the fields, these before the type."""
    if len(buf) - at < _HEAD.size:
        raise Torn("record header")
    crc, size = _HEAD.unpack_from(buf, at)
    if not _FIXED.size <= size <= MAX_RECORD:
        raise Corrupt("record length")
    if len(buf) - at - _HEAD.size < size:
        raise Torn("record body")
    body = buf[at + _HEAD.size : at + _HEAD.size + size]
    if crc32c(body) != crc:
        raise Corrupt("checksum")
    return _fields(body), at + _HEAD.size + size


def _fields(body: bytes) -> Record:
    lsn, created, kind, flags, k, v, expire = _FIXED.unpack_from(body)
    if _FIXED.size + k + v != len(body):
        raise Corrupt("lengths")
    if kind not in TYPES:
        raise Corrupt("record type")
    if max(lsn, created, expire) >= 1 << 63:
        raise Corrupt("number beyond 63 bits")
    key = body[_FIXED.size : _FIXED.size + k]
    return Record(lsn, created, TYPES[kind], flags, key, body[_FIXED.size + k :], expire)


def segment_header(first_lsn: int, created_at_ms: int = 0) -> bytes:
    return encode_record(Record(first_lsn, created_at_ms, "SEGMENT_HDR", 0, SEGMENT_MAGIC, struct.pack("<I", SEGMENT_VERSION), 0))


def _checked(data: bytes) -> tuple[list[Record], list[int], str, int]:
    """Records of data and where they begin, up to the first fault; their checksums are computed together."""
    begin, size, want = [], [], []
    fault, pos = "none", 0
    while pos < len(data):
        if len(data) - pos < _HEAD.size:
            fault = "torn"
            break
        crc, n = _HEAD.unpack_from(data, pos)
        if not _FIXED.size <= n <= MAX_RECORD:
            fault = "corrupt"
            break
        if len(data) - pos - _HEAD.size < n:
            fault = "torn"
            break
        begin.append(pos + _HEAD.size)
        size.append(n)
        want.append(crc)
        pos += _HEAD.size + n
    ok = crc32c_many(data, np.array(begin, np.int64), np.array(size, np.int64)) == np.array(want, np.uint32)
    good = len(ok) if ok.all() else int(ok.argmin())
    out = []
    for i in range(good):
        try:
            out.append(_fields(data[begin[i] : begin[i] + size[i]]))
        except Corrupt:
            good, fault = i, "corrupt"
            break
    if good < len(ok):
        fault, pos = "corrupt", begin[good] - _HEAD.size
    return out, [b - _HEAD.size for b in begin[:good]], fault, pos


#: Bytes of a segment that are read at once.
CHUNK = 4 << 20


def stream_segment(f) -> Iterator[tuple[list[Record], str | None, int]]:
    """(records, fault, offset) for each chunk of an open segment; fault is none, torn or corrupt in the last one, else None."""
    data, at, last, first = b"", 0, False, True
    while not last:
        more = f.read(max(CHUNK, len(data)))
        last, data = not more, data + more
        if last and first and not data:
            yield [], "torn", 0
            return
        records, begins, fault, end = _checked(data)
        for i, r in enumerate(records):
            if (first and i == 0) != (r.rec_type == "SEGMENT_HDR") or first and i == 0 and r.key != SEGMENT_MAGIC:
                yield records[first:i], "corrupt", at + begins[i]
                return
        header, first = first and bool(records), first and not records
        fault = fault if last or fault == "corrupt" else None  # a record may go on in the next chunk
        yield records[header:], fault, at + end
        if fault == "corrupt":
            return
        data, at = data[end:], at + end


def scan_segment(data: bytes) -> tuple[list[Record], str, int]:
    """(records, fault, offset): fault is none, torn or corrupt, at that offset."""
    out: list[Record] = []
    for records, fault, at in stream_segment(io.BytesIO(data)):
        out += records
    return out, fault, at


def verdict(faults: list[str], unsafe: bool = False) -> str:
    """What recovery does with segments in order: continue, truncate or refuse."""
    for i, fault in enumerate(faults):
        if fault != "none":
            last = i == len(faults) - 1
            return "truncate" if unsafe or (last and fault == "torn") else "refuse"
    return "continue"


_SEGMENT = re.compile(r"([0-9]{16})\.log")
_SNAPSHOT = re.compile(r"([0-9]{16})\.snap")


def list_files(folder: str, pattern: re.Pattern = _SEGMENT) -> list[tuple[int, str]]:
    """(lsn, path) of segments or snapshots by lsn; other names are left out."""
    found = [(int(m[1]), os.path.join(folder, n)) for n in os.listdir(folder) if (m := pattern.fullmatch(n))]
    return sorted(found)


def encode_snapshot(entries: list[tuple[bytes, bytes, int]], last_lsn: int, created_at_ms: int = 0) -> bytes:
    head = _SNAP_HEAD.pack(SNAP_MAGIC, SNAP_VERSION, created_at_ms, last_lsn, 0)
    body = head + b"".join(_SNAP_ENTRY.pack(len(k), len(v), e) + k + v for k, v, e in entries)
    return body + _SNAP_FOOT.pack(SNAP_END, len(entries), crc32c(body))


def decode_snapshot(data: bytes) -> tuple[int, list[tuple[bytes, bytes, int]]]:
    """(last lsn, entries); the footer and the checksum of the whole file are looked at before any entry."""
    if len(data) < _SNAP_HEAD.size + _SNAP_FOOT.size:
        raise Torn("snapshot")
    end, count, crc = _SNAP_FOOT.unpack_from(data, len(data) - _SNAP_FOOT.size)
    if end != SNAP_END:
        raise Torn("snapshot footer")
    body = data[: -_SNAP_FOOT.size]
    if crc32c(body) != crc:
        raise Corrupt("checksum")
    magic, version, _, lsn, _ = _SNAP_HEAD.unpack_from(body)
    if magic != SNAP_MAGIC or version != SNAP_VERSION:
        raise Corrupt("snapshot header")
    out, at = [], _SNAP_HEAD.size
    while at < len(body):
        k, v, expire = _SNAP_ENTRY.unpack_from(body, at)
        at += _SNAP_ENTRY.size
        out.append((body[at : at + k], body[at + k : at + k + v], expire))
        at += k + v
    if at != len(body) or len(out) != count:
        raise Corrupt("entry count")
    return lsn, out


def newest_valid_snapshot(folder: str) -> tuple[int, list[tuple[bytes, bytes, int]]] | None:
    for _, path in reversed(list_files(folder, _SNAPSHOT)):
        with open(path, "rb") as f:
            try:
                return decode_snapshot(f.read())
            except ValueError:
                continue
    return None


def encode_frame(op: int, body: bytes, request_id: int = 0, flags: int = 0) -> bytes:
    return FRAME.pack(FRAME_MAGIC, FRAME_VERSION, op, flags, 0, request_id, len(body)) + body


def decode_frame(buf: bytes) -> tuple[int, int, int, bytes]:
    """(op, request id, flags, body); magic, version, flags, reserved byte and length are looked at in this order."""
    if len(buf) < FRAME.size:
        raise Torn("frame header")
    magic, version, op, flags, reserved, request_id, size = FRAME.unpack_from(buf)
    for bad, why in ((magic != FRAME_MAGIC, "magic"), (version != FRAME_VERSION, "version"), (flags & ~1, "flags"), (reserved, "reserved"), (size > MAX_FRAME, "length")):
        if bad:
            raise Corrupt(why)
    if len(buf) - FRAME.size < size:
        raise Torn("frame body")
    return op, request_id, flags, buf[FRAME.size : FRAME.size + size]


#: Fields of each operation's body: key and value carry their lengths, the others are fixed numbers.
_BODIES = {
    0x01: "", 0x02: "k", 0x03: "kvt", 0x04: "k", 0x05: "k", 0x06: "kt", 0x07: "", 0x08: "k", 0x09: "", 0x0A: "", 0x0B: "kl",
    0x10: "np", 0x11: "f", 0x12: "f", 0x13: "",
}
_NAMES = {"k": "key", "v": "value", "t": "ttl_ms", "l": "limit", "n": "node_id", "p": "node_port", "f": "from_lsn"}
_NUMBERS = {"t": "<Q", "l": "<I", "p": "<H", "f": "<Q"}


def encode_command(op: int, **fields) -> bytes:
    out = b""
    for f in _BODIES[op]:
        x = fields[_NAMES[f]]
        out += struct.pack(_NUMBERS[f], x) if f in _NUMBERS else struct.pack("<I" if f == "v" else "<H", len(x)) + x
    return out


def decode_command(op: int, body: bytes) -> dict:
    """Fields by name; all of the body must be used. KeyError for an operation that doesn't exist."""
    out, at = {}, 0
    for f in _BODIES[op]:
        kind = struct.Struct(_NUMBERS.get(f, "<I" if f == "v" else "<H"))
        if len(body) - at < kind.size:
            raise Corrupt("short body")
        (x,) = kind.unpack_from(body, at)
        at += kind.size
        if f not in _NUMBERS:
            if f == "v" and x > MAX_VALUE:
                raise Corrupt("value too long")
            if len(body) - at < x:
                raise Corrupt("short body")
            x, at = body[at : at + x], at + x
        out[_NAMES[f]] = x
    if at != len(body):
        raise Corrupt("bytes left over")
    return out


class _Segment(InputPartition):
    def __init__(self, path: str, first: int, lo: int):
        self.path, self.first, self.lo = path, first, lo


class LogReader(DataSourceReader):
    """Each segment is a partition, read in chunks; segments that end at or below the option `after_lsn` aren't opened."""

    def __init__(self, options: dict):
        self.folder, self.after, self.faults = options["path"], int(options.get("after_lsn", 0)), options.get("rows", "records") == "faults"

    def partitions(self) -> list[InputPartition]:
        files = list_files(self.folder)
        kept = [(lsn, path) for i, (lsn, path) in enumerate(files) if self.faults or i + 1 == len(files) or files[i + 1][0] > self.after + 1]
        return [_Segment(path, lsn, self.after) for lsn, path in kept] or [_Segment("", 0, 0)]

    def read(self, partition: _Segment) -> Iterator[tuple]:
        if not partition.path:
            return
        count = skipped = 0
        last = partition.first - 1
        with open(partition.path, "rb") as f:
            for records, fault, at in stream_segment(f):
                count += len(records)
                if self.faults:
                    skipped += sum(r.lsn <= partition.lo for r in records)
                    last = max([last, *(r.lsn for r in records)])
                    continue
                for r in records:
                    if r.lsn > partition.lo:
                        yield r.lsn, r.created_at_ms, r.rec_type, r.flags, r.key, r.value, r.expire_at_ms
        if self.faults:
            yield partition.first, count, fault, at, os.path.getsize(partition.path), skipped, last, partition.path


class _Files(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]], count: int = 0, size: int = 0, crc: int = 0):
        self.files, self.count, self.size, self.crc = files, count, size, crc


def _sync(f) -> None:
    f.flush()
    os.fsync(f.fileno())


class LogWriter(DataSourceWriter):
    """Segments of up to `segment_size` bytes from rows in the order of lsn; they get their names when all tasks have ended.

    A task that is run again writes files of its own, and those without a name are removed. Partitions must hold
    ranges of lsn (repartitionByRange and sortWithinPartitions); an existing segment's name is an error.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.limit, self.overwrite = options["path"], int(options.get("segment_size", 64 << 20)), overwrite

    def write(self, iterator) -> WriterCommitMessage:
        os.makedirs(self.folder, exist_ok=True)
        files, f, used, last = [], None, 0, -1
        for r in iterator:
            if r.lsn <= last:
                raise ValueError("rows must come in the order of lsn")
            raw, last = encode_record(Record(r.lsn, r.created_at_ms, r.rec_type, r.flags, bytes(r.key or b""), bytes(r.value or b""), r.expire_at_ms)), r.lsn
            if f is None or used + len(raw) > self.limit:
                if f is not None:
                    _sync(f)
                    f.close()
                name = os.path.join(self.folder, f"{r.lsn:016d}.log")
                files.append((f"{name}.{uuid.uuid4().hex}.tmp", name))
                f, used = open(files[-1][0], "wb"), 0  # noqa: SIM115
                used += f.write(segment_header(r.lsn))
            used += f.write(raw)
        if f is not None:
            _sync(f)
            f.close()
        return _Files(files)

    def commit(self, messages) -> None:
        files = [x for m in messages if m is not None for x in m.files]
        names = {name for _, name in files}
        old = [path for _, path in list_files(self.folder)] if os.path.isdir(self.folder) else []
        if len(names) < len(files) or not self.overwrite and names.intersection(old):
            self.abort(messages)
            raise FileExistsError("a segment begins at that lsn already")
        for tmp, name in files:
            os.replace(tmp, name)
        for path in old if self.overwrite else ():
            if path not in names:
                os.remove(path)

    def abort(self, messages) -> None:
        for m in messages:
            for tmp, _ in m.files if m is not None else ():
                if os.path.exists(tmp):
                    os.remove(tmp)


class LogSource(DataSource):
    """spark.read.format("keyed_log").load(folder); option rows=faults gives a row of health for each segment."""

    @classmethod
    def name(cls) -> str:
        return "keyed_log"

    def schema(self) -> str:
        if self.options.get("rows") == "faults":
            return "first_lsn long, records long, fault string, offset long, size long, skipped long, last_lsn long, path string"
        return "lsn long, created_at_ms long, rec_type string, flags int, key binary, value binary, expire_at_ms long"

    def reader(self, schema) -> DataSourceReader:
        return LogReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return LogWriter(self.options, overwrite)


class SnapshotReader(DataSourceReader):
    """The newest valid snapshot; rows=list gives a row for each snapshot instead, and each of those is a partition."""

    def __init__(self, options: dict):
        self.folder, self.list = options["path"], options.get("rows", "entries") == "list"

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for _, p in list_files(self.folder, _SNAPSHOT)] or [InputPartition("")] if self.list else [InputPartition(self.folder)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if self.list:
            if partition.value:
                with open(partition.value, "rb") as f:
                    data = f.read()
                try:
                    lsn, entries = decode_snapshot(data)
                    fault, count = "none", len(entries)
                except ValueError as e:
                    lsn, fault, count = int(os.path.basename(partition.value)[:16]), "torn" if isinstance(e, Torn) else "corrupt", 0
                yield lsn, count, len(data), fault, partition.value
            return
        found = newest_valid_snapshot(partition.value)
        if found is None:
            raise FileNotFoundError("no valid snapshot")
        for key, value, expire in found[1]:
            yield key, value, expire, found[0]


class SnapshotWriter(DataSourceWriter):
    """One snapshot from rows (key, value, expire_at_ms), with the options last_lsn, created_at_ms and keep.

    Tasks write the entries of their partitions; the commit puts them together behind the header, joins their
    checksums, gives the file its name and removes all but the newest `keep` snapshots (2; 0 keeps all).
    """

    def __init__(self, options: dict):
        self.folder, self.lsn, self.keep = options["path"], int(options["last_lsn"]), int(options.get("keep", 2))
        self.created = int(options.get("created_at_ms", 0))

    def write(self, iterator) -> WriterCommitMessage:
        os.makedirs(self.folder, exist_ok=True)
        part = os.path.join(self.folder, f"part.{uuid.uuid4().hex}.tmp")
        count = size = crc = 0
        with open(part, "wb") as f:
            held: list[bytes] = []
            for r in iterator:
                key, value = bytes(r.key), bytes(r.value or b"")
                held += [_SNAP_ENTRY.pack(len(key), len(value), r.expire_at_ms), key, value]
                count += 1
                if len(held) >= 30_000:
                    size, crc = size + f.write(block := b"".join(held)), crc32c(block, crc)
                    held = []
            size, crc = size + f.write(block := b"".join(held)), crc32c(block, crc)
            _sync(f)
        return _Files([(part, "")], count, size, crc)

    def commit(self, messages) -> None:
        done = [m for m in messages if m is not None]
        head = _SNAP_HEAD.pack(SNAP_MAGIC, SNAP_VERSION, self.created, self.lsn, 0)
        crc = crc32c(head)
        name = os.path.join(self.folder, f"{self.lsn:016d}.snap")
        with open(f"{name}.tmp", "wb") as out:
            out.write(head)
            for m in done:
                crc = crc32c_join(crc, m.crc, m.size)
                with open(m.files[0][0], "rb") as f:
                    shutil.copyfileobj(f, out, 1 << 20)
            out.write(_SNAP_FOOT.pack(SNAP_END, sum(m.count for m in done), crc))
            _sync(out)
        os.replace(f"{name}.tmp", name)
        self.abort(messages)
        for _, path in list_files(self.folder, _SNAPSHOT)[: -self.keep] if self.keep else ():
            os.remove(path)

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.files[0][0]):
                os.remove(m.files[0][0])


class SnapshotSource(DataSource):
    """spark.read.format("keyed_snapshot").load(folder): the newest valid snapshot, checked as a whole first.

    rows=list lists all of them. df.write.format("keyed_snapshot").option("last_lsn", n) writes one.
    """

    @classmethod
    def name(cls) -> str:
        return "keyed_snapshot"

    def schema(self) -> str:
        if self.options.get("rows") == "list":
            return "last_included_lsn long, entries long, size long, fault string, path string"
        return "key binary, value binary, expire_at_ms long, last_included_lsn long"

    def reader(self, schema) -> DataSourceReader:
        return SnapshotReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return SnapshotWriter(self.options)


def register(spark) -> None:
    spark.dataSource.register(LogSource)
    spark.dataSource.register(SnapshotSource)


#: Words of the text protocol, and the least and the most arguments that they take (None: any number).
TEXT_COMMANDS = {
    "PING": (0, None), "GET": (1, 1), "SET": (2, 3), "DEL": (1, 1), "DELETE": (1, 1), "EXISTS": (1, 1), "EXPIRE": (2, 2), "TTL": (1, 1),
    "KEYS": (0, None), "STATS": (0, None), "SNAPSHOT": (0, None), "HELP": (0, None), "QUIT": (0, None), "EXIT": (0, None),
}


def parse_text(lines):
    """line(text string) -> op, key, arg, ttl_ms, status: tokens between blanks, the command in any case; DEL and QUIT by either word.

    A ttl is the third argument of SET or the second of EXPIRE, a whole number below 2^64 (null if beyond 2^63).
    """
    from pyspark.sql import functions as F

    tokens = F.filter(F.split(F.col("line"), r"\s+"), lambda t: t != "")
    word = F.upper(F.try_element_at(F.col("t"), F.lit(1)))
    low = F.create_map(*[F.lit(x) for k, (a, _) in TEXT_COMMANDS.items() for x in (k, a)])
    high = F.create_map(*[F.lit(x) for k, (_, b) in TEXT_COMMANDS.items() for x in (k, 1 << 30 if b is None else b)])
    t = lines.withColumn("t", tokens).withColumn("word", word).withColumn("n", F.size("t") - 1)
    op = F.when(F.col("word") == "DEL", "DELETE").when(F.col("word") == "EXIT", "QUIT").otherwise(F.col("word"))
    given = F.when(op == "EXPIRE", F.try_element_at("t", F.lit(3))).when(op == "SET", F.try_element_at("t", F.lit(4)))
    number = given.rlike("^[0-9]+$") & (given.try_cast("decimal(38,0)") < F.lit(str(2**64)).cast("decimal(38,0)"))
    status = (
        F.when(F.col("word").isNull(), "EMPTY").when(low[F.col("word")].isNull(), "UNKNOWN")
        .when(~F.col("n").between(low[F.col("word")], high[F.col("word")]), "ARGUMENTS").when(given.isNotNull() & ~F.coalesce(number, F.lit(False)), "BAD_TTL").otherwise("OK")
    )
    ttl = F.when(number, given.try_cast("long")).alias("ttl_ms")
    return t.select("line", op.alias("op"), F.try_element_at("t", F.lit(2)).alias("key"), F.try_element_at("t", F.lit(3)).alias("arg"), ttl, status.alias("status"))
