"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the wire protocol: operation and status codes.
OPCODES = {
    "PING": 0x01, "GET": 0x02, "SET": 0x03, "DELETE": 0x04, "EXISTS": 0x05, "EXPIRE": 0x06, "STATS": 0x07, "TTL": 0x08,
    "FLUSH": 0x09, "SNAPSHOT": 0x0A, "KEYS": 0x0B, "REPLCONF": 0x10, "SYNC": 0x11, "REPLACK": 0x12, "PROMOTE": 0x13,
}
STATUSES = {
    "OK": 0x00, "NOT_FOUND": 0x01, "BAD_REQUEST": 0x02, "TOO_LARGE": 0x03, "OOM": 0x04, "INTERNAL": 0x05, "READ_ONLY": 0x06,
    "NOT_LEADER": 0x07, "PROTOCOL_ERROR": 0x80,
}
UNITS = (("TiB", 40), ("GiB", 30), ("MiB", 20), ("KiB", 10))


def _places(n: Column, unit: int, places: int, even: bool) -> Column:
    """n / unit with so many places, in whole numbers: exact, with ties to the even digit or up."""
    rest = F.abs(n) % unit
    whole = ((F.abs(n) - rest) / unit).cast("long")
    scaled = rest * 10**places
    low, over = F.floor(scaled / unit), scaled % unit
    up = (over * 2 > unit) | ((over * 2 == unit) & ((low % 2 == 1) if even else F.lit(True)))
    digits = whole * 10**places + low + up.cast("long")
    sign = F.when(n < 0, "-").otherwise("")
    return F.concat(sign, F.floor(digits / 10**places).cast("string"), F.lit("."), F.lpad((digits % 10**places).cast("string"), places, "0"))


def places(n: Column, unit: int, digits: int) -> Column:
    """n / unit with so many decimals, ties up."""
    return _places(n, unit, digits, False)


def format_bytes(n: Column) -> Column:
    """1536 -> 1.50KiB; below 1024 without decimals; ties go to the even digit."""
    out = F.when(F.lit(False), "")
    for unit, shift in UNITS:
        out = out.when(F.abs(n) >= 1 << shift, F.concat(_places(n, 1 << shift, 2, True), F.lit(unit)))
    return out.otherwise(F.concat(n.cast("string"), F.lit("B")))


def parse_bytes(s: Column) -> Column:
    """'1.5MB' -> 1572864; units are powers of 1024 in any case; null if it isn't a size."""
    t = F.upper(F.trim(s))
    number = F.regexp_extract(t, r"^([-+]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+))\s*(B|KB|KIB|K|MB|MIB|M|GB|GIB|G|TB|TIB|T)?$", 1)
    unit = F.substring(F.regexp_extract(t, r"([KMGT]?)(?:IB|B)?$", 1), 1, 1)
    scale = F.when(unit == "K", 1 << 10).when(unit == "M", 1 << 20).when(unit == "G", 1 << 30).when(unit == "T", 1 << 40).otherwise(F.lit(1))
    return F.when(number != "", (number.cast("double") * scale).cast("long"))


def printable(b: Column, limit: int) -> Column:
    """ASCII text with other bytes as \\x and hexadecimal digits; limit characters or more are cut and end in three dots."""
    # Each byte gives a character at least, so what follows limit bytes can't be seen.
    hexed = F.hex(F.substring(b, 1, limit))
    codes = F.transform(F.sequence(F.lit(1), F.length(hexed), F.lit(2)), lambda i: F.conv(F.substr(hexed, i.cast("int"), F.lit(2)), 16, 10).cast("int"))
    chars = F.transform(codes, lambda c: F.when((c >= 32) & (c < 127), F.char(c)).otherwise(F.concat(F.lit("\\x"), F.lower(F.hex(c)))))
    text = F.when(F.length(hexed) == 0, "").otherwise(F.array_join(chars, ""))
    return F.when(F.length(text) >= limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def ms_time(ms: Column) -> Column:
    """Time of milliseconds since 1970 in the session's zone; - for 0."""
    return F.when(ms == 0, "-").otherwise(F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS"))


def format_duration(ns: Column) -> Column:
    """Nanoseconds as ns, us with one place, ms or s with two; ties go up."""
    out = F.when(ns < 1_000, F.concat(ns.cast("string"), F.lit("ns")))
    out = out.when(ns < 1_000_000, F.concat(_places(ns, 10**3, 1, False), F.lit("us")))
    out = out.when(ns < 1_000_000_000, F.concat(_places(ns, 10**6, 2, False), F.lit("ms")))
    return out.otherwise(F.concat(_places(ns, 10**9, 2, False), F.lit("s")))


def segment_name(lsn: Column, suffix: str = ".log") -> Column:
    return F.concat(F.lpad(lsn.cast("string"), 16, "0"), F.lit(suffix))


def parse_segment_name(name: Column) -> Column:
    """The lsn of a name of exactly sixteen digits and .log, else null."""
    digits = F.regexp_extract(name, r"^([0-9]{16})\.log$", 1)
    return F.when(digits != "", digits.cast("long"))


def opcode(name: Column) -> Column:
    """Its number, whatever the case; null if there is none."""
    return F.create_map(*[F.lit(x) for kv in OPCODES.items() for x in kv])[F.upper(name)]


def opcode_name(code: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for k, v in OPCODES.items() for x in (v, k)])[code], F.lit("UNKNOWN"))


def status(name: Column) -> Column:
    """Its number, whatever the case; null if there is none."""
    return F.create_map(*[F.lit(x) for kv in STATUSES.items() for x in kv])[F.upper(name)]


def status_name(code: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for k, v in STATUSES.items() for x in (v, k)])[code], F.lit("UNKNOWN"))


def fatal_status(code: Column) -> Column:
    """Whether a status ends its connection."""
    return code >= 0x80


def next_power_of_two(n: Column) -> Column:
    """Smallest power of two that is n or more; 1 for less than 2."""
    return F.when(n <= 1, F.lit(1)).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(n - 1)).cast("int"))).cast("long")


def wheel_tick(ms: Column, epoch: int, tick: int) -> Column:
    return F.floor((ms - epoch) / tick).cast("long")


def wheel_level(delta: Column, levels: int = 5) -> Column:
    """The lowest level whose span of 256^(level + 1) ticks holds delta; levels for an overflow."""
    out = F.when(F.lit(False), 0)
    for level in range(levels):
        out = out.when(delta < 256 ** (level + 1), level)
    return out.otherwise(levels).cast("int")


def wheel_slot(target: Column, level: int) -> Column:
    return F.call_function("shiftright", target, F.lit(8 * level)).bitwiseAND(F.lit(255)).cast("int")


def workload_reads(w: Column) -> Column:
    """Share of reads of 'get' or 'read', 'set' or 'write', or 'reads/writes'; null for others."""
    t = F.lower(F.trim(w))
    reads, writes = F.regexp_extract(t, r"^([0-9]+)/([0-9]+)$", 1).try_cast("double"), F.regexp_extract(t, r"^([0-9]+)/([0-9]+)$", 2).try_cast("double")
    return F.when(t.isin("get", "read"), 1.0).when(t.isin("set", "write"), 0.0).when(reads + writes > 0, reads / (reads + writes))


def env_name(flag: Column) -> Column:
    return F.concat(F.lit("KV_"), F.upper(F.translate(flag, "-", "_")))
