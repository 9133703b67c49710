"""DuckDB SQL shared by the oracles: the adapters and the fold as common table expressions."""

from __future__ import annotations

LOG = """log AS (
  SELECT event_id + 1 AS lsn, (epoch_us(ts) // 1000) AS tm, printf('user:%06d', user_id) AS key,
    CASE event_type WHEN 'error' THEN 'DEL' WHEN 'signup' THEN 'EXPIRE' ELSE 'SET' END AS rec_type,
    CASE WHEN event_type NOT IN ('error', 'signup') THEN props END AS value,
    CASE event_type WHEN 'click' THEN (epoch_us(ts) // 1000) + 21600000 WHEN 'signup' THEN (epoch_us(ts) // 1000) + 43200000 ELSE 0 END AS expire_at
  FROM events)"""


def fold(source: str = "log", tag: str = "") -> str:
    """CTEs e, f, g and kv (with tag) over source(lsn, at, key, rec_type, value, expire_at)."""
    t = tag
    return f"""e{t} AS (SELECT *, sum((rec_type IN ('SET', 'DEL'))::INT) OVER (PARTITION BY key ORDER BY lsn) AS ep FROM {source}),
f{t} AS (SELECT *, first_value(rec_type) OVER w AS lead_type, lag(expire_at) OVER w AS pd
       FROM e{t} WINDOW w AS (PARTITION BY key, ep ORDER BY lsn)),
g{t} AS (SELECT *, coalesce(max((rec_type = 'EXPIRE' AND pd <> 0 AND pd <= tm)::INT) OVER (PARTITION BY key, ep ORDER BY lsn), 0) AS dead FROM f{t}),
s{t} AS (SELECT key, arg_max(lead_type, lsn) AS lead_type, arg_max(expire_at, lsn) AS expire_at, arg_max(dead, lsn) AS dead,
         max(lsn) AS last_lsn, arg_max(value, lsn) FILTER (rec_type = 'SET') AS value FROM g{t} GROUP BY key),
kv{t} AS (SELECT key, value, expire_at, last_lsn FROM s{t} WHERE lead_type = 'SET' AND dead = 0)"""


def log(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([LOG, *ctes]) + "\n" + body


NOW = "(SELECT max(tm) FROM log)"
LIVE = f"live AS (SELECT * FROM kv WHERE expire_at = 0 OR expire_at > {NOW})"


def live(body: str, *ctes: str) -> str:
    return log(body, fold(), LIVE, *ctes)


ORDERS = """kv AS (
  SELECT printf('order:%09d', o_orderkey) AS key, o_orderstatus || '|' || o_orderpriority AS value,
    CASE WHEN o_orderkey % 3 = 0 THEN epoch_ms(o_orderdate) + 2592000000 ELSE 0 END AS expire_at, epoch_ms(o_orderdate) AS access,
    strlen(printf('order:%09d', o_orderkey)) + strlen(o_orderstatus || '|' || o_orderpriority) + 160 AS cost, o_custkey FROM (SELECT * FROM orders))"""


def orders(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([ORDERS, *ctes]) + "\n" + body


NS = """lat AS (SELECT event_id, event_id % 8 AS worker, round(value * 1000000)::BIGINT AS ns FROM events),
b AS (SELECT *, CASE WHEN ns < 64 THEN ns ELSE (length(bin(ns)) - 7 + 1) * 64 + ((ns >> (length(bin(ns)) - 7)) & 63) END::INT AS bucket FROM lat),
h AS (SELECT bucket, count(*) AS count FROM b GROUP BY 1),
v AS (SELECT *, CASE WHEN bucket < 64 THEN bucket ELSE (bucket % 64 + 64)::BIGINT << (bucket // 64 - 1) END::BIGINT AS low FROM h)"""


def latency(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([NS, *ctes]) + "\n" + body


COMMANDS = """cmd AS (
  SELECT event_id + 1 AS lsn, (epoch_us(ts) // 1000) AS tm, printf('user:%06d', user_id) AS key,
    CASE event_type WHEN 'view' THEN 'GET' WHEN 'click' THEN 'SET' WHEN 'purchase' THEN 'TTL' WHEN 'error' THEN 'DELETE' ELSE 'EXPIRE' END AS op,
    CASE WHEN event_type = 'click' THEN props END AS value,
    CASE event_type WHEN 'click' THEN (epoch_us(ts) // 1000) + 21600000 WHEN 'signup' THEN (epoch_us(ts) // 1000) + 43200000 WHEN 'error' THEN 0 END AS expire_at FROM events),
e AS (SELECT *, sum((op IN ('SET', 'DELETE'))::INT) OVER (PARTITION BY key ORDER BY lsn) AS ep FROM cmd),
f AS (SELECT *, first_value(op) OVER w AS lead_type,
        last_value(expire_at IGNORE NULLS) OVER (PARTITION BY key, ep ORDER BY lsn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pd
      FROM e WINDOW w AS (PARTITION BY key, ep ORDER BY lsn)),
g AS (SELECT *, coalesce(max((op = 'EXPIRE' AND pd <> 0 AND pd <= tm)::INT) OVER (PARTITION BY key, ep ORDER BY lsn), 0) AS dead FROM f),
p AS (SELECT *, lag(lead_type) OVER k AS p_lead, lag(dead) OVER k AS p_dead,
        last_value(expire_at IGNORE NULLS) OVER (PARTITION BY key ORDER BY lsn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS d,
        last_value(CASE WHEN op = 'SET' THEN value END IGNORE NULLS) OVER (PARTITION BY key ORDER BY lsn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS v
      FROM g WINDOW k AS (PARTITION BY key ORDER BY lsn)),
r AS (SELECT *, coalesce(p_lead = 'SET' AND p_dead = 0 AND (d = 0 OR d > tm), FALSE) AS live FROM p)"""


M64 = "18446744073709551616::UHUGEINT"
# Fixed values of the hash: its five primes.
PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)


def _mul(a: str, b: str) -> str:
    return f"((({a})::UHUGEINT * ({b})::UHUGEINT) % {M64})"


def _add(a: str, b: str) -> str:
    return f"((({a})::UHUGEINT + ({b})::UHUGEINT) % {M64})"


def _rot(a: str, r: int) -> str:
    return f"({_mul(a, str(1 << r))} + (({a})::UHUGEINT // {1 << (64 - r)}::UHUGEINT))"


def xxhash(source: str, out: str, text: str, size: int, seed: int = 42) -> str:
    """A CTE chain ending in out: source with column h, the 64-bit hash of an ASCII text of size < 32 bytes, by its definition.

    Numbers are 128 bits wide, so a product is exact and is reduced modulo 2^64.
    """
    p1, p2, p3, p4, p5 = PRIMES
    ctes, n, at = [f"{out}0 AS (SELECT *, ({(seed + p5 + size) % (1 << 64)})::UHUGEINT AS h FROM {source})"], 0, 0

    def step(expression: str) -> None:
        nonlocal n
        ctes.append(f"{out}{n + 1} AS (SELECT * REPLACE ({expression} AS h) FROM {out}{n})")
        n += 1

    def word(width: int) -> str:
        return " + ".join(f"ascii(substr({text}, {at + i + 1}, 1))::UHUGEINT * {1 << 8 * i}::UHUGEINT" for i in range(width))

    while size - at >= 8:
        step(f"xor(h, {_mul(_rot(_mul(word(8), str(p2)), 31), str(p1))})")
        step(_add(_mul(_rot("h", 27), str(p1)), str(p4)))
        at += 8
    if size - at >= 4:
        step(f"xor(h, {_mul(word(4), str(p1))})")
        step(_add(_mul(_rot("h", 23), str(p2)), str(p3)))
        at += 4
    while at < size:
        step(f"xor(h, {_mul(word(1), str(p5))})")
        step(_mul(_rot("h", 11), str(p1)))
        at += 1
    for shift, prime in ((33, p2), (29, p3), (32, None)):
        step(f"xor(h, h // {1 << shift}::UHUGEINT)")
        if prime:
            step(_mul("h", str(prime)))
    ctes.append(f"{out} AS (SELECT * FROM {out}{n})")
    return ",\n".join(ctes)
