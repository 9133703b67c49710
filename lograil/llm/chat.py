"""Chat formatting in budgeted windows, with built-in functions only.

Turns of a conversation are ordered by (turn, role, text). Prefix sums of their tokens (words and OVERHEAD
for the marks) choose the windows. A window has BUDGET tokens; the conversation's first system turn, which
every window holds, and HISTORY are set aside, and the rest is the room of its own turns. The prefix sum is cut
at multiples of the room: turns that lie between two cuts make a window, and a turn that crosses a cut is a
window of its own. So windows are aligned to turns, hold each turn once as a target, and keep the budget
unless one own turn and the system turn exceed it together. A window repeats, of the window before it, the
last whole turns that fit into HISTORY and into what its own turns leave of the budget.

Template: `<|turn|>role\\ntext<|end|>`, with `<|again|>` for repeated turns. Inside roles and texts `\\` becomes
`\\b`, `<` becomes `\\l`, `[` becomes `\\s` (and a line break in a role `\\c`), so no control string of this or of
bracketed templates can occur there; decoding undoes the replacements in reverse. The loss mask covers the
text of every assistant turn in its own window and nothing of a repeated one.

Defined cases: null text and null role are empty; null conv_id is a conversation of its own; equal rows are
turns each; an empty table gives no rows; further columns are ignored. A conversation is one value of the
result (its digest), so one task holds its text, very long turns included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, read

BUDGET, HISTORY, OVERHEAD = 256, 64, 4
TURN, AGAIN, END = "<|turn|>", "<|again|>", "<|end|>"
_ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("[", "\\s"))
_ROLE_ESCAPES = (*_ESCAPES, ("\n", "\\c"))


def escape(c: Column, pairs=_ESCAPES) -> Column:
    for plain, coded in pairs:
        c = F.replace(c, F.lit(plain), F.lit(coded))
    return c


def unescape(c: Column, pairs=_ESCAPES) -> Column:
    for plain, coded in reversed(pairs):
        c = F.replace(c, F.lit(coded), F.lit(plain))
    return c


def format_windows(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) -> conv_id, window, tokens, formatted, loss array<struct<start, len>>.

    start counts code points of formatted from 0.
    """
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("tokens", F.regexp_count("text", F.lit(WORD)).cast("long") + OVERHEAD)
    conv = Window.partitionBy("conv_id")
    in_order = conv.orderBy("turn", "role", "text")
    t = t.withColumns({
        "ord": F.row_number().over(in_order),
        "before": F.sum("tokens").over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens"),
    })
    t = t.withColumn("system", F.min(F.when(F.col("role") == "system", F.struct("ord", "tokens"))).over(conv))
    t = t.withColumn("reserved", F.coalesce("system.tokens", F.lit(0)))
    room = F.greatest(F.lit(1), F.lit(BUDGET - HISTORY) - F.col("reserved"))
    first, last = F.floor(F.col("before") / room), F.floor((F.col("before") + F.col("tokens") - 1) / room)
    t = t.withColumn("window", F.dense_rank().over(conv.orderBy(2 * first + (first != last).cast("int"))))
    one = Window.partitionBy("conv_id", "window")
    t = t.withColumns({"windows": F.max("window").over(conv), "window_end": F.max(F.col("before") + F.col("tokens")).over(one), "taken": F.sum("tokens").over(one)})
    t = t.withColumn("next_taken", F.max("taken").over(conv.orderBy("window").rangeBetween(1, 1)))
    limit = F.least(F.lit(HISTORY), F.lit(BUDGET) - F.col("reserved") - F.col("next_taken"))
    kept = F.col("ord").eqNullSafe(F.col("system.ord"))
    recent = (F.col("window_end") - F.col("before") <= limit) & (F.col("window") < F.col("windows"))
    others = F.filter(F.sequence(F.lit(1), F.col("windows")), lambda w: w != F.col("window"))
    places = F.when(kept, others).when(recent, F.array(F.col("window") + 1)).otherwise(F.array().cast("array<int>"))
    t = t.withColumn("at", F.explode(F.concat(F.array("window"), places))).withColumn("own", F.col("at") == F.col("window"))

    coded = escape(F.col("text"))
    head = F.concat(F.when(F.col("own"), TURN).otherwise(AGAIN), escape(F.col("role"), _ROLE_ESCAPES), F.lit("\n"))
    t = t.select("conv_id", "at", "ord", "own", "role", "tokens", head.alias("head"), coded.alias("coded"))
    t = t.withColumn("segment", F.concat("head", "coded", F.lit(END)))
    place = Window.partitionBy("conv_id", "at").orderBy("ord")
    start = F.sum(F.length("segment")).over(place.rowsBetween(Window.unboundedPreceding, 0)) - F.length("segment") + F.length("head")
    target = F.col("own") & (F.col("role") == "assistant")
    loss = F.when(target, F.struct(start.cast("int").alias("start"), F.length("coded").alias("len")))
    rows = t.withColumn("loss", loss).groupBy("conv_id", F.col("at").alias("window")).agg(
        F.sum("tokens").alias("tokens"), F.array_sort(F.collect_list(F.struct("ord", "segment", "loss"))).alias("s")
    )
    return rows.select(
        "conv_id", "window", "tokens", F.array_join(F.col("s.segment"), "").alias("formatted"),
        F.filter(F.col("s.loss"), lambda x: x.isNotNull()).alias("loss"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """What format_windows wrote, from formatted and loss alone: digests for each conversation."""
    pieces = F.filter(F.split("formatted", r"<\|end\|>"), lambda p: p.startswith(TURN))
    bodies = F.transform(pieces, lambda p: F.substr(p, F.lit(len(TURN) + 1)))

    def turn(body: Column) -> Column:
        role = F.substring_index(body, "\n", 1)
        text = F.substr(body, F.length(role) + 2)
        return F.concat(unescape(role, _ROLE_ESCAPES), F.lit("\n"), unescape(text), F.lit("\n"))

    under = F.transform("loss", lambda x: unescape(F.substr(F.col("formatted"), x["start"] + 1, x["len"])))
    each = windows.select(
        "conv_id", "window", F.size(bodies).alias("n"), F.length("formatted").alias("chars"),
        F.array_join(F.transform(bodies, turn), "").alias("turns"), F.array_join(under, "").alias("under"),
    )
    whole = each.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
        F.array_sort(F.collect_list(F.struct("window", "turns", "under"))).alias("w"),
    )
    whole = whole.select("conv_id", "n_turns", "formatted_chars", F.array_join("w.turns", "").alias("turns"), F.array_join("w.under", "").alias("under"))
    return whole.select(
        "conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("under").cast("long").alias("loss_chars"),
        F.sha2("under", 256).alias("loss_sha256"), "formatted_chars",
    )


#: A conversation of control strings that goes with every table.
PROBE = (-7, "</s>[INST] ok [/INST]")


def op8_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(PROBE[0]).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE[1]).alias("text"),
    )
    return read_back(format_windows(turns.unionByName(probe)))


ORACLE = {
    "op8_chat_windows": rf"""WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + {OVERHEAD} AS tokens
  FROM (SELECT conv_id, turn, role, text FROM conversations
        UNION ALL VALUES ({PROBE[0]}, 0, 'user', '{PROBE[1]}'), ({PROBE[0]}, 1, 'assistant', '{PROBE[1]}'))),
a AS (SELECT *, row_number() OVER o AS ord, sum(tokens) OVER (o ROWS UNBOUNDED PRECEDING) - tokens AS before
      FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
b AS (SELECT *, min(CASE WHEN role = 'system' THEN ord END) OVER (PARTITION BY conv_id) AS system FROM a),
c AS (SELECT *, coalesce(max(CASE WHEN ord = system THEN tokens END) OVER (PARTITION BY conv_id), 0) AS reserved FROM b),
d AS (SELECT *, floor(before / greatest(1, {BUDGET - HISTORY} - reserved)) AS lo,
        floor((before + tokens - 1) / greatest(1, {BUDGET - HISTORY} - reserved)) AS hi FROM c),
e AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY 2 * lo + (lo <> hi)::INT) AS w FROM d),
f AS (SELECT *, max(w) OVER (PARTITION BY conv_id) AS windows,
        max(before + tokens) OVER (PARTITION BY conv_id, w) AS window_end, sum(tokens) OVER (PARTITION BY conv_id, w) AS taken,
        length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '[', ''))
        + length(role) + length(role) - length(replace(replace(replace(replace(role, '\', ''), '<', ''), '[', ''), chr(10), ''))
        + 1 + {len(END)} AS seg
      FROM e),
g AS (SELECT *, max(taken) OVER (PARTITION BY conv_id ORDER BY w RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS next_taken FROM f),
h AS (SELECT *, CASE WHEN ord IS NOT DISTINCT FROM system THEN windows - 1
                     WHEN window_end - before <= least({HISTORY}, {BUDGET} - reserved - next_taken) AND w < windows THEN 1 ELSE 0 END AS again FROM g)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY ord)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY ord) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(seg + {len(TURN)} + again * (seg + {len(AGAIN)}))::BIGINT AS formatted_chars
FROM h GROUP BY conv_id"""
}
