"""Mixing sources to target weights, with built-in functions only.

A document's size is its number of words. Each source has a weight and a target share of all sizes; a
target stops at MAX_EPOCHS times its source's size and the excess goes to the others by weight. Every
document is taken floor(target / source size) times, and once more if its hash lies under the source's
threshold. The threshold comes from histograms: tokens are summed by source and hash bucket, the running
sum finds the bucket in which the budget ends, and only that bucket is split again by the next hash digits.
Nothing is sorted but the histograms (BUCKETS rows for each source). Hashes are of doc_id alone, so
reruns agree.

Defined cases: null text has size 0; null source is a source of its own and comes last; a null doc_id
hashes as the empty string; rows with equal doc_id are taken alike; sources of size 0 get target 0; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed, read

WEIGHTS, MAX_EPOCHS = (1, 2, 3), 3
#: Hash digits (hexadecimal) that each level of the histogram looks at: 4096, 4096 and 4096 buckets.
DIGITS, LEVELS = 3, 3


#: Up to so many sources their table is broadcast; beyond, the join is shuffled and AQE splits hot sources.
BROADCAST_SOURCES = 20_000


def _digits(level: int) -> Column:
    at = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1 + DIGITS * level, DIGITS)
    return F.conv(at, 16, 10).cast("long")


def source_targets(sources: DataFrame) -> DataFrame:
    """sources(key, source_size) -> key, source_size, target.

    Sources reach their cap in the order of cap / weight. Running sums in that order give the level at
    which the rest is shared; a source is capped while its ratio is below that level. The table has a row
    for each source, so one task holds it.
    """
    everything = Window.partitionBy(F.lit(0))
    place = F.row_number().over(everything.orderBy("key")) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int")).cast("double")
    w = sources.withColumn("weight", weight).withColumn("cap", float(MAX_EPOCHS) * F.col("source_size"))
    w = w.withColumn("ratio", F.col("cap") / F.col("weight"))
    earlier = everything.orderBy("ratio", "key").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))
    rest = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))
    w = w.withColumn("level", left / rest)
    # Once a source isn't capped no later one is, so the first uncapped one's level holds for all of these.
    first = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "key", "level"))).over(everything)
    level = first["level"]
    capped = level.isNull() | (F.col("ratio") < F.col("level"))
    return w.select("key", "source_size", F.when(capped, F.col("cap")).otherwise(level * F.col("weight")).alias("target"))


def _with_source(rows: DataFrame, small: DataFrame) -> DataFrame:
    """Adds the columns of small, which has one row for each key."""
    return rows.join(F.broadcast(small) if small.count() <= BROADCAST_SOURCES else small, "key")


def _key():
    return F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), "source"))


def sizes(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, source) -> doc_id, source, key, size; texts are read once, for all that follows."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return checkpointed(docs.select("doc_id", "source", _key().alias("key"), size.alias("size")))


def mixing_plan(light: DataFrame) -> DataFrame:
    """sizes() -> key, source_size, target, base, the thresholds t0 .. and what of the budget is left at the last."""
    plan = source_targets(light.groupBy("key").agg(F.sum("size").alias("source_size")))
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    cuts = plan.withColumn("base", base).withColumn("left", F.col("target") - F.col("base") * F.col("source_size"))
    cuts = checkpointed(cuts)

    # Level by level, t0, t1, ... are the digits at which the budget ends; left is what of it is still open.
    rows = light
    for level in range(LEVELS):
        rows = rows.withColumn("d", _digits(level))
        histogram = rows.groupBy("key", "d").agg(F.sum("size").alias("tokens"))
        upto = F.sum("tokens").over(Window.partitionBy("key").orderBy("d"))
        over = F.col("upto") > F.col("left")
        found = (
            histogram.withColumn("upto", upto)
            .join(cuts.select("key", "left"), "key")
            .groupBy("key")
            .agg(
                F.min(F.when(over, F.col("d"))).alias(f"t{level}"),
                F.min(F.when(over, F.struct("d", "tokens")))["tokens"].alias("edge"),
                F.coalesce(F.max(F.when(~over, F.col("upto"))), F.lit(0)).alias("spent"),
            )
        )
        cuts = cuts.drop("edge").join(found, "key", "left")
        cuts = checkpointed(cuts.withColumn("left", F.col("left") - F.coalesce("spent", F.lit(0))).drop("spent"))
        if level + 1 < LEVELS:
            boundary = cuts.select("key", F.col(f"t{level}").alias("d"))
            rows = rows.join(F.broadcast(boundary) if boundary.count() <= BROADCAST_SOURCES else boundary, ["key", "d"]).drop("d")

    return cuts


def copies() -> Column:
    """How often a row with doc_id and its source's plan is taken."""
    extra = F.col("edge") - F.col("left") < F.col("left")  # the last bucket, about one document, goes to the nearer side
    for level in reversed(range(LEVELS)):
        t, d = F.col(f"t{level}"), _digits(level)
        extra = t.isNull() | (d < t) | ((d == t) & F.coalesce(extra, F.lit(False)))
    none = F.col("base") * F.col("source_size") >= F.col("target")
    return (F.col("base") + F.when(none, 0).otherwise(extra.cast("int"))).cast("long")


def mix_to_weights(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, source) -> doc_id, size, source, source_size, target, copies, taken."""
    light = sizes(docs)
    rows = _with_source(light, mixing_plan(light)).withColumn("copies", copies())
    return rows.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    kept = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", _key().alias("key"))
    rows = _with_source(kept, mixing_plan(sizes(docs))).withColumn("copies", copies())
    return rows.withColumn("_", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row.*")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_to_weights(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def oracle_over(documents: str) -> str:
    """DuckDB SQL for op3's rows over the given relation."""
    levels = LEVELS
    digit = lambda i: f"('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), {1 + DIGITS * i}, {DIGITS}))::BIGINT"
    sql = f"""WITH RECURSIVE d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         {", ".join(f"{digit(i)} AS d{i}" for i in range(levels))}
  FROM {documents}),
s AS (SELECT key, sum(size)::BIGINT AS source_size FROM d GROUP BY key),
w AS (SELECT *, 3.0::DOUBLE * source_size AS cap, (1 + (row_number() OVER (ORDER BY key) - 1) % 3)::DOUBLE AS weight FROM s),
l AS (SELECT *, cap / weight AS ratio,
        (sum(source_size) OVER () - coalesce(sum(cap) OVER e, 0))
        / (sum(weight) OVER () - coalesce(sum(weight) OVER e, 0)) AS level
      FROM w WINDOW e AS (ORDER BY cap / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, (ratio, key)) AS level FROM l WHERE ratio >= level),
p AS (SELECT key, source_size,
        CASE WHEN f.level IS NULL OR ratio < l.level THEN cap ELSE f.level * weight END AS target FROM l, f),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS base FROM p),
c0 AS (SELECT *, target - base * source_size AS left0 FROM b)"""
    for i in range(levels):
        same = "".join(f" AND d.d{j} = c.t{j}" for j in range(i))
        sql += f""",
h{i} AS (SELECT d.key, d{i} AS x, sum(size)::BIGINT AS tokens FROM d JOIN c{i} c ON d.key = c.key{same} GROUP BY 1, 2),
u{i} AS (SELECT *, sum(tokens) OVER (PARTITION BY key ORDER BY x) AS upto FROM h{i}),
g{i} AS (SELECT u.key, min(CASE WHEN upto > left{i} THEN x END) AS t{i},
           arg_min(CASE WHEN upto > left{i} THEN tokens END, CASE WHEN upto > left{i} THEN x END) AS edge{i},
           coalesce(max(CASE WHEN upto <= left{i} THEN upto END), 0) AS spent{i}
         FROM u{i} u JOIN c{i} c ON u.key = c.key GROUP BY 1),
c{i + 1} AS (SELECT c.*, t{i}, edge{i}, left{i} - coalesce(spent{i}, 0) AS left{i + 1} FROM c{i} c LEFT JOIN g{i} g ON c.key = g.key)"""
    extra = f"coalesce(edge{levels - 1} - left{levels} < left{levels}, FALSE)"
    for i in reversed(range(levels)):
        extra = f"(t{i} IS NULL OR d{i} < t{i} OR (d{i} = t{i} AND {extra}))"
    return sql + f"""
SELECT doc_id, size, source_size, target,
  (size * (base + CASE WHEN base * source_size >= target THEN 0 ELSE {extra}::INT END))::BIGINT AS taken
FROM d JOIN c{levels} c ON d.key = c.key"""


ORACLE = {"op3_mix_sources": oracle_over("documents")}
