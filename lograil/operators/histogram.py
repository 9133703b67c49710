"""A log-linear histogram: values below 64 exact, then 64 buckets in each power of two; merges and quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUB, BITS = 64, 6


def bucket(v: Column) -> Column:
    """The magnitude is the length of the binary digits, so no logarithm rounds."""
    shift = (F.length(F.bin(v)) - 1 - BITS).cast("int")
    index = (shift + 1) * SUB + F.call_function("shiftright", v, shift).bitwiseAND(F.lit(SUB - 1))
    return F.when(v < SUB, v).otherwise(index).cast("int")


def lower_bound(b: Column) -> Column:
    shift = F.floor(b / SUB).cast("int") - 1
    return F.when(b < SUB, b.cast("long")).otherwise(F.call_function("shiftleft", (b % SUB + SUB).cast("long"), shift)).cast("long")


def build(samples: DataFrame, by: list[str] | None = None) -> DataFrame:
    """latency(ns) -> bucket, count (for each of `by`); partial sums are merged by the aggregation."""
    return samples.groupBy(*(by or []), bucket(F.col("ns")).alias("bucket")).agg(F.count("*").alias("count"))


def merge(histograms: DataFrame) -> DataFrame:
    return histograms.groupBy("bucket").agg(F.sum("count").alias("count"))


def quantiles(histogram: DataFrame, qs: list[float]) -> DataFrame:
    """q, ns: the lower bound of the bucket that holds rank ceil(q * n), at least 1.

    A histogram has at most 4096 buckets, so one task can run over them.
    """
    everything = Window.partitionBy(F.lit(0))
    upto = F.sum("count").over(everything.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    run = histogram.withColumn("upto", upto).withColumn("n", F.sum("count").over(everything))
    run = run.withColumn("q", F.explode(F.array(*map(F.lit, qs))))
    rank = F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("n")))
    return run.where(F.col("upto") >= rank).groupBy("q").agg(lower_bound(F.min("bucket")).alias("ns"))


def summary(samples: DataFrame) -> DataFrame:
    """One row: n, lowest, highest and the whole-number mean."""
    return samples.agg(F.count("*").alias("n"), F.min("ns").alias("min_ns"), F.max("ns").alias("max_ns"), F.expr("sum(ns) div count(*)").alias("mean_ns"))


PERCENTILES = ("min", "p50", "p90", "p99", "p99.9", "max", "mean")
_QUANTILES = {0.5: "p50", 0.9: "p90", 0.99: "p99", 0.999: "p99.9"}


def percentiles(samples: DataFrame, by: list[str] | None = None) -> DataFrame:
    """p, a map of PERCENTILES to ns (for each of `by`): extremes and mean exact, quantiles from the histogram."""
    by = by or []
    h = build(samples, by)
    one = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # 4096 buckets at most
    upto = F.sum("count").over(one.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    run = h.withColumns({"upto": upto, "n": F.sum("count").over(one)})
    at = lambda q: lower_bound(F.min(F.when(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("n"))), F.col("bucket"))))
    quantile = run.groupBy(*by).agg(*[at(q).alias(f"q{i}") for i, q in enumerate(_QUANTILES)])
    ends = samples.groupBy(*by).agg(F.min("ns").alias("lo"), F.max("ns").alias("hi"), F.expr("sum(ns) div count(*)").alias("mean"), F.count("*").alias("ops"), F.sum("ns").alias("total"))
    both = quantile.join(ends, by) if by else quantile.crossJoin(ends)
    values = {"min": F.col("lo"), **{name: F.col(f"q{i}") for i, name in enumerate(_QUANTILES.values())}, "max": F.col("hi"), "mean": F.col("mean")}
    return both.select(*by, F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)]).alias("p"), "ops", "total")


# Fixed columns of the file of runs, in order.
CSV_COLUMNS = (
    "label", "timestamp", "mode", "workload", "distribution", "conns", "pipeline", "value_size", "keyspace", "target_rate", "ops", "errors",
    "throughput_ops_s", "min_us", "p50_us", "p90_us", "p99_us", "p999_us", "max_us", "mean_us", "omitted", "client_os", "client_arch", "client_cpus",
)


def csv_header(spark) -> DataFrame:
    """ord 0 and the line of names, once before all runs."""
    return spark.range(1).select(F.lit(0).alias("ord"), F.lit(",".join(CSV_COLUMNS)).alias("line"))


def csv_rows(samples: DataFrame, label: Column, run: dict, by: list[str]) -> DataFrame:
    """by, line: a row of CSV_COLUMNS for each run; run gives the columns that don't come from the samples."""
    from ..functions.scalars import places

    tenths = F.floor((F.col("ops").cast("decimal(38,0)") * F.lit(20_000_000_000).cast("decimal(38,0)") + F.col("total")) / (2 * F.col("total")).cast("decimal(38,0)")).cast("long")
    us = lambda name: places(F.col("p")[name], 1000, 2)
    made = {
        "label": label, "ops": F.col("ops"), "throughput_ops_s": F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string")),
        **{f"{n.replace('.', '')}_us": us(n) for n in PERCENTILES}, "errors": F.lit(0), "omitted": F.lit(0), "target_rate": F.lit(0),
    }
    column = lambda c: (made[c] if c in made else F.lit(run[c])).cast("string").alias(c)
    return percentiles(samples, by).select(*by, F.to_csv(F.struct(*[column(c) for c in CSV_COLUMNS])).alias("line"))


def bars(histogram: DataFrame, width: int) -> DataFrame:
    """ord, line: filled buckets in order, at most some 20 to 39 rows, each a bar in proportion to the fullest bucket."""
    from ..functions.scalars import format_duration

    everything = Window.partitionBy(F.lit(0))  # 4096 buckets at most
    rows = histogram.withColumns({"i": F.row_number().over(everything.orderBy("bucket")) - 1, "n": F.count("*").over(everything), "peak": F.max("count").over(everything)})
    step = F.when(F.col("n") > 20, F.floor(F.col("n") / 20)).otherwise(1)
    rows = rows.groupBy(F.floor(F.col("i") / step).alias("ord")).agg(F.min("bucket").alias("b"), F.sum("count").alias("c"), F.first("peak").alias("peak"))
    bar = F.repeat(F.lit("#"), F.floor(F.col("c") / F.col("peak") * width).cast("int"))
    padded = F.when(F.length(bar) < width, F.rpad(bar, width, " ")).otherwise(bar)
    label = format_duration(lower_bound(F.col("b")))
    label = F.when(F.length(label) < 10, F.lpad(label, 10, " ")).otherwise(label)
    return rows.select("ord", F.concat(F.lit("  "), label, F.lit(" |"), padded, F.lit(" "), F.col("c").cast("string")).alias("line"))
