"""Statistics, integrity, segments and truncation of a log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import checkpointed

#: Bytes of a record besides key and value.
RECORD_OVERHEAD = 40


def encoded_length() -> Column:
    return F.lit(RECORD_OVERHEAD) + F.coalesce(F.octet_length("key"), F.lit(0)) + F.coalesce(F.octet_length("value"), F.lit(0))


def by_type(log: DataFrame) -> DataFrame:
    return log.groupBy("rec_type").agg(F.count("*").alias("records")).orderBy("rec_type")


def stats(log: DataFrame) -> DataFrame:
    """One row: records, bytes of keys and values, lsn range, bytes a record, whether lsns are dense."""
    return log.agg(
        F.count("*").alias("records"), F.sum(F.octet_length("key")).alias("key_bytes"),
        F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).alias("value_bytes"), F.min("lsn").alias("min_lsn"), F.max("lsn").alias("max_lsn"),
        (F.sum(encoded_length()) / F.count("*")).alias("avg_record_bytes"), (F.max("lsn") - F.min("lsn") + 1 == F.count("*")).alias("dense"),
    )


#: Blocks of a first level that make one of the second, over whose totals one task runs.
SUPER = 1000


def shifted(totals: DataFrame, block: str, value: str) -> DataFrame:
    """Adds shift, the sum of value in all blocks before each, for one row a block; by blocks of blocks."""
    rows = totals.withColumn("super", F.floor(F.col(block) / SUPER))
    upper = rows.groupBy("super").agg(F.sum(value).alias("sum"))
    upper = upper.select("super", (F.sum("sum").over(Window.orderBy("super").rowsBetween(Window.unboundedPreceding, 0)) - F.col("sum")).alias("base"))
    inside = F.sum(value).over(Window.partitionBy("super").orderBy(block).rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)
    return rows.withColumn("inside", inside).join(upper, "super").withColumn("shift", F.col("base") + F.col("inside")).drop("super", "inside", "base")


def _previous(rows: DataFrame, block: str) -> tuple[DataFrame, DataFrame]:
    """Pairs (before, lsn) of neighbours within each block of rows(block, lsn, last), and the blocks' own edges."""
    inside = rows.withColumn("before", F.lag("last").over(Window.partitionBy(block).orderBy("lsn"))).where("before is not null")
    return inside.select("before", "lsn"), rows.groupBy(block).agg(F.min("lsn").alias("lsn"), F.max("last").alias("last"))


def gaps(log: DataFrame, per_segment: int) -> DataFrame:
    """after_lsn, next_lsn, missing: holes in the log.

    Segments are ranges of lsn and are looked at apart; so are the edges of SUPER segments each, and one small
    window compares the edges of those.
    """
    first, edges = _previous(log.select("lsn", F.col("lsn").alias("last"), F.floor((F.col("lsn") - 1) / per_segment).alias("segment")), "segment")
    second, edges = _previous(edges.withColumn("segment", F.floor(F.col("segment") / SUPER)), "segment")
    third, _ = _previous(edges.withColumn("segment", F.lit(0)), "segment")
    both = first.unionByName(second).unionByName(third).where("lsn - before <> 1")
    return both.select(F.col("before").alias("after_lsn"), F.col("lsn").alias("next_lsn"), (F.col("lsn") - F.col("before") - 1).alias("missing"))


def assign_segments(log: DataFrame, limit: int, block: int = 100_000) -> DataFrame:
    """segment_first_lsn, records, bytes: a record goes to segment floor(bytes before it / limit).

    Running sums are taken in blocks of lsns and shifted by the sums of the blocks before, so no task sorts the log.
    """
    rows = log.select("lsn", encoded_length().cast("long").alias("bytes"), F.floor((F.col("lsn") - 1) / block).alias("block"))
    before = shifted(rows.groupBy("block").agg(F.sum("bytes").alias("b")), "block", "b")
    inside = F.sum("bytes").over(Window.partitionBy("block").orderBy("lsn").rowsBetween(Window.unboundedPreceding, 0)) - F.col("bytes")
    rows = rows.withColumn("inside", inside).join(before.select("block", "shift"), "block").withColumn("segment", F.floor((F.col("shift") + F.col("inside")) / limit))
    return rows.groupBy("segment").agg(F.min("lsn").alias("segment_first_lsn"), F.count("*").alias("records"), F.sum("bytes").alias("bytes"))


def truncatable(segments: DataFrame, snapshot_lsn: int) -> DataFrame:
    """Adds dropped: a segment goes iff the next one begins at snapshot_lsn + 1 or below; the last one never does.

    So all go that begin before the last segment that begins at snapshot_lsn + 1 or below.
    """
    keeper = segments.where(F.col("segment_first_lsn") <= snapshot_lsn + 1).agg(F.max("segment_first_lsn").alias("keeper"))
    return segments.crossJoin(F.broadcast(keeper)).withColumn("dropped", F.coalesce(F.col("segment_first_lsn") < F.col("keeper"), F.lit(False))).drop("keeper")


def newest(manifest: DataFrame, keep: int, by: str = "lsn") -> DataFrame:
    """Adds kept: whether a snapshot is one of the newest `keep`."""
    edge = manifest.orderBy(F.desc(by)).limit(keep).agg(F.min(by).alias("edge"))
    return manifest.crossJoin(F.broadcast(edge)).withColumn("kept", F.col(by) >= F.col("edge")).drop("edge")


def append(log: DataFrame, base: int) -> DataFrame:
    """Gives new records dense lsns after base, in the order of (created_at_ms, key, rec_type).

    The ranges are cut once and kept by a checkpoint, so their counts and their rows are of one cut.
    """
    order = ("created_at_ms", "key", "rec_type")
    ranged = checkpointed(log.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    counts = shifted(ranged.groupBy("part").agg(F.count("*").alias("n")), "part", "n").select("part", "shift")
    inside = ranged.withColumn("i", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    return inside.join(counts, "part").withColumn("new_lsn", F.lit(base) + F.col("shift") + F.col("i"))


def commit_batches(log: DataFrame, size: int) -> DataFrame:
    """Records grouped by consecutive lsns into batches of size: batch, records, first_lsn, last_lsn."""
    return log.groupBy(F.floor((F.col("lsn") - 1) / size).alias("batch")).agg(
        F.count("*").alias("records"), F.min("lsn").alias("first_lsn"), F.max("lsn").alias("last_lsn")
    )
