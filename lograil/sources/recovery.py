"""Recovery of a folder: the newest valid snapshot, the segments in order, and what a fault in one of them means.

`plan` reads and decides; `repair` is the only function here that changes files. A torn tail of the last segment
is cut; any other fault is refused, unless `unsafe` allows to cut there and to drop all segments after it.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import formats as w


class Refused(RuntimeError):
    """The log has a hole or damage that only `unsafe` recovery may cut away."""


@dataclass(frozen=True)
class Plan:
    """What recovery does: verdict is continue, truncate or refuse."""

    verdict: str
    snapshot_lsn: int
    segments: int
    records: int
    applied: int
    skipped: int
    last_lsn: int
    next_lsn: int
    cut_path: str | None = None
    cut_at: int = 0
    reason: str = ""
    dropped: list[str] = field(default_factory=list)


def plan(spark: SparkSession, folder: str, unsafe: bool = False) -> Plan:
    """Looks at every segment, each in a task of its own; the driver gets one row for each."""
    w.register(spark)
    snapshot = _snapshot_lsn(spark, folder)
    rows = spark.read.format("keyed_log").option("rows", "faults").option("after_lsn", snapshot).load(folder).orderBy("first_lsn").collect()
    verdict = w.verdict([r.fault for r in rows], unsafe)
    bad = next((i for i, r in enumerate(rows) if r.fault != "none"), None)
    kept = rows if bad is None else rows[: bad + 1]
    records, skipped = sum(r.records for r in kept), sum(r.skipped for r in kept)
    last = max([snapshot, *(r.last_lsn for r in kept if r.records)])
    cut = {} if bad is None else {"cut_path": rows[bad].path, "cut_at": rows[bad].offset, "reason": rows[bad].fault, "dropped": [r.path for r in rows[bad + 1 :]]}
    return Plan(verdict, snapshot, len(kept), records, records - skipped, skipped, last, last + 1, **cut)


def _snapshot_lsn(spark: SparkSession, folder: str) -> int:
    snapshots = spark.read.format("keyed_snapshot").option("rows", "list").load(folder).where("fault = 'none'")
    return snapshots.agg(F.max("last_included_lsn")).first()[0] or 0


def recover(spark: SparkSession, folder: str, unsafe: bool = False) -> tuple[DataFrame | None, DataFrame, Plan]:
    """(snapshot entries or None, log after the snapshot, plan); Refused if the plan is to refuse."""
    p = plan(spark, folder, unsafe)
    if p.verdict == "refuse":
        raise Refused(f"{p.cut_path} at {p.cut_at}: {p.reason}")
    snapshot = spark.read.format("keyed_snapshot").load(folder) if p.snapshot_lsn else None
    log = spark.read.format("keyed_log").option("after_lsn", p.snapshot_lsn).load(folder)
    # A segment's reader stops at its fault, and what comes after the cut is not part of the log.
    return snapshot, log.where(F.col("lsn") <= p.last_lsn) if p.verdict == "truncate" else log, p


def repair(p: Plan) -> None:
    """Cuts the faulty segment behind its last good record and removes the segments after it."""
    if p.verdict != "truncate" or p.cut_path is None:
        return
    with open(p.cut_path, "r+b") as f:
        f.truncate(p.cut_at)
        f.flush()
        os.fsync(f.fileno())
    for path in p.dropped:
        os.remove(path)
