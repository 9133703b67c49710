"""Folders that driver and executors share, and checkpoints in them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below spark.checkpoint.dir; where that is unset, one of our own if Spark runs in this machine alone."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is not None:
        return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not spark.conf.get("spark.master", "local").startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix=f"lograil-{name}-")
    atexit.register(shutil.rmtree, own, True)
    return f"{own}/{name}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage by a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession, "checkpoint"))
    return df.checkpoint(eager=True)
