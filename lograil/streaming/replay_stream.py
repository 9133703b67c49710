"""The fold as a stream: keyed state, one record after another, equal to the batch fold on the same log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.folders import shared_folder

STATE = "alive boolean, value string, expire_at_ms long, last_lsn long"
OUT = "key string, alive boolean, value string, expire_at_ms long, last_lsn long"


class Fold(StatefulProcessor):
    """Holds a key's state; deadlines are compared with record times, so no timer or state TTL is needed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("state", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        alive, value, deadline, last = self._state.get() if self._state.exists() else (False, None, 0, 0)
        pdf = pd.concat(list(rows)).sort_values("lsn")
        for r in pdf.itertuples(index=False):
            if r.lsn <= last:  # seen before
                continue
            if alive and deadline and deadline <= r.created_at_ms:
                alive = False
            if r.rec_type == "SET":
                alive, value, deadline = True, r.value, int(r.expire_at_ms)
            elif r.rec_type == "DEL":
                alive, value, deadline = False, None, 0
            elif alive:
                deadline = int(r.expire_at_ms)
            last = int(r.lsn)
        self._state.update((alive, value, deadline, last))
        yield pd.DataFrame([(key[0], alive, value, deadline, last)], columns=["key", "alive", "value", "expire_at_ms", "last_lsn"])

    def close(self) -> None:
        pass


def fold_stream(log: DataFrame) -> DataFrame:
    """Streaming log -> an update of OUT for each key a micro-batch touches."""
    return log.groupBy("key").transformWithStateInPandas(Fold(), outputStructType=OUT, outputMode="Update", timeMode="None")


def run_fold(spark: SparkSession, log: DataFrame, name: str, seconds: int = 300) -> DataFrame:
    """Runs the fold over all that the source has now; the table of each key's last update.

    Each micro-batch's updates are written to a folder of their own, so a batch that is run again replaces them.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder = shared_folder(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/updates/batch={number}")

    query = fold_stream(log).writeStream.foreachBatch(write).outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").start()
    wait(query, name, seconds)
    updates = spark.read.schema(OUT).parquet(f"{folder}/updates")
    last = F.max(F.struct("last_lsn", "alive", "value", "expire_at_ms")).alias("s")
    return updates.groupBy("key").agg(last).select("key", "s.alive", "s.value", "s.expire_at_ms", "s.last_lsn")


def drain(spark: SparkSession, rows: DataFrame, name: str, seconds: int = 300) -> DataFrame:
    """All rows that a stream has now, by a file sink, which keeps each of them once."""
    folder = shared_folder(spark, name)
    query = rows.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    wait(query, name, seconds)
    return spark.read.schema(rows.schema).parquet(f"{folder}/rows")


def wait(query, name: str, seconds: int) -> None:
    if not query.awaitTermination(seconds):
        query.stop()
        raise TimeoutError(name)
