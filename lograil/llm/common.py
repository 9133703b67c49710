"""Shared helpers: table access, checkpoints, byte-level words and vectorised 64-bit hashing."""

from __future__ import annotations

import gc

import numpy as np
from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

from ..sources.folders import checkpointed  # noqa: F401

#: Bytes that separate words: space and \t \n \v \f \r. They never occur inside a UTF-8 sequence.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
WORD = r"[^\x20\x09-\x0D]+"

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element-wise."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


#: One random value for each (position mod 64, byte): sums of them hash words by tabulation.
_TABLE = mix(np.arange(1, 64 * 256 + 1, dtype=np.uint64) * _GOLD)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch holds, so long texts can't fill a Python worker.

    It holds for the session from then on: Spark reads these settings when a plan runs, which may be at any later time.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def release(df: DataFrame) -> None:
    """Lets Spark delete the shuffle files of what is no longer referred to, which it does when the driver's JVM collects garbage.

    The JVM's heap may shrink too, which otherwise can grow with the tasks and plans of a long query, and what the C
    library keeps of freed memory goes back, most of it the compiler's.
    """
    gc.collect()
    sc = df.sparkSession.sparkContext
    sc._jvm.System.gc()
    trim_native_heap(sc)


def trim_native_heap(sc: SparkContext) -> bool:
    """Has the driver's C library give freed memory back to the system; False where this JVM can't (before 17.0.9, or not on glibc)."""
    gateway, lang = sc._gateway, sc._jvm.java.lang
    server = lang.management.ManagementFactory.getPlatformMBeanServer()
    name = sc._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    # The server's class is not exported, so its method is called by the interface.
    invoke = [m for m in lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke"][0]
    values = gateway.new_array(lang.Object, 4)
    values[0], values[1] = name, "systemTrimNativeHeap"
    try:
        invoke.invoke(server, values)
    except Py4JError:
        return False
    return True


def words(raw: bytes) -> list[bytes]:
    """bytes.split() splits on exactly the six ASCII blanks."""
    return raw.split()


def word_spans(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words in a uint8 array."""
    blank = _SPACE[a]
    edge = np.diff(np.concatenate(([True], blank, [True])).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_hashes(raw: bytes) -> np.ndarray:
    """One 64-bit hash for each word of raw, in order."""
    return hashed_words(raw)[0]


def hashed_words(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, end) of each word of raw, in order."""
    a = np.frombuffer(raw, np.uint8)
    starts, ends = word_spans(a)
    if not len(starts):
        return np.empty(0, np.uint64), starts, ends
    lens = ends - starts
    off = np.cumsum(lens) - lens
    pos = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(off, lens)
    v = _TABLE[((pos & 63) << 8) | a[~_SPACE[a]]]
    if int(lens.max()) > 64:
        far = np.flatnonzero(pos >= 64)  # only these, so a word's hash depends on the word alone
        v[far] = mix(v[far] + (pos[far] >> 6).astype(np.uint64) * _GOLD)
    return mix(np.add.reduceat(v, off) + lens.astype(np.uint64) * _GOLD), starts, ends


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-grams of a hash sequence; empty if it is shorter."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = h[:n].copy()
    for j in range(1, k):
        acc *= _M1
        acc += h[j : j + n]
    return mix(acc)


def shingle_set(raw: bytes, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words make one shingle, none makes none."""
    h = word_hashes(raw)
    if not len(h):
        return h
    return np.unique(grams(h, min(k, len(h))))
