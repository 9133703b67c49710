"""Document fingerprints by one-permutation MinHash.

Each shingle of five words is hashed once. The high bits of a hash choose one of BINS bins and the
smallest hash of a bin is its value. Empty bins are filled by optimal densification: bin i probes bins
drawn from a hash of (i, attempt) until it meets one that was filled at first; after ATTEMPTS probes it takes
the filled bin b of smallest hash (i, b), which is a draw without repeats. A bin's value is hashed with the
bin's own number, so copies of one value in several bins agree by chance independently of each other, and the
low BITS bits of that are packed; the likeness of two fingerprints corrects the share of equal bins for
chance agreement.

Defined cases: null text is empty; a text without words has an empty fingerprint, whose likeness is 1 to
another empty one and 0 to any other; texts with fewer than five words have one shingle. Rows with equal
or null doc_id follow each other by (doc_id nulls first, text); each row gives one output row, repeated ones
too; an only row follows itself. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, read, shingle_set, small_batches

BINS, BITS, ATTEMPTS = 512, 4, 64
#: Rows of a bucket, ids that choose the buckets' edges, and buckets, at most. A bucket is streamed, so its size is no limit of memory.
BUCKET_ROWS, EDGE_IDS, BUCKETS = 4000, 50_000, 20_000
_PROBES = (mix(np.arange(BINS * ATTEMPTS, dtype=np.uint64) + np.uint64(0x51ED270B)) % np.uint64(BINS)).astype(np.int64).reshape(ATTEMPTS, BINS)
_OWN = mix(np.arange(1, BINS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def donors(filled: np.ndarray) -> np.ndarray:
    """For each bin, itself if filled or the filled bin that it takes its value from; depends on filled alone."""
    out = np.arange(BINS)
    empty = np.flatnonzero(~filled)
    for a, b in ((0, 8), (8, ATTEMPTS)):
        if not len(empty):
            return out
        tried = _PROBES[a:b, empty]
        good = filled[tried]
        first = good.argmax(axis=0)
        found = good[first, np.arange(len(empty))]
        out[empty[found]] = tried[first, np.arange(len(empty))][found]
        empty = empty[~found]
    if len(empty):
        have = np.flatnonzero(filled)
        out[empty] = have[mix(_OWN[empty, None] + _OWN[None, have] * np.uint64(3)).argmin(axis=1)]
    return out


def signature(text: str) -> np.ndarray | None:
    """The BITS low bits of each bin, or None without words."""
    h = shingle_set(text.encode("utf-8", "surrogatepass"))
    if not len(h):
        return None
    bins = (h >> np.uint64(64 - 9)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))  # h is sorted, so firsts are minima
    values, filled = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    values[bins[first]], filled[bins[first]] = h[first], True
    return (mix(values[donors(filled)] + _OWN) & np.uint64((1 << BITS) - 1)).astype(np.uint8)


def pack(sig: np.ndarray | None) -> str:
    return "" if sig is None else base64.b64encode((sig[0::2] << 4 | sig[1::2]).tobytes()).decode()


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """The estimated Jaccard similarity of the two shingle sets, from 0 to 1."""
    if a is None or b is None:
        return float(a is b)
    chance = 2.0**-BITS
    return float(min(1.0, max(0.0, (np.count_nonzero(a == b) / BINS - chance) / (1 - chance))))


def edited(text: str, following: str) -> str:
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


OUT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double"
)


def _row(doc_id, text, sig, following, next_sig) -> tuple:
    new = edited(text, following)
    new_sig = sig if new == text else signature(new)
    return (
        doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(),
        pack(sig), pack(new_sig), likeness(sig, new_sig), likeness(sig, next_sig),
    )


def _chain(batches):
    """Rows come sorted by (bucket, doc_id, text); the last of each bucket is a copy of the next bucket's first."""
    before, out = None, []
    for pdf in batches:
        for bucket, doc_id, text, copy in zip(pdf["bucket"], pdf["doc_id"], pdf["text"], pdf["copy"]):
            sig = signature(text)
            if before is not None and before[0] == bucket:
                out.append(_row(before[1], before[2], before[3], text, sig))
            before = None if copy else (bucket, None if pd.isna(doc_id) else int(doc_id), text, sig)
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")] if out else None)
        if out:
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame
            out = []


def document_fingerprints(docs: DataFrame, rows_per_bucket: int = BUCKET_ROWS) -> DataFrame:
    """One row of OUT for each row of docs(doc_id, text).

    Buckets are ranges of doc_id between some of its values, chosen once by a hash, so a rerun of any task sees
    the same buckets. The first row of each bucket is copied to the end of the bucket before it (the last
    bucket ends with the first row of all); no window over the whole table is needed.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n, known, lowest = docs.agg(F.count("*"), F.count("doc_id"), F.min("doc_id")).first()
    if not n:
        return spark.createDataFrame([], OUT)
    parts = min(BUCKETS, max(1, -(-n // rows_per_bucket)))
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // EDGE_IDS))) == 0).where("doc_id is not null")
    ids = np.sort(some.select("doc_id").distinct().toPandas()["doc_id"].to_numpy(np.int64))  # about EDGE_IDS
    ids = ids[ids > lowest] if known == n else ids  # so the lowest bucket has rows, like all others
    edges = ids[np.unique(np.linspace(0, len(ids), parts, endpoint=False).astype(np.int64))[1:]] if len(ids) else ids

    @F.pandas_udf("bucket int, first boolean")
    def place(doc_ids: pd.Series) -> pd.DataFrame:
        there, v = doc_ids.notna().to_numpy(), doc_ids.fillna(0).astype("int64").to_numpy()
        bucket = np.where(there, np.searchsorted(edges, v, side="right"), 0)
        least = np.concatenate(([lowest or 0], edges))[bucket]
        first = np.where(bucket == 0, ~there if known < n else v == least, v == least)
        return pd.DataFrame({"bucket": bucket.astype("int32"), "first": first})

    dealt = docs.withColumn("at", place("doc_id")).select("doc_id", "text", "at.bucket", "at.first")
    firsts = dealt.where("first").groupBy("bucket").agg(F.min(F.struct("doc_id", "text")).alias("f"))
    last = len(edges)
    goes_to = F.when(F.col("bucket") == 0, last).otherwise(F.col("bucket") - 1).cast("int")
    copies = firsts.select("f.doc_id", "f.text", goes_to.alias("bucket"), F.lit(True).alias("copy"))
    chained = (
        dealt.select("doc_id", "text", "bucket", F.lit(False).alias("copy"))
        .unionByName(copies)
        .repartitionById(last + 1, F.col("bucket"))
        .sortWithinPartitions("bucket", "copy", F.col("doc_id").asc_nulls_first(), "text")
    )
    return chained.mapInPandas(_chain, OUT)


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(read(spark, sf_dir, "documents"))
