"""Substring dedup: words covered by a window of WINDOW words that also starts earlier go.

Documents are cut at content-defined anchors: a window's anchor is the smallest hash among its K-word
sequences, so equal windows have equal anchors wherever they stand. A fragment is a run of windows with one
anchor at one place, at most WINDOW - K + 1 of them. Anchors are counted over the whole corpus, in buckets: a task
sends each anchor of a chunk of text once, whatever the number of its places there, so a passage that a third of
all documents share fills no bucket. Only fragments whose anchor occurs again are cut out. A task that has met
an earlier place of a fragment marks it as a copy, which repeats it whole; the others meet in one sorted run,
which is streamed, and the first one of each goes with its words to a shard by anchor. Each shard is a compressed FM-index of its fragments; each fragment is streamed
backwards through it, and wherever WINDOW words match, the interval of rows gives the first place of that
window in the corpus.

Anchors with more than HOT fragments are split further: their fragments go window by window, each to the
shard of its own hash, so a passage that many documents share in different surroundings fills no shard.
A fragment is known by a 64-bit hash of its words and by its anchor; what is compared in a shard are the words.

Defined cases: null text has no words; fewer than WINDOW words have no window; a null doc_id comes before
all others; rows with equal doc_id are the same place at the same start, so neither is earlier there, and are
told apart by a 64-bit hash of their texts (equal texts lose the same words); an empty table gives no rows; extra
columns are ignored. Memory of a task is bounded by a shard (about SHARD_WORDS words), a bucket (about BUCKET
places), a chunk or one document.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, grams, hashed_words, mix, read, release, small_batches, word_hashes
from .fm_index import FMIndex

WINDOW, K = 20, 5
SHARD_WORDS, HOT = 1_000_000, 20_000
#: Places that are looked at together before a task sends their anchors, and places of the corpus for each bucket.
CHUNK, BUCKET = 500_000, 4_000_000
#: Fragments whose first place a task remembers, so that it knows later ones as copies.
SEEN = 400_000
#: Hot anchors that are sent to all tasks, eight bytes each; beyond, their table is joined.
HOT_SENT = 500_000
_FIRST = -(1 << 63)


@dataclass
class Fragments:
    """The fragments of some documents, as columns."""

    raw: bytes
    h: np.ndarray  # of all words
    begin: np.ndarray  # first byte of each word
    end: np.ndarray
    doc: np.ndarray  # number of each fragment's document
    word: np.ndarray  # its first word among all
    start: np.ndarray  # the same within the document
    place: np.ndarray  # its number within the document
    windows: np.ndarray
    anchor: np.ndarray


def fragments(texts: list[str | None]) -> Fragments:
    """All documents of a batch at once: windows that reach into the next document are left out."""
    parts = [_encode(t) for t in texts]
    raw = b"\n".join(parts)
    h, begin, end = hashed_words(raw)
    at = np.cumsum([0] + [len(p) + 1 for p in parts])[:-1]
    doc_of = np.searchsorted(at, begin, side="right") - 1
    n = len(h) - WINDOW + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return Fragments(raw, h, begin, end, none, none, none, none, none, np.empty(0, np.uint64))
    g, span = grams(h, K), WINDOW - K + 1
    low, have = g, 1
    while have * 2 <= span:
        low, have = np.minimum(low[:-have], low[have:]), have * 2
    low = np.minimum(low[:n], low[span - have : span - have + n])
    valid = doc_of[:n] == doc_of[WINDOW - 1 :]
    # A window that begins with its anchor is the last one of this anchor's place.
    new = np.concatenate(([True], (low[1:] != low[:-1]) | (g[: n - 1] == low[:-1]) | ~valid[:-1])) & valid
    word = np.flatnonzero(new)
    last = np.flatnonzero(valid & np.concatenate((new[1:] | ~valid[1:], [True])))
    doc = doc_of[word]
    first_word = np.searchsorted(doc_of, np.arange(len(parts)))
    first_fragment = np.searchsorted(doc, np.arange(len(parts)))
    return Fragments(raw, h, begin, end, doc, word, word - first_word[doc], np.arange(len(doc)) - first_fragment[doc], last - word + 1, low[word])


def _encode(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _short(anchor: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An anchor's bucket, and the rest that tells it from others there."""
    return ((anchor >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), anchor.astype(np.uint32)


def _name(anchor: np.ndarray, buckets: int) -> np.ndarray:
    bucket, rest = _short(anchor, buckets)
    return bucket << 32 | rest.astype(np.int64)


PLACES = "bucket int, rest binary, doc_id binary, content binary, place binary, count binary"


def _places(buckets: int):
    """For each chunk and bucket, its anchors; one that has several places in the chunk is sent without them, with their number.

    Those places, which surely recur, go past the buckets: bucket is negative.
    """

    def sent(doc_id, content, anchor, place) -> list[tuple]:
        by = np.argsort(anchor, kind="stable")
        a = anchor[by]
        new = np.concatenate(([True], a[1:] != a[:-1]))
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(a)))
        many = np.repeat(count > 1, count)
        out = []
        again = np.sort(by[many])
        if len(again):
            out.append((-1 - int(abs(int(doc_id[again[0]])) % buckets), None, doc_id[again].tobytes(), content[again].tobytes(), place[again].tobytes(), None))
        one = by[first]
        at = np.where(count > 1, np.int32(-1), place[one])
        bucket, rest = _short(anchor[one], buckets)
        order = np.lexsort((one, bucket))  # in the order of documents, which packs well
        ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
        one, rest, at, count = one[order], rest[order], at[order], count[order].astype(np.int32)
        who, what = np.where(at < 0, 0, doc_id[one]), np.where(at < 0, 0, content[one])
        for b, (x, y) in enumerate(zip(ends.tolist(), ends[1:].tolist())):
            if x < y:
                out.append((b, *(v[x:y].tobytes() for v in (rest, who, what, at, count))))
        return out

    def run(batches):
        held, size = [], 0
        names = [c.split()[0] for c in PLACES.split(", ")]

        def frame():
            rows = sent(*(np.concatenate(x) for x in zip(*held)))
            held.clear()
            return pd.DataFrame(rows, columns=names).astype({"bucket": "int32"})

        for pdf in batches:
            f = fragments(pdf["text"].tolist())
            if len(f.doc):
                held.append((pdf["doc_id"].to_numpy(np.int64)[f.doc], pdf["content"].to_numpy(np.int64)[f.doc], f.anchor, f.place.astype(np.int32)))
                size += len(f.doc)
            if size >= CHUNK:
                yield frame()
                size = 0
        if held:
            yield frame()

    return run


FOUND = "dest int, places long, doc_id binary, content binary, place binary, hot long"


def _recurring(buckets: int):
    """Of one bucket: the places of anchors that occur again, dealt by document, and the names of hot anchors."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = int(pdf["bucket"].iloc[0])
        doc_id, content = (np.frombuffer(b"".join(pdf[c]), np.int64) for c in ("doc_id", "content"))
        place, hot = np.frombuffer(b"".join(pdf["place"]), np.int32), np.empty(0, np.int64)
        if bucket >= 0:
            rest, count = np.frombuffer(b"".join(pdf["rest"]), np.uint32), np.frombuffer(b"".join(pdf["count"]), np.int32)
            kinds, at = np.unique(rest, return_inverse=True)
            total = np.bincount(at, count, minlength=len(kinds))
            hot = kinds[total > HOT].astype(np.int64) | bucket << 32
            keep = (total[at] > 1) & (place >= 0)
            doc_id, content, place = doc_id[keep], content[keep], place[keep]
        dest = (mix((doc_id ^ content).view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        by = np.lexsort((place, content, doc_id, dest))
        doc_id, content, place, dest = doc_id[by], content[by], place[by], dest[by]
        first = np.flatnonzero(np.concatenate(([True], dest[1:] != dest[:-1]))[: len(dest)]).tolist()
        pack = zstandard.ZstdCompressor(level=1).compress  # sorted ids take little
        rows = [(int(dest[x]), y - x, *(pack(v[x:y].tobytes()) for v in (doc_id, content, place)), None) for x, y in zip(first, [*first[1:], len(dest)])]
        rows += [(None, None, None, None, None, h) for h in hot.tolist()]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in FOUND.split(", ")]).astype({"dest": "Int32", "places": "Int64", "hot": "Int64"})

    return run


def _wanted(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of the documents of one number: the places of each."""
    doc_id, content, place = (np.frombuffer(b"".join(map(zstandard.decompress, pdf[c])), kind) for c, kind in (("doc_id", np.int64), ("content", np.int64), ("place", np.int32)))
    by = np.lexsort((place, content, doc_id))
    doc_id, content, place = doc_id[by], content[by], place[by]
    first = np.flatnonzero(np.concatenate(([True], (doc_id[1:] != doc_id[:-1]) | (content[1:] != content[:-1])))[: len(by)])
    places = [place[x:y].tobytes() for x, y in zip(first.tolist(), [*first[1:].tolist(), len(by)])]
    return pd.DataFrame({"doc_id": doc_id[first], "content": content[first], "places": pd.Series(places, dtype=object)})


#: The odd multiplier of a fragment's number; its inverse modulo 2^64 takes a prefix off.
_BASE = 0x9E3779B97F4A7C15


def _numbers(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of h[a:b] for arrays a and b, from prefix sums of a polynomial."""
    n = len(h)
    one = np.ones(1, np.uint64)
    power = np.cumprod(np.concatenate((one, np.full(n, _BASE, np.uint64))), dtype=np.uint64)
    back = np.cumprod(np.concatenate((one, np.full(n, pow(_BASE, -1, 1 << 64), np.uint64))), dtype=np.uint64)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * power[:n])))
    return mix((total[b] - total[a]) * back[a] + (b - a).astype(np.uint64))


CUT = "number long, doc_id long, content long, start int, windows int, anchor long, words string, copies binary"
_CUT = [c.split()[0] for c in CUT.split(", ")]


def _cut(buckets: int):
    """The fragments at the given places with their words, or as copies where the task has met an earlier place.

    The copies of a document are one row of starts and numbers of windows, under a number of the document's own.
    """

    def run(batches):
        least: dict[tuple[int, int], tuple[int, int]] = {}
        for pdf in batches:
            f = fragments(list(map(_unpack, pdf["packed"])))
            wide = int(f.place.max(initial=-1)) + 1
            asked = [i * wide + p[p < wide] for i, parts in enumerate(pdf["places"]) for p in (np.frombuffer(parts, np.int32).astype(np.int64),)]
            pick = np.flatnonzero(np.isin(f.doc * wide + f.place, np.concatenate(asked) if asked else []))
            a, b = f.word[pick], f.word[pick] + f.windows[pick] + WINDOW - 1
            number, anchor = _numbers(f.h, a, b).view(np.int64), _name(f.anchor[pick], buckets)
            doc_id, content, start = pdf["doc_id"].to_numpy(np.int64)[f.doc[pick]], pdf["content"].to_numpy(np.int64)[f.doc[pick]], f.start[pick]
            copy = np.zeros(len(pick), bool)
            for i, (name, place) in enumerate(zip(zip(number.tolist(), anchor.tolist()), zip(doc_id.tolist(), start.tolist()))):
                old = least.get(name)
                if old is None or place < old:
                    least[name] = place
                elif place > old:
                    copy[i] = True
            if len(least) > SEEN:
                least.clear()
            kept = np.flatnonzero(~copy)
            words = [f.raw[x:y].decode("utf-8", "surrogatepass") for x, y in zip(f.begin[a[kept]].tolist(), f.end[b[kept] - 1].tolist())]
            yield pd.DataFrame({
                "number": number[kept], "doc_id": doc_id[kept], "content": content[kept], "start": start[kept].astype(np.int32),
                "windows": f.windows[pick[kept]].astype(np.int32), "anchor": anchor[kept], "words": pd.Series(words, dtype=object), "copies": None,
            })
            gone = np.flatnonzero(copy)
            at = np.flatnonzero(np.diff(f.doc[pick[gone]], prepend=-1)).tolist()
            pairs = np.column_stack((start[gone], f.windows[pick[gone]])).astype(np.int32)
            one, two = doc_id[gone][at], content[gone][at]
            yield pd.DataFrame({
                "number": mix((one ^ two).view(np.uint64)).view(np.int64), "doc_id": one, "content": two, "start": np.zeros(len(at), np.int32),
                "windows": np.zeros(len(at), np.int32), "anchor": np.zeros(len(at), np.int64), "words": None,
                "copies": pd.Series([pairs[x:y].tobytes() for x, y in zip(at, [*at[1:], len(gone)])], dtype=object),
            }, columns=_CUT)

    return run


@F.pandas_udf(T.BinaryType())
def _pack(texts: pd.Series) -> pd.Series:
    """Texts as they are shuffled, at less than half their size."""
    c = zstandard.ZstdCompressor(level=1)
    return pd.Series([None if t is None else c.compress(_encode(t)) for t in texts], dtype=object)


def _unpack(packed: bytes | None) -> str:
    return zstandard.decompress(packed).decode("utf-8", "surrogatepass") if packed is not None else ""


ROUTED = "shard int, doc_id long, content long, start int, skip int, words string, copies binary"
_ROUTED = [c.split()[0] for c in ROUTED.split(", ")]


def _route(shards: int, hot: np.ndarray | None):
    """Rows sorted by fragment and place: each first place goes to a shard with its words, copies to negative ones.

    Rows of one doc_id that have the fragment at the same first place are first places each. Fragments of hot
    anchors go window by window, by the windows' hashes. hot None: a column says which anchors are.
    """

    def run(batches):
        rep = None  # the last fragment's number, first place and text hash
        for pdf in batches:
            whole = pdf["copies"].notna().to_numpy()
            doc_id, content = pdf["doc_id"].to_numpy(np.int64), pdf["content"].to_numpy(np.int64)
            to = (-1 - (mix((doc_id ^ content).view(np.uint64)) % np.uint64(shards)).astype(np.int64)).astype(np.int32)
            done = pdf[whole].assign(shard=to[whole], skip=np.int32(0))
            yield done[_ROUTED]
            pdf, to, doc_id, content = pdf[~whole], to[~whole], doc_id[~whole], content[~whole]
            if not len(pdf):
                continue
            number, start, windows, anchor = (pdf[c].to_numpy(np.int64) for c in ("number", "start", "windows", "anchor"))
            is_hot = np.isin(anchor, hot) if hot is not None else pdf["hot"].to_numpy(bool)
            words = pdf["words"].to_numpy(object)
            new = np.concatenate(([rep is None or (int(number[0]), int(anchor[0])) != rep[0]], (number[1:] != number[:-1]) | (anchor[1:] != anchor[:-1])))
            first = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))  # -1: the batch before has it
            first_doc, first_start = (np.where(first < 0, 0 if rep is None else rep[1][k], v[first]) for k, v in enumerate((doc_id, start)))
            copies = (doc_id != first_doc) | (start != first_start)
            shard = (mix(anchor.view(np.uint64)) % np.uint64(shards)).tolist()
            rows: list[tuple] = []
            for i in np.flatnonzero(~copies).tolist():
                d, c, at = int(doc_id[i]), int(content[i]), int(start[i])
                if not new[i] and c == rep[2]:
                    continue  # an equal row
                rep = ((int(number[i]), int(anchor[i])), (d, at), c)
                if not is_hot[i]:
                    rows.append((shard[i], d, c, at, 0, words[i], None))
                    continue
                raw = _encode(words[i])
                parts = raw.split()
                goes = (grams(word_hashes(raw), WINDOW) % np.uint64(shards)).tolist()
                rows += [(goes[j], d, c, at, j, b" ".join(parts[j : j + WINDOW]).decode("utf-8", "surrogatepass"), None) for j in range(int(windows[i]))]
            i = np.flatnonzero(copies)
            pairs = np.column_stack((start[i], windows[i])).astype(np.int32)
            rows += [(s, d, c, 0, 0, None, p.tobytes()) for s, d, c, p in zip(to[i].tolist(), doc_id[i].tolist(), content[i].tolist(), pairs)]
            yield pd.DataFrame(rows, columns=_ROUTED).astype({"shard": "int32", "start": "int32", "skip": "int32", "doc_id": "int64", "content": "int64"})

    return run


def search_shard(doc: np.ndarray, start: np.ndarray, texts: list[list]) -> list[np.ndarray]:
    """For each word sequence, at (doc, start), the offsets of its windows that the others or itself have earlier."""
    number: dict = {}
    coded = [np.array([number.setdefault(w, len(number) + 1) for w in t], dtype=np.int64) for t in texts]
    lengths = np.array([len(c) for c in coded])
    index = FMIndex(np.concatenate(coded), lengths, WINDOW)
    # The order of places (document, word), equal for equal places.
    n = len(index.text)
    who = np.repeat(np.arange(len(coded)), lengths)
    spot = np.arange(len(who)) + who
    inside = spot - index.starts[who]
    d, s = doc[who], start[who] + inside
    by = np.lexsort((s, d))
    change = np.concatenate(([0], (d[by][1:] != d[by][:-1]) | (s[by][1:] != s[by][:-1])))
    place = np.full(n, n, np.int64)
    place[spot[by]] = np.cumsum(change)
    first = np.minimum.reduceat(place[index.sa], index.group_start)
    out: list[list[np.ndarray]] = [[] for _ in coded]
    found_who, found_at = [], []
    for who, at, lo, _ in index.matches(coded):
        earlier = first[index.group[lo]] < place[index.starts[who] + at]
        found_who.append(who[earlier])
        found_at.append(at[earlier])
    if not found_who:
        return [np.empty(0, np.int64) for _ in coded]
    who, at = np.concatenate(found_who), np.concatenate(found_at)
    by = np.lexsort((at, who))
    return np.split(at[by], np.searchsorted(who[by], np.arange(1, len(coded))))


BEGINS = "doc_id long, content long, begins binary"


def _shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """Where the removed windows begin: all of a copy's, and those of a first place that the shard has earlier."""
    start = (pdf["start"] + pdf["skip"]).to_numpy(np.int64)
    if pdf["shard"].iloc[0] < 0:
        start, n = np.frombuffer(b"".join(pdf["copies"]), np.int32).astype(np.int64).reshape(-1, 2).T
        doc_id, content = (np.repeat(pdf[c].to_numpy(np.int64), pdf["copies"].str.len().to_numpy(np.int64) // 8) for c in ("doc_id", "content"))
        by = np.lexsort((content, doc_id))
        doc_id, content, n, start = doc_id[by], content[by], n[by], start[by]
        before = np.cumsum(n) - n
        begins = (np.repeat(start - before, n) + np.arange(n.sum())).astype(np.int32)
        new = np.concatenate(([True], (doc_id[1:] != doc_id[:-1]) | (content[1:] != content[:-1])))
        cuts = np.append(before[new], n.sum()).tolist()
        return pd.DataFrame({"doc_id": doc_id[new], "content": content[new], "begins": [begins[x:y].tobytes() for x, y in zip(cuts, cuts[1:])]})
    by = np.lexsort((pdf["content"], start, pdf["doc_id"]))
    pdf, start = pdf.iloc[by], start[by]
    found = search_shard(pdf["doc_id"].to_numpy(np.int64), start, [_encode(t).split() for t in pdf["words"]])
    keep = np.array([len(x) > 0 for x in found])
    out = pdf[keep][["doc_id", "content"]].copy()
    begins = [(x + s).astype(np.int32).tobytes() for x, s in zip(found, start) if len(x)]
    return out.assign(begins=pd.Series(begins, index=out.index, dtype=object))


def _merge(batches):
    """Spans of removed words of each document, from where its removed windows begin."""
    for pdf in batches:
        out = []
        for parts in pdf["parts"]:
            b = np.unique(np.frombuffer(b"".join(parts), np.int32))
            new = np.flatnonzero(np.diff(b) > WINDOW) + 1
            out.append(np.column_stack((b[np.append(0, new)], b[np.append(new - 1, len(b) - 1)] + WINDOW)).ravel().astype(np.int32))
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "content": pdf["content"], "spans": out})


def repeated_spans(docs: DataFrame) -> DataFrame:
    """docs(doc_id not null, content, text) -> doc_id, content, spans array<int> (starts and ends of removed words) where there are any."""
    spark = docs.sparkSession
    small_batches(spark)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(partitions, total // (BUCKET * 50) + 1)  # a place for each 50 bytes, about
    dealt = docs.mapInPandas(_places(buckets), PLACES)
    found = checkpointed(dealt.groupBy("bucket").applyInPandas(_recurring(buckets), FOUND))
    places, hot = found.where("place is not null"), found.where("hot is not null").select("hot").distinct()
    shards = max(1, -(-(places.agg(F.sum("places")).first()[0] or 0) * (WINDOW + 8) // SHARD_WORDS))
    wanted = places.groupBy("dest").applyInPandas(_wanted, "doc_id long, content long, places binary")
    packed = docs.select("doc_id", "content", _pack("text").alias("packed"))
    cut = packed.join(wanted, ["doc_id", "content"]).select("doc_id", "content", "packed", "places").mapInPandas(_cut(buckets), CUT)
    few = hot.limit(HOT_SENT + 1).toPandas()["hot"].to_numpy(np.int64)
    if len(few) > HOT_SENT:
        few, cut = None, cut.join(hot.select(F.col("hot").alias("anchor"), F.lit(True).alias("hot")), "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    routed = cut.repartition(partitions, "number", "anchor").sortWithinPartitions("number", "anchor", "doc_id", "start", "content").mapInPandas(_route(shards, few), ROUTED)
    begins = routed.groupBy("shard").applyInPandas(_shard, BEGINS)
    parts = begins.groupBy("doc_id", "content").agg(F.collect_list("begins").alias("parts"))
    return checkpointed(parts.mapInPandas(_merge, "doc_id long, content long, spans array<int>"))


OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def remove_repeats(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """One row of OUT for each row of docs(doc_id, text), and the kept words with keep_text."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.coalesce("doc_id", F.lit(_FIRST)).alias("doc_id"), F.xxhash64("text").alias("content"), "text")
    spans = repeated_spans(docs)
    release(docs)
    both = docs.select("doc_id", "content", _pack("text").alias("packed")).join(spans, ["doc_id", "content"], "left")

    def run(batches):
        for pdf in batches:
            rows = []
            for doc_id, packed, gone in zip(pdf["doc_id"], pdf["packed"], pdf["spans"]):
                words = _encode(_unpack(packed)).split()
                kept, at, removed = [], 0, 0
                for a, b in zip(gone[0::2], gone[1::2]) if gone is not None else ():
                    kept += words[at:a]
                    removed += int(min(b, len(words)) - a)
                    at = int(b)
                joined = b" ".join(kept + words[at:])
                row = (None if doc_id == _FIRST else int(doc_id), len(words), removed, hashlib.sha256(joined).hexdigest())
                rows.append(row + ((joined.decode("utf-8", "surrogatepass"),) if keep_text else ()))
            out = pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept_sha256"] + ["text"] * keep_text)
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return both.select("doc_id", "packed", "spans").mapInPandas(run, OUT + ", text string" * keep_text)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"))
