"""BPE encoding and decoding with a public byte-level vocabulary.

Long text is cut in halves down to LEAF code points, the leaves are encoded apart, and neighbours are
joined: a window around each cut is encoded again and grown until it agrees with both sides. Texts over PART
code points are cut into rows of that size first, which any tasks encode in parallel; a text's parts meet
after a shuffle, where neighbours are joined in the same way, pair by pair.

Agreement comes in two kinds. A pre-token always starts where a blank follows another character, in the
whole text as in any part of it, so a window between two such places replaces whole pre-tokens. Inside one
long run of letters or digits, which has none, the window must share a token, at the same place, with each
side: a BPE sequence is the encoding of its run iff each two neighbouring tokens are that of theirs, and
with a shared token every neighbouring pair of the joined sequence occurs in one of the three encodings.
Other long runs (blanks, marks) grow their window to their end.

`encode_piece` uses the vocabulary as ranks with the same pattern; the special token's string in a text is
the special token, as in the library's default.

Defined cases: null text is empty and has no tokens; the sha256 of no ids is that of the empty string; a null
doc_id is kept; equal rows are rows each, and rows of one doc_id with different texts are told apart by a
64-bit hash of the text; an empty table gives no rows; extra columns are ignored. One text with its ids is held
in memory as a whole, as its digest needs them.
"""

from __future__ import annotations

import base64
import hashlib
import json
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, small_batches

VOCABULARY = "byte_bpe_50k"
#: Code points up to which a text is encoded at once and in one task, and the first width of a window on each side.
LEAF, PART, WINDOW = 1 << 12, 1 << 14, 256
SPECIAL = "<|endoftext|>"


def _utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _splits(text: str, i: int) -> bool:
    """Whether a pre-token surely starts at i: none goes from other characters on into a blank."""
    return text[i] in " \t\n\r" and not text[i - 1].isspace()


class Codec:
    """Encoding and decoding with one vocabulary; `encode_piece` is the encoder of leaves and windows."""

    def __init__(self, name: str = VOCABULARY):
        import public_tokenizers as files
        import tiktoken

        with open(files.path(f"{name}.json")) as f:
            model = json.load(f)
        special = {t["content"]: t["id"] for t in model["added_tokens"]}
        with open(files.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.special = special
        self.core = tiktoken.Encoding(name, pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.bytes = [b""] * (max([*ranks.values(), *special.values()]) + 1)
        for token, i in [*ranks.items(), *((k.encode(), v) for k, v in special.items())]:
            self.bytes[i] = token
        self.text = list(map(str, range(len(self.bytes))))

    def encode_piece(self, text: str) -> list[int]:
        return self.core.encode(text, allowed_special="all")

    def encode(self, text: str, leaf: int = LEAF, window: int = WINDOW) -> list[int]:
        if len(text) <= leaf:
            return self.encode_piece(text)
        cut = len(text) // 2
        return self.join(text, cut, self.encode(text[:cut], leaf, window), self.encode(text[cut:], leaf, window), window)

    def join_parts(self, texts: list[str], ids: list[list[int]], window: int = WINDOW) -> list[int]:
        """The encoding of all texts as one, given those of each, by a tree of joins."""
        while len(texts) > 1:
            both = [a + b for a, b in zip(texts[0::2], texts[1::2])]
            joined = [self.join(t, len(texts[2 * i]), ids[2 * i], ids[2 * i + 1], window) for i, t in enumerate(both)]
            odd = len(texts) % 2
            texts, ids = both + texts[len(texts) - odd :], joined + ids[len(ids) - odd :]
        return ids[0]

    def join(self, text: str, cut: int, left: list[int], right: list[int], window: int) -> list[int]:
        """The encoding of text, given those of text[:cut] and text[cut:]."""
        n = len(text)
        while True:
            lo, hi = max(0, cut - window), min(n, cut + window)
            a = next((i for i in range(cut - 1, max(lo, 1) - 1, -1) if _splits(text, i)), None if lo else 0)
            b = next((i for i in range(cut + 1, hi) if _splits(text, i)), None if hi < n else n)
            if a is not None and b is not None:
                mid = self.encode_piece(text[a:b])
                i = self._before(left, len(_utf8(text[a:cut])))
                k = self._after(right, len(_utf8(text[cut:b])))
                if i is not None and k is not None:
                    return left[:i] + mid + right[k:]
            elif lo >= 4 and hi < n and ((run := text[lo - 4 : hi + 1]).isalpha() or run.isdecimal()):
                mid = self.encode_piece(text[lo:hi])
                l, r = self._shared(left, mid, len(_utf8(text[lo:cut])), right, len(_utf8(text[cut:hi])))
                if l and r and l[1] <= r[1]:
                    return left[: l[0]] + mid[l[1] : r[1]] + right[r[0] :]
            window *= 2

    def _before(self, ids: list[int], size: int) -> int | None:
        """Where the last tokens begin that have so many bytes together."""
        i = len(ids)
        while size > 0:
            i -= 1
            size -= len(self.bytes[ids[i]])
        return i if size == 0 else None

    def _after(self, ids: list[int], size: int) -> int | None:
        i = 0
        while size > 0:
            size -= len(self.bytes[ids[i]])
            i += 1
        return i if size == 0 else None

    def _shared(self, left, mid, left_bytes, right, right_bytes):
        """The tokens that mid shares with left (the first such) and with right (the last such), by place and id."""
        places, i, used = {}, len(left), 0
        while used < left_bytes:
            i -= 1
            used += len(self.bytes[left[i]])
            places[left_bytes - used] = i
        at, first, starts = 0, None, []
        for j, t in enumerate(mid):
            starts.append(at)
            if first is None and (k := places.get(at)) is not None and left[k] == t:
                first = (k, j)
            at += len(self.bytes[t])
        places, pos = {}, left_bytes
        for k, t in enumerate(right):
            if pos >= left_bytes + right_bytes:
                break
            places[pos] = k
            pos += len(self.bytes[t])
        last = None
        for j in range(len(mid) - 1, -1, -1):
            if (k := places.get(starts[j])) is not None and right[k] == mid[j]:
                last = (k, j)
                break
        return first, last

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(name: str = VOCABULARY) -> Codec:
    return Codec(name)


OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _result(c: Codec, doc_id, ids: list[int], keep_ids: bool) -> tuple:
    digest = hashlib.sha256(",".join(map(c.text.__getitem__, ids)).encode()).hexdigest()
    back = hashlib.sha256(c.decode(ids).encode()).hexdigest()
    return (doc_id, len(ids), digest, back) + ((ids,) if keep_ids else ())


def _frame(rows: list[tuple], keep_ids: bool) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids)
    out["doc_id"] = out["doc_id"].astype("Int64")
    return out


def _cut(part: int):
    """The parts of each text, some millions of code points at a time."""

    def run(batches):
        rows, held = [], 0
        names = ["doc_id", "content", "part", "piece"]
        for pdf in batches:
            for doc_id, content, text in zip(pdf["doc_id"], pdf["content"], pdf["text"]):
                for k, i in enumerate(range(0, len(text), part)):
                    rows.append((doc_id, content, k, text[i : i + part]))
                    held += part
                    if held >= 1 << 22:
                        yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64", "part": "int32"})
                        rows, held = [], 0
        yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64", "part": "int32"})

    return run


def encode_documents(docs: DataFrame, name: str = VOCABULARY, keep_ids: bool = False, part: int = PART) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row, and the ids themselves with keep_ids."""
    spark = docs.sparkSession
    small_batches(spark)
    out = OUT + ", ids array<int>" * keep_ids

    def whole(batches):
        c = codec(name)
        for pdf in batches:
            yield _frame([_result(c, doc_id, c.encode(text), keep_ids) for doc_id, text in zip(pdf["doc_id"], pdf["text"])], keep_ids)

    def leaves(batches):
        c = codec(name)
        for pdf in batches:
            yield pdf.assign(ids=[np.array(c.encode(t), np.int32).tobytes() for t in pdf["piece"]])

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        c = codec(name)
        copies = int((pdf["part"] == 0).sum())  # equal rows are equal texts
        pdf = pdf.drop_duplicates("part").sort_values("part")
        ids = c.join_parts(pdf["piece"].tolist(), [np.frombuffer(x, np.int32).tolist() for x in pdf["ids"]])
        return _frame([_result(c, pdf["doc_id"].iloc[0], ids, keep_ids)] * copies, keep_ids)

    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    short = docs.where(F.length("text") <= part).mapInPandas(whole, out)
    long = docs.where(F.length("text") > part).select("doc_id", F.xxhash64("text").alias("content"), "text")
    parts = long.mapInPandas(_cut(part), "doc_id long, content long, part int, piece string")
    parts = parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id", "content", "part")
    parts = parts.mapInPandas(leaves, "doc_id long, content long, part int, piece string, ids binary")
    return short.unionByName(parts.groupBy("doc_id", "content").applyInPandas(joined, out))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read(spark, sf_dir, "documents"))
