"""Language identification by unigram pieces, summed over all segmentations.

The pieces are those of a fixed public vocabulary. Each language has its own piece probabilities, fitted by
expectation-maximisation on a bounded sample of labelled training documents (SAMPLE a language, whole texts,
whose words executors count). The
forward algorithm gives the probability of a word as the sum over all its segmentations into pieces, so no
single segmentation is chosen. A text's score for a language is the sum over its words; words are the
maximal runs of letters, lower-cased, with the vocabulary's mark for a word's start.

Words of up to LONG letters are scored in batches of one length, once for each worker's cache; longer ones
by the same recursion over a sliding window of logarithms. In training, longer ones are cut into parts. Whole
texts are read; memory is bounded by the cache (CACHE words), an Arrow batch and the longest text.

Defined cases: null text, or one without a letter, is `und` with score 0; so are all if nothing can be
learned; null lang trains nothing; a null doc_id counts as the empty string in the choice of held-out rows;
ties go to the language that comes first by code point; equal rows, and rows of one doc_id, are rows each; an
empty table gives no rows; extra columns, by whatever name, are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, small_batches

VOCABULARY = "piece_bpe_32k.model"
#: Training documents a language, rounds of EM and added counts.
SAMPLE, ROUNDS, PRIOR = 400, 3, 0.05
LONG, CACHE, TRUST = 40, 400_000, 20
_LETTERS = re.compile(r"[^\W\d_]+")
_START = "▁"
#: Odd multipliers of the rolling hash and of the table's places.
_B, _M = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def words_of(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


class Pieces:
    """The vocabulary with a hash table from substrings' rolling hashes to piece numbers."""

    def __init__(self, name: str = VOCABULARY):
        import public_tokenizers as files
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=files.path(name))
        size = sp.get_piece_size()
        usable = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.pieces = sorted({p for p in map(sp.id_to_piece, usable) if p == p.lower() and (p.lstrip(_START).isalpha() or p == _START)})
        self.number = {p: i for i, p in enumerate(self.pieces)}
        self.longest = max(map(len, self.pieces))
        #: Row of what is no piece (probability 0), and of a single letter that is none.
        self.none, self.letter = len(self.pieces), len(self.pieces) + 1
        self.shift = np.uint64(64 - 20)
        self.keys, self.ids = np.zeros(1 << 20, np.uint64), np.zeros(1 << 20, np.int32)
        for i, piece in enumerate(self.pieces):
            k = self._hash(piece)
            at = (k * int(_M) % (1 << 64)) >> int(self.shift)
            while self.keys[at]:
                at = (at + 1) % (1 << 20)
            self.keys[at], self.ids[at] = k, i
        self.used = self.keys != 0

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_B) + ord(c) + 1) % (1 << 64)
        return h or 1

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, piece numbers) of those hashes that are a piece's."""
        at = (hashes * _M) >> self.shift
        left = np.flatnonzero(self.used[at])
        rows, ids = [], []
        at = at[left].astype(np.int64)
        while len(left):
            hit = self.keys[at] == hashes[left]
            rows.append(left[hit])
            ids.append(self.ids[at[hit]])
            at = (at[~hit] + 1) % (1 << 20)
            left = left[~hit]
            more = self.used[at]
            at, left = at[more], left[more]
        return (np.concatenate(rows), np.concatenate(ids)) if rows else (np.empty(0, np.int64), np.empty(0, np.int32))

    def lattice(self, codes: np.ndarray) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        """For words of one length: (words, piece numbers) where the substring [j - l, j) is a piece."""
        n, m = codes.shape
        letters = codes.T.astype(np.uint64) + np.uint64(1)
        prefix = np.zeros((m + 1, n), np.uint64)
        for j in range(m):
            prefix[j + 1] = prefix[j] * _B + letters[j]
        out, power = {}, 1
        for l in range(1, min(self.longest, m) + 1):
            power = power * int(_B) % (1 << 64)
            # All places of this length at once.
            rows, ids = self.find((prefix[l:] - prefix[: m + 1 - l] * np.uint64(power)).ravel())
            if l == 1:
                every = np.full(m * n, self.letter, np.int32)
                every[rows] = ids
                rows, ids = np.arange(m * n), every
            else:
                order = np.argsort(rows, kind="stable")
                rows, ids = rows[order], ids[order]
            cuts = np.searchsorted(rows, np.arange(m + 2 - l) * n)
            for k in range(m + 1 - l):
                if cuts[k] < cuts[k + 1]:
                    out[k + l, l] = rows[cuts[k] : cuts[k + 1]] - k * n, ids[cuts[k] : cuts[k + 1]]
        return out


_pieces: Pieces | None = None


def pieces() -> Pieces:
    global _pieces
    if _pieces is None:
        _pieces = Pieces()
    return _pieces


def _by_length(words: list[str]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        out.setdefault(len(w) + 1, []).append(i)
    return out


def _points(strings: list[str], m: int) -> np.ndarray:
    return np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32).reshape(len(strings), m)


def _codes(words: list[str], m: int) -> np.ndarray:
    return _points([_START + w for w in words], m)


def forward(words: list[str], p: np.ndarray) -> np.ndarray:
    """log P(word) for each word (rows) and language (columns of p); words of LONG letters at most."""
    v, out = pieces(), np.empty((len(words), p.shape[1]))
    for m, own in _by_length(words).items():
        for a in range(0, len(own), 20_000):
            part = own[a : a + 20_000]
            grid = v.lattice(_codes([words[i] for i in part], m))
            alpha = [np.ones((len(part), p.shape[1]))]
            for j in range(1, m + 1):
                total = np.zeros_like(alpha[0])
                for l in range(1, min(j, v.longest) + 1):
                    if (found := grid.get((j, l))) is not None:
                        total[found[0]] += alpha[j - l][found[0]] * p[found[1]]
                alpha.append(total)
            out[part] = np.log(alpha[m])
    return out


def forward_long(word: str, logp: np.ndarray) -> np.ndarray:
    """The same for one long word: a window of logarithms, linear in its length."""
    v, s = pieces(), _START + word
    alpha = [np.zeros(logp.shape[1])]  # alpha[-l] is that of l letters before
    for j in range(1, len(s) + 1):
        terms = []
        for l in range(1, min(j, v.longest) + 1):
            i = v.number.get(s[j - l : j], v.letter if l == 1 else None)
            if i is not None:
                terms.append(alpha[-l] + logp[i])
        top = np.max(terms, axis=0)
        alpha.append(top + np.log(np.exp(np.array(terms) - top).sum(axis=0)))
        del alpha[: -v.longest]
    return alpha[-1]


def fit_pieces(counts: Counter, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities of one language by expectation-maximisation over all segmentations."""
    v = pieces()
    # Whole words with their mark, and longer ones in parts: only pieces across a cut are missed.
    parts: Counter = Counter()
    for w, n in counts.items():
        s = _START + w
        for a in range(0, len(s), LONG + 1):
            parts[s[a : a + LONG + 1]] += n
    words = sorted(parts)
    weight = np.array([parts[w] for w in words], dtype=float)
    lengths: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        lengths.setdefault(len(w), []).append(i)
    size = len(v.pieces) + 2
    p = np.full(size, 1.0 / size)
    p[v.none] = 0
    grids = [(m, own, v.lattice(_points([words[i] for i in own], m))) for m, own in lengths.items()]
    for _ in range(rounds):
        expected = np.zeros(size)
        for m, own, grid in grids:
            n = len(own)
            alpha = np.vstack([np.ones((1, n)), np.zeros((m, n))])
            beta = np.vstack([np.zeros((m, n)), np.ones((1, n))])
            for (j, l), (rows, ids) in sorted(grid.items()):
                alpha[j, rows] += alpha[j - l, rows] * p[ids]
            for (j, l), (rows, ids) in sorted(grid.items(), key=lambda g: -(g[0][0] - g[0][1])):
                beta[j - l, rows] += beta[j, rows] * p[ids]
            scale = weight[own] / alpha[m]
            for (j, l), (rows, ids) in grid.items():
                expected += np.bincount(ids, scale[rows] * alpha[j - l, rows] * p[ids] * beta[j, rows], minlength=size)
        expected[v.none] = 0
        p = (expected + PRIOR) / (expected.sum() + PRIOR * (size - 1))
        p[v.none] = 0
    return p


@dataclass
class Model:
    languages: list[str]
    p: np.ndarray  # pieces by languages

    def scores(self, texts: list[str | None], cache: Cache) -> list[tuple[str, float]]:
        """(language, posterior) for each text; cache keeps the logarithms of words between calls."""
        if not self.languages:
            return [("und", 0.0)] * len(texts)
        bags = [words_of(t) if t else [] for t in texts]
        cache.add(set().union(*bags), self.p)
        place, table, out = cache.index.__getitem__, cache.table, []
        for bag in bags:
            if not bag:
                out.append(("und", 0.0))
                continue
            total = table[np.fromiter(map(place, bag), np.int64, len(bag))].sum(axis=0)
            best = int(total.argmax())
            # Words of a text are no independent evidence: it counts as that of TRUST words at most.
            x = (total - total[best]) * min(1.0, TRUST / len(bag))
            out.append((self.languages[best], float(1 / np.exp(x).sum())))
        return out


class Cache:
    """Rows of log P(word), which a call's new words are added to; it starts anew beyond CACHE words."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.table = np.empty((0, 0))

    def add(self, words: set[str], p: np.ndarray) -> None:
        new = words.difference(self.index)
        if len(self.index) + len(new) > CACHE:
            self.index, new = {}, words
        short, long = [w for w in new if len(w) <= LONG], [w for w in new if len(w) > LONG]
        n = len(self.index)
        rows = [self.table[:n].reshape(n, p.shape[1])] + ([forward(short, p)] if short else [])
        if long:
            with np.errstate(divide="ignore"):
                logp = np.log(p)
            rows.append(np.stack([forward_long(w, logp) for w in long]))
        self.table = np.concatenate(rows)
        self.index.update(zip(short + long, range(n, n + len(new))))


def train(docs: DataFrame) -> Model:
    """Fits on at most about SAMPLE training documents of each language, by hash of doc_id."""
    rows = docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], np.zeros((len(pieces().pieces) + 2, 0)))
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, 1.5 * SAMPLE / n))])
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)
    sample = rows.where(chosen).select("lang", "text")
    counts: dict[str, Counter] = {k: Counter() for k in sorted(sizes)}
    # Rows that share a doc_id are chosen together, so the bound is each language's own.
    turn = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("text")))

    def count(batches):
        for pdf in batches:
            found = Counter((lang, w) for lang, text in zip(pdf["lang"], pdf["text"]) for w in words_of(text))
            yield pd.DataFrame([(*k, n) for k, n in found.items()], columns=["lang", "word", "n"]).astype({"n": "int64"})

    words = sample.withColumn("turn", turn).where(F.col("turn") <= 2 * SAMPLE).select("lang", "text").mapInPandas(count, "lang string, word string, n long")
    for r in words.groupBy("lang", "word").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["lang"]][r["word"]] = r["n"]
    known = [k for k in counts if counts[k]]
    return Model(known, np.stack([fit_pieces(counts[k]) for k in known], axis=1) if known else np.zeros((len(pieces().pieces) + 2, 0)))


def identify_languages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs(doc_id, text)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # pieces by languages

    def run(batches):
        cache = Cache()
        for pdf in batches:
            scored = shared.value.scores(pdf["text"].tolist(), cache)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "held_out": pdf["held_out"], "lang_pred": [s[0] for s in scored], "score": [s[1] for s in scored]})

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify_languages(docs, train(docs))
