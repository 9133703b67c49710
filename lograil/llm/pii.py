"""Personal data: base patterns, and further spans by weak supervision.

Base spans (email, ip, card, phone) are fixed patterns with a check each; those that fail it are dropped.
The method adds spans. Wider patterns propose candidates of each kind and of `secret`; labelers vote for or
against each one or abstain: the strict pattern with its check, a gazetteer of fixed words and prefixes, words
before the candidate, and its shape. Over all documents, candidates of equal kind and votes are counted, a
table whose size depends on the labelers alone. On it, expectation-maximisation estimates the labelers'
reliabilities and each pattern's probability. These are the soft labels of a logistic span classifier, which sees
the votes and the span itself: its characters' form, length, first and last characters, and the words and marks
on both sides. It is trained on a bounded sample of candidates, about TRAIN_SPANS of each kind, chosen by a hash
of the span and its surroundings. Candidates that it accepts, where they touch no base span, are added.

All searches are linear in the text: emails are found from their @ outwards, no pattern can backtrack over
a run more than once, and none is limited in length. Defined cases: null text is empty and has no spans; a null
doc_id stays null; an empty table gives no rows and trains nothing (base spans only); equal rows are rows each;
extra columns are ignored by the search and kept by the masking.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, small_batches

#: Candidates of each kind that the classifier is trained on, about; numbers that features are hashed to; code points of context.
TRAIN_SPANS, FEATURES, AROUND = 4_000, 1 << 14, 24
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT, _DIGITS = re.compile(r"[0-9]"), re.compile(r"[^0-9]+")

# Candidates beyond the base patterns.
_AT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]?\x20?at\x20?[\])]?\x20?[A-Za-z0-9-]++\x20?[\[(]?\x20?(?:dot|\.)\x20?[\])]?\x20?[A-Za-z]{2,10}\b")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
_SECRET = re.compile(r"(?i:(?<![a-z])(?:password|passwd|pwd|token|secret|api[_-]?key)\x20?[=:]\x20?)[\"']?([A-Za-z0-9+/_-]{8,}+)|\b(AKIA[0-9A-Z]{16})\b")

# Fixed values of the gazetteers and of the words that stand before personal data, or before other numbers.
TOP_DOMAINS = frozenset("com org net edu gov info io de fr es uk eu us".split())
CARD_PREFIXES = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65")
CUES = {
    "email": frozenset("mail email e-mail contact write address correo courriel".split()),
    "ip": frozenset("ip address host server client from".split()),
    "card": frozenset("card visa mastercard amex credit debit tarjeta carte karte".split()),
    "phone": frozenset("phone tel telephone call mobile cell fax telefon telefono".split()),
    "secret": frozenset("password passwd pwd token secret key api".split()),
}
OTHER_CUES = frozenset("version isbn issn page order line chapter section invoice no number id".split())


def luhn(digits: str) -> bool:
    odd = digits[-1::-2]
    even = digits[-2::-2]
    return (sum(map(int, odd)) + sum(2 * int(d) - 9 * (d > "4") for d in even)) % 10 == 0


def _emails(text: str):
    at = text.find("@")
    after = 0
    while at >= 0:
        if at >= after and (m := _DOMAIN.match(text, at)):
            start = at
            while start > after and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start < at:
                yield start, m.end()
                after = m.end()
        at = text.find("@", max(at + 1, after))


def _octets(s: str) -> bool:
    return all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in s.split("."))


def base_spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(spans, matches that failed their check), each (start, end, kind)."""
    good, bad = [], []
    if "@" in text:
        good += [(a, b, "email") for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return good, bad
    if "." in text:
        for m in _IP.finditer(text):
            (good if _octets(m.group()) else bad).append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            good.append((*m.span(), "card"))
        elif 13 <= len(digits) <= 19:
            bad.append((*m.span(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            n = len(_DIGITS.sub("", m.group()))
            if 10 <= n <= 15:
                good.append((*m.span(), "phone"))
            elif n >= 8:
                bad.append((*m.span(), "phone"))
    return good, bad


def weak_spans(text: str) -> list[tuple[int, int, str]]:
    """Further candidates."""
    out = []
    if "dot" in text or "@" in text or "(at" in text or "[at" in text or "( at" in text or "[ at" in text:
        out += [(*m.span(), "email") for m in _AT.finditer(text)]
    if _DIGIT.search(text):
        out += [(*m.span(), "phone") for m in _LOCAL_PHONE.finditer(text)]
    if "=" in text or ":" in text or "AKIA" in text:
        out += [(*m.span(1 if m.group(1) else 2), "secret") for m in _SECRET.finditer(text)]
    return out


#: A pattern: kind and votes of the labelers in order, a small closed set.
LABELERS = ("strict", "gazetteer", "context", "shape")
_BEFORE, _AFTER = re.compile(r"[A-Za-z-]+"), re.compile(r"[^\W\d_]+")


def describe(text: str, start: int, end: int, kind: str, strict: bool) -> str:
    """The pattern of one candidate, as kind|votes."""
    s = text[start:end]
    digits = _DIGITS.sub("", s)
    before = [w.lower() for w in _BEFORE.findall(text[max(0, start - AROUND) : start])[-3:]]
    pattern = 1 if strict else (0 if kind == "secret" else -1)
    if kind == "email":
        gazetteer = 1 if s.rpartition(".")[2].lower() in TOP_DOMAINS else (1 if s.split()[-1].lower() in TOP_DOMAINS else -1)
        shape = 1 if "@" in s or "(at)" in s or "[at]" in s else -1
    elif kind == "ip":
        gazetteer = 1 if not s.startswith(("0", "255")) else -1
        shape = 1 if 7 <= len(s) <= 15 else -1
    elif kind == "card":
        gazetteer = 1 if digits.startswith(CARD_PREFIXES) else -1
        shape = 1 if len(digits) in (15, 16) else -1
    elif kind == "phone":
        gazetteer = 1 if s.startswith("+") else 0
        shape = 1 if 10 <= len(digits) <= 13 and len(s) > len(digits) else -1
    else:
        gazetteer = 1 if s.startswith("AKIA") or not before else 0
        classes = sum(bool(re.search(c, s)) for c in ("[a-z]", "[A-Z]", "[0-9]"))
        shape = 1 if classes >= 2 else -1
    near = 1 if CUES[kind].intersection(before) else (-1 if OTHER_CUES.intersection(before) else 0)
    return f"{kind}|{pattern},{gazetteer},{near},{shape}"


def form(s: str) -> str:
    """Digits as 9, letters as a or A, other characters as they are; runs of one of them once."""
    out = []
    for c in s:
        c = "9" if c.isdecimal() else "A" if c.isupper() else "a" if c.isalpha() else c
        if not out or out[-1] != c:
            out.append(c)
            if len(out) == 24:
                break
    return "".join(out)


def span_features(text: str, start: int, end: int, pattern: str) -> list[int]:
    """Hashed features of a candidate: its votes, its characters and what stands round it."""
    kind, votes = pattern.split("|")
    s, left, right = text[start:end], text[max(0, start - AROUND) : start], text[end : end + AROUND]
    before, after = _AFTER.findall(left.lower()), _AFTER.findall(right.lower())
    found = [
        "", *(f"{n}{v}" for n, v in zip(LABELERS, votes.split(","))), f"votes{votes}", f"form{form(s)}",
        f"size{min(40, end - start)}", f"long{(end - start).bit_length()}", f"digits{min(20, sum(map(str.isdecimal, s)))}",
        f"first{s[:1]}", f"head{s[:2]}", f"last{s[-3:].lower()}", f"left{left[-1:]}", f"right{right[:1]}",
        f"glued{left[-1:].isalnum()}{right[:1].isalnum()}", *(f"before{w}" for w in before[-2:]), *(f"after{w}" for w in after[:1]),
    ]
    return sorted({zlib.crc32(f"{kind} {f}".encode("utf-8", "surrogatepass")) % FEATURES for f in found})


def estimate(patterns: dict[str, int], rounds: int = 50) -> tuple[dict[str, float], dict[str, np.ndarray]]:
    """Each pattern's probability of being personal data, and for each kind the labelers' P(vote | truth)."""
    truth, reliability = {}, {}
    for kind in KINDS:
        own = [p for p in patterns if p.startswith(kind + "|")]
        if not own:
            continue
        votes = np.array([list(map(int, p.split("|")[1].split(","))) for p in own]) + 1
        n = np.array([patterns[p] for p in own], dtype=float)
        q = np.clip(0.5 + 0.2 * (votes - 1).sum(axis=1), 0.05, 0.95)
        for _ in range(rounds):
            prior = np.clip((n @ q + 1) / (n.sum() + 2), 0.02, 0.98)
            table = np.ones((votes.shape[1], 2, 3))  # labeler, truth, vote; one count each against certainty
            table[:, 0, 0] += 2
            table[:, 1, 2] += 2
            for j in range(votes.shape[1]):
                for v in range(3):
                    hit = votes[:, j] == v
                    table[j, 0, v] += n[hit] @ (1 - q[hit])
                    table[j, 1, v] += n[hit] @ q[hit]
            table /= table.sum(axis=2, keepdims=True)
            logs = np.log(table)
            odds = math.log(prior / (1 - prior)) + sum(logs[j, 1, votes[:, j]] - logs[j, 0, votes[:, j]] for j in range(votes.shape[1]))
            q = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        truth |= dict(zip(own, q.tolist()))
        reliability[kind] = table
    return truth, reliability


@dataclass
class Model:
    """The span classifier."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    reliability: dict[str, np.ndarray] = field(default_factory=dict)

    def accepts(self, text: str, start: int, end: int, pattern: str) -> bool:
        return bool(len(self.weights)) and float(self.weights[span_features(text, start, end, pattern)].sum()) >= 0


def fit(patterns: dict[str, int], spans: list[tuple[str, np.ndarray]], steps: int = 300) -> Model:
    """patterns: how often each occurs; spans: patterns and features of the sample."""
    if not patterns or not spans:
        return Model()
    truth, reliability = estimate(patterns)
    at = np.repeat(np.arange(len(spans)), [len(f) for _, f in spans])
    ix = np.concatenate([f for _, f in spans])
    y, w, seen = np.array([truth[p] for p, _ in spans]), np.zeros(FEATURES), np.zeros(FEATURES)
    for _ in range(steps):  # AdaGrad on the whole sample
        q = 1 / (1 + np.exp(-np.clip(np.bincount(at, w[ix], minlength=len(y)), -30, 30)))
        g = np.bincount(ix, (q - y)[at], minlength=FEATURES) / len(y) + 1e-5 * w
        seen += g * g
        w -= 0.3 * g / np.sqrt(seen + 1e-10)
    return Model(w, reliability)


def candidates(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str, str]]]:
    """Base spans, and (start, end, kind, pattern) of all candidates with them."""
    good, bad = base_spans(text)
    found = [(a, b, k, describe(text, a, b, k, True)) for a, b, k in good]
    found += [(a, b, k, describe(text, a, b, k, k == "secret")) for a, b, k in [*bad, *weak_spans(text)]]
    return good, found


def train(docs: DataFrame) -> Model:
    """Counts the patterns of all documents, and fits the classifier on a sample of the candidates."""
    small_batches(docs.sparkSession)
    docs = docs.select("text").where("text is not null")

    def count(batches):
        counts: dict[str, int] = {}
        for pdf in batches:
            for text in pdf["text"]:
                for *_, p in candidates(text)[1]:
                    counts[p] = counts.get(p, 0) + 1
        yield pd.DataFrame({"pattern": list(counts), "n": list(counts.values())}).astype({"pattern": "object", "n": "int64"})

    found = docs.mapInPandas(count, "pattern string, n long")
    # At most kinds x votes rows: 5 x 81.
    patterns = {r.pattern: r.n for r in found.groupBy("pattern").agg(F.sum("n").alias("n")).collect()}
    total = {k: sum(n for p, n in patterns.items() if p.startswith(k + "|")) for k in KINDS}
    share = {k: min(1 << 32, (TRAIN_SPANS << 32) // n) for k, n in total.items() if n}

    def sample(batches):
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                for a, b, k, p in candidates(text)[1]:
                    key = zlib.crc32(text[max(0, a - AROUND) : b + AROUND].encode("utf-8", "surrogatepass"))
                    if key < share[k]:
                        rows.append((key, p, np.array(span_features(text, a, b, p), np.int32).tobytes()))
            yield pd.DataFrame(rows, columns=["key", "pattern", "features"]).astype({"key": "int64"})

    # Equal spans in equal surroundings count once, so a third of all rows may be copies.
    spans = docs.mapInPandas(sample, "key long, pattern string, features binary").distinct().orderBy("key", "pattern", "features") if share else None
    return fit(patterns, [(r.pattern, np.frombuffer(r.features, np.int32)) for r in spans.limit(2 * TRAIN_SPANS * len(KINDS)).collect()] if share else [])


def all_spans(text: str, model: Model) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans and all spans, in the order of start and kind; added ones touch no other span."""
    good, found = candidates(text)
    rank = {k: i for i, k in enumerate(KINDS)}
    key = lambda s: (s[0], rank[s[2]], s[1])
    every = list(good)
    taken = sorted((a, b) for a, b, _ in good)
    base = set(good)
    for a, b, k, p in sorted(found, key=key):
        if (a, b, k) not in base and model.accepts(text, a, b, p) and not any(x < b and a < y for x, y in taken):
            every.append((a, b, k))
            taken.append((a, b))
    return sorted(good, key=key), sorted(every, key=key)


def digest(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"


def find_personal_data(docs: DataFrame, model: Model) -> DataFrame:
    """One row of OUT for each row of docs(doc_id, text)."""
    small_batches(docs.sparkSession)
    names = [c.split()[0] for c in OUT.split(", ")]

    def run(batches):
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                base, every = all_spans(text, model)
                kinds = [k for *_, k in base]
                rows.append((doc_id, *map(kinds.count, BASE), hashlib.sha256(digest(base).encode()).hexdigest(), digest(every), len(every)))
            out = pd.DataFrame(rows, columns=names)
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, OUT)


def mask_personal_data(docs: DataFrame, model: Model) -> DataFrame:
    """docs with each span of its text replaced by its kind in brackets; null text stays null."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            if t is None:
                out.append(None)
                continue
            at, parts = 0, []
            for a, b, k in all_spans(t, model)[1]:
                if a >= at:
                    parts += [t[at:a], f"[{k}]"]
                at = max(at, b)
            out.append("".join([*parts, t[at:]]) if parts else t)
        return pd.Series(out, dtype=object)

    return docs.withColumn("text", mask("text"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return find_personal_data(docs, train(docs))
