"""Toxicity by cumulative-link ordinal regression over sparse text features.

P(grade <= k) = sigmoid(theta_k - w.x): one weight vector serves all ordered thresholds theta_1 < theta_2 < ...
x holds the lower-cased words of a text and their first four, five and six letters, by presence.

Training takes a bounded sample of labelled rows (about TRAIN_ROWS, by hash of doc_id) with their whole texts.
Executors count each feature in its toxic and harmless texts; features whose rate of toxic texts surely differs
from the common one are kept, at most FEATURES. Only the counts of those, and the sample's rows as numbers of
features, reach the driver.

Tables with a `severity` column give the grades. From toxic 0/1 alone, a toxic text of one half gets grades
1 to GRADES - 1 by thirds of how many features it holds that the other half's labels find typical of toxic
texts, so no text's own label chooses the features that grade it. The grade that is reported is the median.

Scoring reads every whole text. Defined cases: null and empty texts have no features and get the grade of
an empty text; a null label, or one whose document is missing, is left out; repeated labels of a document
count once, by the highest; rows of a repeated doc_id share its label and are rows each; a null doc_id is
scored but has no label; without toxic and harmless labels nothing is toxic and the severity is 0; an empty
table gives no rows; other columns pass through.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, read, small_batches

#: Labelled rows that the fit may use, about, and features it may keep.
TRAIN_ROWS, FEATURES = 6_000, 20_000
GRADES, PREFIXES = 4, (4, 5, 6)
#: A feature is kept if its counts in toxic and harmless texts are e^EVIDENCE times likelier at its own rate
#: than at the common one; with some hundred thousand features, chance keeps about one.
EVIDENCE = 12.0
_WORD = re.compile(r"[^\W\d_]+")


def features(text: str) -> set[str]:
    """Words, and prefixes marked by a trailing star."""
    words = set(_WORD.findall(text.lower()))
    found = set(words)
    for n in PREFIXES:
        found.update([w[:n] + "*" for w in words if len(w) > n])
    return found


@dataclass
class Model:
    index: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def score(self, text: str) -> float:
        hit = features(text).intersection(self.index.keys())
        return float(self.weights[sorted(self.index[f] for f in hit)].sum()) if hit else 0.0

    def grades(self, s: np.ndarray) -> np.ndarray:
        """P(grade = k) for each score."""
        upto = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - s[:, None], -40, 40)))
        n = len(s)
        return np.diff(np.concatenate([np.zeros((n, 1)), upto, np.ones((n, 1))], axis=1), axis=1)


def fit_ordinal(rows: list[np.ndarray], y: np.ndarray, size: int, grades: int = GRADES, steps: int = 400, l2: float = 1e-5):
    """(weights, thresholds) of the cumulative-link model, by Adam on the whole sample."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    ix = np.concatenate(rows) if len(rows) else np.empty(0, np.int64)
    share = np.cumsum(np.bincount(y, minlength=grades) + 1.0)[:-1] / (len(y) + grades)
    start = np.log(share / (1 - share))
    p = np.concatenate([np.zeros(size), [start[0]], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        w, gaps = p[:size], np.exp(p[size + 1 :])
        theta = np.concatenate([[p[size]], p[size] + np.cumsum(gaps)])
        s = np.bincount(at, w[ix], minlength=len(rows))
        f = 1 / (1 + np.exp(-np.clip(theta[None, :] - s[:, None], -40, 40)))
        f = np.concatenate([np.zeros((len(rows), 1)), f, np.ones((len(rows), 1))], axis=1)
        hi, lo = f[np.arange(len(y)), y + 1], f[np.arange(len(y)), y]
        prob = np.maximum(hi - lo, 1e-12)
        ds = 1 - hi - lo  # slope of -log P by the score
        gw = np.bincount(ix, ds[at], minlength=size) / len(rows) + l2 * w
        slope = f * (1 - f)
        gt = np.zeros(grades - 1)
        np.add.at(gt, np.minimum(y, grades - 2), np.where(y < grades - 1, -slope[np.arange(len(y)), y + 1] / prob, 0))
        np.add.at(gt, np.maximum(y - 1, 0), np.where(y > 0, slope[np.arange(len(y)), y] / prob, 0))
        gt /= len(rows)
        g = np.concatenate([gw, [gt.sum()], np.cumsum(gt[::-1])[::-1][1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    theta = np.concatenate([[p[size]], p[size] + np.cumsum(np.exp(p[size + 1 :]))])
    return p[:size], theta


def thirds(counts: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Grades 1 .. GRADES - 1 of toxic rows by the middle rank of their counts among them; 0 of the others."""
    own = np.sort(counts[toxic])
    rank = (np.searchsorted(own, counts, side="left") + np.searchsorted(own, counts, side="right")) / 2
    return np.where(toxic, 1 + np.minimum(GRADES - 2, (rank * (GRADES - 1) / max(1, len(own))).astype(int)), 0)


def gain(c1: np.ndarray, c0: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Log likelihood ratio of a feature's own rate of toxic texts to the common one."""
    q, base = c1 / np.maximum(c0 + c1, 1), n1 / max(1, n0 + n1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(c1 > 0, c1 * np.log(q / base), 0) + np.where(c0 > 0, c0 * np.log((1 - q) / (1 - base)), 0)


def _count_features(batches):
    for pdf in batches:
        counts: dict[str, list[int]] = {}
        for text, half, y in zip(pdf["text"], pdf["half"], pdf["y"]):
            for f in features(text):
                counts.setdefault(f, [0, 0, 0, 0])[2 * half + (y > 0)] += 1
        names = ["c00", "c01", "c10", "c11"]
        yield pd.DataFrame([(f, *c) for f, c in counts.items()], columns=["feature", *names]).astype({n: "int64" for n in names})


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on about TRAIN_ROWS labelled documents, chosen by a hash of doc_id."""
    small_batches(docs.sparkSession)
    graded = "severity" in labels.columns
    grade = F.col("severity").cast("int") if graded else F.col("toxic").cast("int")
    labels = labels.select("doc_id", grade.alias("y")).where("doc_id is not null and y is not null")
    n = labels.count()
    if not n:
        return Model()
    share = min(1.0, TRAIN_ROWS / n)
    chosen = F.xxhash64("doc_id")
    sample = labels.where(F.pmod(chosen, F.lit(1 << 20)) < int(share * (1 << 20))) if share < 1 else labels
    sample = sample.groupBy("doc_id").agg(F.max("y").alias("y")).withColumn("half", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(2)).cast("int"))
    # About TRAIN_ROWS rows of three numbers. A doc_id has one row of them, and one of its texts, so the rows stay bounded.
    texts = docs.select("doc_id", "text").where("text is not null and doc_id is not null").join(F.broadcast(sample), "doc_id")
    texts = checkpointed(texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"), F.first("half").alias("half")))
    sizes = texts.groupBy("half", (F.col("y") > 0).cast("int").alias("toxic")).count().collect()
    total = {(r.half, r.toxic): r["count"] for r in sizes}
    n0, n1 = (np.array([total.get((h, t), 0) for h in (0, 1)]) for t in (0, 1))
    if not n1.sum() or not n0.sum():
        return Model()
    counted = texts.mapInPandas(_count_features, "feature string, c00 long, c01 long, c10 long, c11 long")
    counted = counted.groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("c00", "c01", "c10", "c11")]).where("c00 + c01 + c10 + c11 > 1")
    one, none, base = F.col("c01") + F.col("c11"), F.col("c00") + F.col("c10"), n1.sum() / (n0.sum() + n1.sum())
    term = lambda c, rate: F.when(c > 0, c * F.log(c / (one + none) / float(rate))).otherwise(0.0)
    counted = counted.withColumn("gain", term(one, base) + term(none, 1 - base)).where(F.col("gain") > EVIDENCE / 2)
    best = counted.orderBy(F.desc("gain"), "feature").limit(FEATURES).toPandas()
    index = {f: k for k, f in enumerate(best["feature"])}
    c0, c1 = best[["c00", "c10"]].to_numpy(float).T, best[["c01", "c11"]].to_numpy(float).T

    def numbered(batches):
        for pdf in batches:
            own = [np.array(sorted(index[f] for f in features(t).intersection(index.keys())), np.int32).tobytes() for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "half": pdf["half"], "own": own})

    data = texts.mapInPandas(numbered, "doc_id long, y int, half int, own binary").toPandas().sort_values("doc_id")
    rows, y, half = [np.frombuffer(x, np.int32) for x in data["own"]], np.clip(data["y"].to_numpy(np.int64), 0, GRADES - 1), data["half"].to_numpy()
    toxic = y > 0
    if not graded:  # half the rows give half the evidence
        typical = [(c1[h] * n0[h] > c0[h] * n1[h]) & (gain(c1[h], c0[h], n1[h], n0[h]) > EVIDENCE / 2) for h in (0, 1)]
        y = thirds(np.array([int(typical[1 - h][r].sum()) for r, h in zip(rows, half)]), toxic)
    kept = gain(c1.sum(axis=0), c0.sum(axis=0), int(n1.sum()), int(n0.sum())) > EVIDENCE
    place = np.cumsum(kept) - 1
    weights, thresholds = fit_ordinal([place[r[kept[r]]] for r in rows], y, int(kept.sum()))
    return Model({f: int(place[k]) for f, k in index.items() if kept[k]}, weights, thresholds)


def score_toxicity(docs: DataFrame, model: Model, cut: float = 0.5) -> DataFrame:
    """Adds grade, expected_severity, p_toxic and toxic (p_toxic >= cut) to the rows of docs.

    Columns of docs by those names are replaced.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("grade", "expected_severity", "p_toxic", "toxic")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES entries at most

    @F.pandas_udf("grade int, expected_severity double, p_toxic double, toxic boolean")
    def score(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        if not len(m.thresholds):
            n = len(texts)
            return pd.DataFrame({"grade": np.zeros(n, np.int32), "expected_severity": np.zeros(n), "p_toxic": np.zeros(n), "toxic": np.zeros(n, bool)})
        scores = np.array([m.score(t or "") for t in texts])
        p = m.grades(scores)
        grade = (scores[:, None] >= m.thresholds[None, :]).sum(axis=1)  # the median
        toxic = 1 - p[:, 0]
        return pd.DataFrame({"grade": grade.astype("int32"), "expected_severity": p @ np.arange(p.shape[1]), "p_toxic": toxic, "toxic": toxic >= cut})

    found = "lograil_toxicity"
    return docs.withColumn(found, score("text")).select(*[F.col(f"`{c}`") for c in docs.columns], f"{found}.*")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(docs, train(docs, read(spark, sf_dir, "labels"))).drop("text")
