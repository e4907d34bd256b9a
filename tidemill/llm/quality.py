"""Quality classifier: a linear hinge-loss model on naive Bayes scaled n-grams.

Indicators of words and word pairs are scaled by the log ratio of their smoothed counts
in the two classes; dual coordinate descent fits a linear support vector machine to the
scaled indicators; a logistic curve over cross-fitted margins turns a margin into a
score from 0 to 1. The model is fitted to a bounded sample of the labelled training rows
and applied to every whole text.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import checkpointed, text_udf

#: Hashed n-grams.
BITS = 18


def ngrams(text: str | None) -> np.ndarray:
    """Distinct hashed words and word pairs of a whole text."""
    parts = (text or "").encode().split()
    one = np.fromiter(map(zlib.crc32, parts), np.uint64, len(parts))
    two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
    return np.unique(np.concatenate([(one * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS), two >> np.uint64(64 - BITS)]).astype(np.uint32))


@dataclass
class Model:
    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, rows: np.ndarray) -> float:
        return self.of(self.weight[rows].sum() + self.bias)

    def of(self, margin):
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40)))


def _ratios(rows: list[np.ndarray], y: np.ndarray, smoothing: float) -> np.ndarray:
    counts = np.full((2, 1 << BITS), smoothing)
    for x, label in zip(rows, y, strict=True):
        counts[int(label > 0), x] += 1
    p = counts / counts.sum(1, keepdims=True)
    return np.log(p[1] / p[0])


def _descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss; the two classes weigh the same.

    Each row is scaled to length 1, so that long and short texts have one margin scale.
    """
    rng = np.random.default_rng(seed)
    w, b = np.zeros(1 << BITS), 0.0
    scale = np.array([1 / np.sqrt((ratio[x] ** 2).sum() + 1) for x in rows])
    most = cost * len(y) / (2 * np.where(y > 0, max(1, (y > 0).sum()), max(1, (y < 0).sum())))
    alpha = np.zeros(len(y))
    values = [ratio[x] * s for x, s in zip(rows, scale, strict=True)]
    norm = np.array([(v**2).sum() + s * s for v, s in zip(values, scale, strict=True)])
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            gradient = y[i] * (values[i] @ w[rows[i]] + b * scale[i]) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), most[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * values[i]
                b += step * scale[i]
                alpha[i] = new
    return w * ratio, b


def fit(rows: list[np.ndarray], quality: np.ndarray, smoothing: float = 1.0, cost: float = 1.0, epochs: int = 8, folds: int = 4, seed: int = 5) -> Model:
    """Margins for the logistic curve come from rows that their model hasn't seen."""
    y = np.where(np.asarray(quality) > 0, 1.0, -1.0)
    share = float((y > 0).mean()) if len(y) else 0.5
    if len(y) < 2 * folds or share in (0.0, 1.0):
        odds = min(max(share, 0.01), 0.99)
        return Model(np.zeros(1 << BITS), 0.0, 1.0, float(np.log(odds / (1 - odds))))
    margin = np.zeros(len(y))
    part = np.random.default_rng(seed).permutation(len(y)) % folds
    for k in range(folds):
        own = [rows[i] for i in np.flatnonzero(part != k)]
        ratio = _ratios(own, y[part != k], smoothing)
        w, b = _descend(own, y[part != k], ratio, cost, epochs, seed)
        for i in np.flatnonzero(part == k):
            margin[i] = (w[rows[i]].sum() + b) / np.sqrt((ratio[rows[i]] ** 2).sum() + 1)
    slope, shift = _logistic(margin, y > 0)
    ratio = _ratios(rows, y, smoothing)
    w, b = _descend(rows, y, ratio, cost, epochs, seed)
    return _Scaled(w, b, slope, shift, ratio**2)


@dataclass
class _Scaled(Model):
    square: np.ndarray = None

    def score(self, rows: np.ndarray) -> float:
        return self.of((self.weight[rows].sum() + self.bias) / np.sqrt(self.square[rows].sum() + 1))


def _logistic(margin: np.ndarray, label: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and shift by Newton's method, towards smoothed labels and with a light prior."""
    n1, n0 = label.sum(), (~label).sum()
    goal = np.where(label, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margin, np.ones_like(margin)], 1)
    theta = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - goal) + 1e-3 * theta * [1, 0])
        theta -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
    return float(theta[0]), float(theta[1])


def is_held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = 6000, most_bytes: int = 256 << 20, seed: int = 11) -> Model:
    """Fit to at most ``rows`` labelled rows outside the held-out part, drawn by a hash.

    Their n-grams take ``most_bytes`` on the driver at most: rows past that are left out,
    in the order of the hash. A document labelled more than once takes its smallest label,
    and one that occurs more than once its smallest text; null labels, ids and texts are
    left out.
    """
    chosen = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out())
    chosen = chosen.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("quality").alias("quality"))
    place = F.xxhash64(F.lit(seed), "_id")
    chosen = F.broadcast(chosen.orderBy(place, "_id").limit(rows))
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("_id"), "text").join(chosen, "_id")

    def features(batches):
        for batch in batches:
            yield pd.DataFrame({"_id": batch._id, "quality": batch.quality, "digest": [hashlib.sha256(t.encode()).digest() for t in batch.text], "x": [ngrams(t).tobytes() for t in batch.text]})

    found = checkpointed(texts.mapInPandas(features, "_id long, quality int, digest binary, x binary"))
    # a document that occurs more than once is one example
    once = found.groupBy("_id", "quality").agg(F.min("digest").alias("digest"), F.min_by(F.octet_length("x"), "digest").alias("size"))
    kept = once.withColumn("upto", F.sum("size").over(Window.orderBy(place, "_id"))).where(F.col("upto") <= most_bytes).select("_id", "digest")
    sample = found.join(F.broadcast(kept), ["_id", "digest"]).dropDuplicates(["_id"]).toPandas().sort_values("_id")
    return fit([np.frombuffer(x, np.uint32) for x in sample.x], sample.quality.to_numpy())


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """``docs`` with its columns and quality_score, quality_label (1: at or over the threshold)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a weight for each hashed n-gram: 2 ** BITS

    scored = text_udf(lambda text: float(shared.value.score(ngrams(text))), "double")
    out = docs.withColumn("quality_score", scored("text"))
    return out.withColumn("quality_label", (F.col("quality_score") >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text).

    A null or empty text is scored by the bias alone; a null doc_id is not held out;
    repeated rows are scored alike; without labels every score is the middle one.
    """
    found = score(docs.select("doc_id", "text"), train(docs, labels), threshold)
    return found.select("doc_id", is_held_out().alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_label").alias("predicted"))
