"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the presence of hashed byte n-grams (several orders,
A-Z lower-cased) of the whole text.  Each feature's value is its log-count
ratio r = log((p / |p|) / (q / |q|)), with p and q the smoothed document counts
among toxic and other training texts; a logistic regression is learned on top.
Ratios and weights fold into one number per feature, so scoring is a sum over
the distinct features of a text.

The classifier is fitted on a bounded sample of labelled rows
(``docs_per_class`` doc_ids of each class by hash order, one row of each);
features are extracted in Spark tasks, the regression runs on the driver.

Defined cases: null and empty texts have no features and score the intercept;
null labels are not learned from; a doc_id labelled more than once counts as
toxic if any of its labels says so; of the rows that repeat a doc_id the one
whose text has the smallest hash is learned from; without both classes the score is the
share of toxic ones (0 without labels); repeated rows and null doc_ids are
scored like any other; extra columns are ignored; an empty table gives an empty
result; very long texts are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, pieces, record, stage, utf8

ORDERS, BITS = (2, 3, 4, 5), 18
_FEATURES = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("features", pa.binary())])
_SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def features(text: bytes, mark: np.ndarray) -> np.ndarray:
    """Distinct hashed n-grams of the whole text; ``mark`` is a scratch array of 2**BITS int32."""
    a = np.frombuffer(text.lower(), np.uint8).astype(np.uint64)
    out, code = [], a
    for n in range(2, max(ORDERS) + 1):
        if len(a) < n:
            break
        code = (code[:-1] << np.uint64(8)) | a[n - 1:]
        if n in ORDERS:
            out.append((((code + np.uint64(n << 56)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int32))
    if not out:
        return np.zeros(0, np.int32)
    f = np.concatenate(out)
    order = np.arange(len(f), dtype=np.int32)
    mark[f] = order
    return f[mark[f] == order]


def _extract(batches):
    mark = np.zeros(1 << BITS, np.int32)
    for batch in pieces(batches, 500):
        found = [features(t, mark).tobytes() for t in batch.column(2).to_pylist()]
        yield record(_FEATURES, doc_id=batch.column(0), label=batch.column(1), features=found)


class Classifier:
    """weights (one per hashed feature, ratio folded in) and an intercept."""

    def __init__(self, weights: np.ndarray | None, intercept: float):
        self.weights, self.intercept = weights, intercept

    def score(self, found: np.ndarray) -> float:
        z = self.intercept + (float(self.weights[found].sum(dtype=np.float64)) if self.weights is not None else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(rows: list[np.ndarray], labels: np.ndarray, epochs: int = 8, batch: int = 32, rate: float = 0.05,
        decay: float = 1e-4, seed: int = 3) -> Classifier:
    """Log-count ratios, then logistic regression on them (AdaGrad, rows in seeded order)."""
    share = float(labels.mean()) if len(labels) else 0.0
    if share in (0.0, 1.0):
        return Classifier(None, np.log(max(share, 1e-12) / max(1 - share, 1e-12)))
    size = 1 << BITS
    p, q = np.ones(size), np.ones(size)
    for f, y in zip(rows, labels, strict=True):
        (p if y else q)[f] += 1
    seen = p + q > 2
    ratio = np.where(seen, np.log(p / p.sum()) - np.log(q / q.sum()), 0.0)
    w, b = np.zeros(size), np.log(share / (1 - share))
    past, past_b, rng = np.full(size, 1e-6), 1e-6, np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), batch):
            part = order[lo:lo + batch]
            flat = np.concatenate([rows[i] for i in part])
            sizes = np.array([len(rows[i]) for i in part])
            each = np.repeat(np.arange(len(part)), sizes)
            z = b + np.bincount(each, w[flat] * ratio[flat], len(part))
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]) / len(part)
            used, back = np.unique(flat, return_inverse=True)
            g = np.bincount(back, err[each]) * ratio[used] + decay * w[used]
            past[used] += g * g
            w[used] -= rate * g / np.sqrt(past[used])
            past_b += err.sum() ** 2
            b -= rate * err.sum() / np.sqrt(past_b)
    return Classifier((w * ratio).astype(np.float32), float(b))


def train(docs: DataFrame, labels: DataFrame, learn: Column, docs_per_class: int = 1500) -> Classifier:
    """Fit on labelled rows where ``learn`` (a condition on doc_id) holds: at most ``docs_per_class`` of each class."""
    marks = stage(labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(learn)
                  .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("label")), "toxicity-labels")
    # the first of each class by hash: every task keeps at most docs_per_class, which are then merged
    first = [marks.where(wanted).orderBy(F.xxhash64("doc_id"), "doc_id").limit(docs_per_class) for wanted in (F.col("label") > 0, F.col("label") <= 0)]
    picked = first[0].unionByName(first[1])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")).join(F.broadcast(picked), "doc_id")
    # one row of a doc_id, however often it repeats: what reaches the driver is bounded by docs_per_class
    texts = texts.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("kept")).select("doc_id", "label", "kept.text")
    rows = arrow_map(texts.select("doc_id", "label", "text"), _extract, "doc_id long, label int, features binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["features"])))
    return fit([np.frombuffer(r["features"], np.int32) for r in rows], np.array([r["label"] for r in rows], np.float64))


def _score(model):
    def run(batches):
        mark = np.zeros(1 << BITS, np.int32)
        for batch in pieces(batches, 1000):
            yield record(_SCORES, doc_id=batch.column(0), score=[model.value.score(features(t, mark)) for t in batch.column(1).to_pylist()])
    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, docs_per_class: int = 1500) -> DataFrame:
    """doc_id, score (0 to 1): one row per row of ``docs``."""
    model = train(docs, labels, learn, docs_per_class)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text"))
    return arrow_map(base, _score(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, score double")
