"""Language identification by sparse multinomial logistic regression.

Features are hashed byte n-grams (1 to 3 bytes of the lower-cased text, words
padded by spaces) weighted by (1 + log tf) * idf and scaled to unit length.
Document frequencies count every labelled learnable document.  The weights are
trained on the driver by follow-the-regularised-leader with L1 and L2 penalties
over a bounded sample (about ``max_fit`` distinct rows, chosen by hash, plus
``max_calibrate`` for calibration, and at least ``least`` rows of every language or
all it has); only their sparse features are gathered.
A temperature fitted on the calibration rows scales the scores.  Each whole text
is then scored in one pass over the documents.

A null text, or one without a letter, gets ``und`` with score 0.  Without any
labelled row every text gets ``und``.  Ties between languages go to the first in
alphabetical order.  Repeated rows are scored one by one; extra columns stay out
of the features.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, sample

UND = "und"
BITS = 15
DIM = 1 << BITS
SLICE = 1 << 22
LETTER = re.compile(r"[^\W\d_]")


def gram_counts(text: str) -> np.ndarray:
    """Counts of the hashed 1-, 2- and 3-grams of a whole text, in slices."""
    raw = f" {text.lower()} ".encode("utf-8", "replace")
    counts = np.zeros(DIM, np.int64)
    for lo in range(0, len(raw), SLICE):
        part = np.frombuffer(raw, np.uint8, min(len(raw) - lo, SLICE + 2), lo).astype(np.uint32)
        own = min(SLICE, len(raw) - lo)
        # three tables in one: the order of a gram is part of its key
        two = part[:-1] << 8 | part[1:]
        three = two[:-1] << 8 | part[2:]
        for order, keys in ((1, part[:own]), (2, two[:own] | 1 << 24), (3, three[:own] | 2 << 24)):
            hashed = keys * np.uint32(0x9E3779B1 + 2 * order) >> np.uint32(32 - BITS)
            counts += np.bincount(hashed, minlength=DIM)
    return counts


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(indexes, 1 + log tf)."""
    counts = gram_counts(text)
    at = np.flatnonzero(counts)
    return at, (1 + np.log(counts[at])).astype(np.float32)


def weighted(at: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = tf * idf[at]
    return v / max(float(np.sqrt((v * v).sum())), 1e-9)


def document_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold each feature, over all rows, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIM + 1, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                df[:-1] += gram_counts(text.as_py() or "") > 0
                n += 1
        df[-1] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIM + 1)), pa.array(df)], ["feature", "n"])

    rows = docs.select("text").mapInArrow(run, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()  # DIM + 1 rows
    out = np.zeros(DIM + 1, np.int64)
    out[rows.column("feature").to_numpy()] = rows.column("n").to_numpy()
    return out[:-1], int(out[-1])


def gather(docs: DataFrame, limit: int, least: int) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(label, indexes, tf) of about ``limit`` distinct rows (doc_id, text, label), in
    proportion, but at least ``least`` of each label, in a fixed order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, at, tf = [], [], []
            for y, text in zip(batch.column("label"), batch.column("text"), strict=True):
                a, v = features(text.as_py() or "")
                label.append(y.as_py())
                at.append(a.astype(np.uint16).tobytes())
                tf.append(v.astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("_hash"), pa.array(label, pa.string()), pa.array(at, pa.binary()), pa.array(tf, pa.binary())], ["h", "label", "at", "tf"])

    chosen = sample(docs, limit, by="label", least=least).select("_hash", "label", "text")
    rows = sorted(chosen.mapInArrow(run, "h bigint, label string, at binary, tf binary").collect(), key=lambda r: r.h)
    return [(r.label, np.frombuffer(r.at, np.uint16).astype(np.int64), np.frombuffer(r.tf, np.float16).astype(np.float32)) for r in rows]


def train_ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int, *, alpha: float, beta: float, l1: float, l2: float, epochs: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal with per-coordinate rates; (weights, bias)."""
    z = np.zeros((DIM, classes), np.float32)
    n = np.zeros((DIM, classes), np.float32)
    zb, nb = np.zeros(classes, np.float32), np.zeros(classes, np.float32)
    rng = np.random.default_rng(seed)

    def weights(z, n):
        w = -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2)
        return np.where(np.abs(z) <= l1, 0, w)

    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            y, at, v = rows[k]
            w, b = weights(z[at], n[at]), -zb / ((beta + np.sqrt(nb)) / alpha)
            p = softmax(v @ w + b)
            p[y] -= 1
            g = v[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
            zb += p - (np.sqrt(nb + p * p) - np.sqrt(nb)) / alpha * b
            nb += p * p
    return weights(z, n).astype(np.float32), (-zb / ((beta + np.sqrt(nb)) / alpha)).astype(np.float32)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least negative log-likelihood."""
    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


class Model:
    def __init__(self, labels: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.labels, self.idf, self.weights, self.bias, self.temperature = labels, idf, weights, bias, temperature

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.labels or not LETTER.search(text):
            return UND, 0.0
        at, tf = features(text)
        p = softmax((weighted(at, tf, self.idf) @ self.weights[at] + self.bias) / self.temperature)
        k = int(np.argmax(p))
        return self.labels[k], float(p[k])


def fit(labelled: DataFrame, *, max_fit: int = 6000, max_calibrate: int = 1500, least: int = 300, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.5, epochs: int = 5) -> Model:
    """Train on rows (doc_id, text, label); null labels and texts are left out."""
    labelled = labelled.where("label IS NOT NULL AND text IS NOT NULL")
    df, n = document_frequency(labelled)
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + 1
    rows = gather(labelled.select("doc_id", "text", "label"), max_fit + max_calibrate, least)
    labels = sorted({r[0] for r in rows})
    number = {y: k for k, y in enumerate(labels)}
    data = [(number[y], at, weighted(at, tf, idf)) for y, at, tf in rows]
    held = max(1, len(data) * max_calibrate // (max_fit + max_calibrate)) if len(data) > 20 else 0
    order = np.random.default_rng(3).permutation(len(data))
    train, calibrate = [data[k] for k in order[held:]], [data[k] for k in order[:held]]
    weights, bias = train_ftrl(train, max(1, len(labels)), alpha=alpha, beta=beta, l1=l1, l2=l2, epochs=epochs)
    logits = np.array([v @ weights[at] + bias for _, at, v in calibrate]) if calibrate else np.zeros((0, 1))
    return Model(labels, idf, weights, bias, fit_temperature(logits, np.array([y for y, _, _ in calibrate], int)))


def predictor(model: Model):
    """A column function: struct(lang_pred, score) of a text column."""

    @F.pandas_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    def predict(texts):
        import pandas as pd

        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score"])

    return predict


def identify(docs: DataFrame, learnable: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", **options) -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``score`` beside them (columns of
    these names are replaced); only rows where ``learnable`` holds are learnt from."""
    known = docs.where(learnable).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(label_col).alias("label"))
    predict = predictor(fit(known, **options))
    name = fresh(docs, "_lang")
    scored = docs.withColumn(name, predict(F.col(text_col)))
    return scored.withColumns({"lang_pred": F.col(f"{name}.lang_pred"), "score": F.col(f"{name}.score")}).drop(name)
