"""Toxicity by non-negative positive-unlabelled learning.

A numpy logistic classifier on hashed word presence is trained from confirmed
toxic documents (positives) and text without regard to any label (unlabelled) by
minimising the non-negative PU risk

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))

with the sigmoid loss; where the bracket is negative, the step goes against its
gradient.  The class prior is the toxic share of the labelled learnable rows.
Features are scaled by the log ratio of their positive and unlabelled document
frequencies, shrunk towards 0 where support is thin, and frequencies that positives
and unlabelled text share vanish.

All learnable text is unlabelled text, however much there is: frequencies count every
row; rows with the same features are merged into one with a weight; these are dealt
by hash into chunks of about ``chunk`` rows, each chunk trains from the same start
against all positives, and the weights are averaged by rows.  The bias is then moved
to the cut with the least PU classification error over a histogram of all scores.  The
positives, which are labelled rows, are a sample of about ``max_positive`` distinct
ones.  Every whole text is scored in one pass.

Null and empty texts have no features and get the bias's score.  Repeated rows are
scored one by one, tied scores stay tied, extra columns stay out of the features;
without positives every score is 0.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, discard, rows_in, sample, settle, tidy

BITS = 20
DIM = 1 << BITS
WORD = re.compile(r"[^\W\d_]+")
SLICE = 1 << 20
CELLS = 4096
REACH = 32.0


def word_hashes(text: str | None) -> np.ndarray:
    """Distinct hashes of the lower-cased words of a whole text."""
    found: set[int] = set()
    if text:
        for part in slices(text.lower()):
            found.update(map(zlib.crc32, map(str.encode, set(WORD.findall(part)))))
    return np.fromiter(found, np.uint32, len(found)) >> np.uint32(32 - BITS)


def slices(text: str) -> Iterator[str]:
    """Parts of about SLICE characters that end at white space."""
    start = 0
    while len(text) - start > SLICE:
        cut = text.find(" ", start + SLICE)
        if cut < 0:
            break
        yield text[start:cut]
        start = cut
    yield text[start:]


def hashed_rows(docs: DataFrame) -> DataFrame:
    """(words) of every text: its word hashes as 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.unique(word_hashes(t.as_py())).tobytes() for t in batch.column(0)], pa.binary())], ["words"])
        tidy()

    return docs.select("text").mapInArrow(run, "words binary")


def frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """In how many rows each word hash is, over all rows, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = np.zeros(DIM, np.int64), 0
        for batch in batches:
            n += len(batch)
            out += np.bincount(np.concatenate([np.frombuffer(r.as_buffer(), np.uint32) for r in batch.column(0)] or [np.zeros(0, np.uint32)]), minlength=DIM)
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, DIM)), pa.array(np.append(out[at], n))], ["feature", "n"])

    found = rows.mapInArrow(run, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()  # at most DIM + 1 rows
    out = np.zeros(DIM + 1, np.int64)
    out[found.column("feature").to_numpy()] = found.column("n").to_numpy()
    return out[:-1].astype(np.float64), int(out[-1])


class Model:
    """score = sigmoid(bias + sum of the weights of the words present)."""

    def __init__(self, at: np.ndarray, weights: np.ndarray, bias: float):
        self.at, self.values, self.bias = at, weights, bias

    def weights(self) -> np.ndarray:
        out = np.zeros(DIM, np.float32)
        out[self.at] = self.values
        return out


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def choose(fp: np.ndarray, positives: int, fu: np.ndarray, unlabelled: int) -> np.ndarray:
    """The scale of each feature; 0: not used."""
    p, u = (fp + 0.5) / (positives + 1), (fu + 0.5) / (unlabelled + 1)
    # lift over what chance gives: counts under a few positives carry no weight
    noise = 2.5 * np.sqrt(u * (1 - u) / positives) + 1.0 / positives
    scale = np.where(np.abs(p - u) > noise, np.log(p / u), 0.0)
    return np.where((fp < 2) & (scale > 0), 0.0, scale)


def descend(xp: Rows, xu: Rows, weight: np.ndarray, prior: float, *, epochs: int = 20, least_steps: int = 600, rate: float = 0.5, l2: float = 1e-4, batch: int = 512, seed: int = 11) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative PU risk, by mini-batch steps;
    weight: how many rows each row of ``xu`` stands for."""
    rng = np.random.default_rng(seed)
    w, b = np.zeros(len(xp.factor)), float(np.log(prior / (1 - prior)))
    mw, mb = np.zeros(len(xp.factor)), 0.0
    steps = max(1, xu.n // batch)
    for epoch in range(max(epochs, -(-least_steps // steps))):
        step = rate / (1 + 0.1 * min(epoch, epoch * epochs * steps / least_steps))
        for part in np.array_split(rng.permutation(xu.n), steps):
            pu, pp = xu.take(part), xp.take(rng.integers(0, xp.n, min(batch, 2 * xp.n)))
            share = weight[part] / max(1.0, weight[part].sum())
            sp, su = sigmoid(pp.dot(w) + b), sigmoid(pu.dot(w) + b)
            # sigmoid loss: l(+) = 1 - s, l(-) = s; both have slope s (1 - s)
            dp, du = sp * (1 - sp) / pp.n, su * (1 - su) * share
            rest = (su * share).sum() - prior * sp.mean() if pu.n else 0.0
            gp = pp.back(dp)
            gu_w, gu_b = pu.back(du) - prior * gp, du.sum() - prior * dp.sum()
            if rest >= 0:
                gw, gb = gu_w - prior * gp, gu_b - prior * dp.sum()
            else:
                gw, gb = -gu_w, -gu_b
            mw, mb = 0.9 * mw + gw, 0.9 * mb + gb
            w -= step * (mw + l2 * w)
            b -= step * mb
    return w, b


def train(positive: list[np.ndarray], rows: DataFrame, fu: np.ndarray, unlabelled: int, prior: float, *, chunk: int = 1 << 15, **options) -> Model:
    """Fit to the positives' words and all ``rows`` of words, whose frequencies are ``fu``."""
    if not positive:
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), -30.0)
    sc = rows.sparkSession.sparkContext
    fp = np.bincount(np.concatenate(positive), minlength=DIM).astype(np.float64)
    scale = choose(fp, len(positive), fu, unlabelled)
    used = np.flatnonzero(scale)
    slot = np.full(DIM, -1, np.int32)
    slot[used] = np.arange(len(used), dtype=np.int32)
    factor = scale[used]
    xp = Rows.of([at[at >= 0] for at in (slot[r] for r in positive)], factor)
    sent = sc.broadcast((slot, xp))  # DIM numbers and a bounded sample

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, _ = sent.value
        for batch in batches:
            at = (slot[np.frombuffer(r.as_buffer(), np.uint32)] for r in batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([x[x >= 0].tobytes() for x in at], pa.binary())], ["at"])

    merged = rows.mapInArrow(narrow, "at binary").groupBy("at").agg(F.count("*").alias("n"))
    merged = settle(merged, "toxic-rows")
    chunks = max(1, -(-merged.count() // chunk))

    def local(table: pa.Table) -> pa.Table:
        _, xp = sent.value
        at = [np.frombuffer(r.as_buffer(), np.int32) for r in table.column("at")]
        weight = table.column("n").to_numpy().astype(np.float64)
        w, b = descend(xp, Rows.of(at, xp.factor), weight, prior, **options)
        return pa.table({"weight": [weight.sum()], "values": pa.array([np.append(w, b).tolist()], pa.list_(pa.float64()))})

    dealt = merged.withColumn("chunk", F.pmod(F.xxhash64("at"), F.lit(chunks)))
    found = dealt.groupBy("chunk").applyInArrow(local, "weight double, values array<double>")
    mean = found.select("weight", F.posexplode("values").alias("k", "v")).groupBy("k").agg((F.sum(F.col("weight") * F.col("v")) / F.sum("weight")).alias("v")).toArrow()  # the weights once
    values = np.zeros(len(used) + 1)
    values[mean.column("k").to_numpy()] = mean.column("v").to_numpy()
    w, b = values[:-1], float(values[-1])
    final = sc.broadcast((w, b, factor))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b, factor = final.value
        out = np.zeros(CELLS)
        for batch in batches:
            x = Rows.of([np.frombuffer(r.as_buffer(), np.int32) for r in batch.column("at")], factor)
            out += np.bincount(cell_of(x.dot(w) + b), batch.column("n").to_numpy(), CELLS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CELLS)), pa.array(out)], ["cell", "n"])

    counts = np.zeros(CELLS)
    for r in merged.mapInArrow(tally, "cell bigint, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # CELLS rows
        counts[r.cell] = r.n
    discard(merged)
    b -= best_threshold(np.bincount(cell_of(xp.dot(w) + b), minlength=CELLS), counts, prior)
    return Model(used, (w * factor).astype(np.float32), b)


def cell_of(logit: np.ndarray) -> np.ndarray:
    """Cells of equal width between -REACH and REACH."""
    return np.clip((logit + REACH) * (CELLS / 2 / REACH), 0, CELLS - 1).astype(np.int64)


def best_threshold(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """The cut with the least non-negative PU classification error, from counts of
    logits by cell; of a run of equally good cuts, the middle of the highest."""
    hit = np.cumsum(positive[::-1])[::-1] / positive.sum()
    out = np.cumsum(unlabelled[::-1])[::-1] / max(1.0, unlabelled.sum())
    risk = prior * (1 - hit) + np.maximum(0.0, out - prior * hit)
    good = np.flatnonzero(risk <= risk.min() + 1e-12)
    last = first = good[-1]
    while first - 1 in good and not positive[first - 1] and not unlabelled[first - 1]:
        first -= 1
    return float((first + last) / 2 * (2 * REACH / CELLS) - REACH)


class Rows:
    """Sparse rows over the used features."""

    def __init__(self, n: int, ends: np.ndarray, at: np.ndarray, factor: np.ndarray):
        self.n, self.ends, self.at, self.factor = n, ends, at, factor

    @classmethod
    def of(cls, rows: list[np.ndarray], factor: np.ndarray) -> Rows:
        ends = np.concatenate([[0], np.cumsum([len(s) for s in rows])]).astype(np.int64)
        return cls(len(rows), ends, np.concatenate(rows) if rows else np.zeros(0, np.int64), factor)

    def take(self, rows: np.ndarray) -> Rows:
        sizes = self.ends[rows + 1] - self.ends[rows]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return Rows(len(rows), ends, self.at[np.repeat(self.ends[rows] - ends[:-1], sizes) + np.arange(ends[-1])], self.factor)

    def dot(self, w: np.ndarray) -> np.ndarray:
        row = np.repeat(np.arange(self.n), np.diff(self.ends))
        return np.bincount(row, (w * self.factor)[self.at], self.n)

    def back(self, d: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, np.repeat(d, np.diff(self.ends)), len(self.factor)) * self.factor


def fit(text: DataFrame, known: DataFrame, *, max_positive: int = 4000, **options) -> Model:
    """text: (doc_id, text), all of it unlabelled; known: (doc_id, toxic)."""
    total, toxic = known.agg(F.count("toxic"), F.sum("toxic")).first()
    prior = min(0.9, max(1e-3, (toxic or 0) / (total or 1)))
    text = text.where("text IS NOT NULL")
    ids = settle(sample(known.where("toxic = 1").select("doc_id"), max_positive).select("doc_id"), "toxic-ids")
    near = rows_in(text, F.xxhash64("doc_id"), bitmap(ids.select(F.xxhash64("doc_id").alias("h")), "h"))
    near = near.groupBy("doc_id", F.xxhash64("text").alias("_h")).agg(F.first("text").alias("text"))  # repeated rows once
    chosen = near.join(ids, "doc_id").orderBy("doc_id", "_h")
    positive = [np.frombuffer(r[0], np.uint32) for r in hashed_rows(chosen).collect()]
    rows = settle(hashed_rows(text), "toxic-words")
    model = train(positive, rows, *frequencies(rows), prior, **options)
    discard(rows)
    discard(ids)
    return model


def scorer(docs: DataFrame, model: Model):
    """A column function: the toxicity score of a text column."""
    sent = docs.sparkSession.sparkContext.broadcast((model.at, model.values, model.bias))  # at most DIM weights

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        model = Model(*sent.value)
        weights = model.weights()
        return pd.Series([float(sigmoid(model.bias + weights[np.unique(word_hashes(t))].sum())) for t in texts], dtype="float64")

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, learnable, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **options) -> DataFrame:
    """All columns of ``docs`` with ``score`` and ``predicted``; labels are read only
    for rows where ``learnable(id column)`` holds."""
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(learnable(F.col("doc_id")))
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("toxic")).where("toxic IS NOT NULL").where(learnable(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    score = scorer(docs, fit(text, known, **options))
    out = docs.withColumn("score", score(F.col(text_col)))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
