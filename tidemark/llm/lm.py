"""A gated recurrent language model that scores whole documents.

Counting.  Words (A-Z lowered, split at ASCII white space) and one end token per
document are counted over all training documents; tasks count before the shuffle.
The most frequent words, ``lm_words`` of them, are the model's own; the rest go
through an unknown token and are told apart by their unigram probability given that
they are unknown.  So the score is a proper log-probability of the text.

Model.  An embedding, one layer of gated recurrent units and an output softmax
factored into classes: P(word) = P(class | state) P(word | class, state).  Classes
hold words of similar frequency with about equal square-root mass, so frequent
words share small classes.  Training is truncated back-propagation through time in
numpy with Adagrad: documents run side by side, sorted by length, in windows of
``steps`` tokens; the state is carried from window to window but gradients are not.
Training runs in ``rounds``; in each, tasks start from common weights, train on
their share of that round's training documents, and the weights are averaged by
tokens.  Over the rounds every training document is seen once.

Scoring.  The state is carried across windows over the whole document, however
long.  Words beyond the broadcast head of the counts are looked up by a join.

Null text counts as empty (one end token); repeated rows are scored one by one;
extra columns are ignored; without training documents all tokens are unknown.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, settle, tidy

END, UNK = 0, 1
HEAD = 1 << 17
STREAM_TOKENS = 2_000_000
STREAM_DOCS = 4096
PART = 1 << 22
CHUNK = 1 << 14


def words_of(raw: bytes | None) -> list[bytes]:
    return raw.lower().split() if raw else []


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all rows; the end token is the null word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        ends = 0

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for raw in batch.column(0):
                held.update(words_of(raw.as_py()))
                ends += 1
                if len(held) > 300_000:
                    yield rows()
                    held.clear()
        if held:
            yield rows()
        held.clear()
        tidy()
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array([ends], pa.int64())], ["word", "n"])

    return docs.select("raw").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def head_count(counts: DataFrame) -> int:
    """The least count such that at most HEAD words have it or more, up to the width
    of a logarithmic bucket."""
    step = 64.0
    rows = counts.groupBy(F.floor(F.ln("n") * step).cast("int").alias("b")).agg(F.count("*").alias("k"), F.min("n").alias("n")).collect()  # under 3000 rows
    total, least = 0, 1 << 62
    for r in sorted(rows, key=lambda r: -r.b):
        total += r.k
        if total > HEAD:
            break
        least = r.n
    return least


def make_classes(counts: np.ndarray, classes: int) -> np.ndarray:
    """First token of each class and the end: END and UNK alone, then runs of words
    in order of frequency with about equal sums of square roots."""
    if len(counts) <= 2:
        return np.arange(len(counts) + 1)
    mass = np.cumsum(np.sqrt(counts[2:].astype(float)))
    cuts = np.searchsorted(mass, mass[-1] * np.arange(1, classes) / classes) + 3
    return np.unique(np.concatenate([[0, 1, 2], cuts[cuts < len(counts)], [len(counts)]]))


def exp_sum(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials, in place, and their row sums."""
    np.minimum(x, 60.0, out=x)
    np.exp(x, out=x)
    return x, x @ rows_of_ones(x.shape[1])


def rows_of_ones(n: int) -> np.ndarray:
    return np.ones(n, np.float32)


def log_sum(x: np.ndarray) -> np.ndarray:
    return np.log(exp_sum(x)[1])


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


class Recurrent:
    """Weights and the forward and backward passes over windows of a batch."""

    names = ("E", "Wx", "Wh", "Wc", "b", "Oc", "bc", "Ow", "bw")

    def __init__(self, counts: np.ndarray, hidden: int, classes: int, seed: int = 1):
        self.edges = make_classes(counts, classes)
        self.size = len(counts)
        self.of = np.repeat(np.arange(len(self.edges) - 1), np.diff(self.edges))
        rng = np.random.default_rng(seed)
        n, h, c = self.size, hidden, len(self.edges) - 1
        r = lambda *s: (rng.standard_normal(s) / math.sqrt(h)).astype(np.float32)
        self.h = h
        self.E, self.Wx, self.Wh, self.Wc = r(n, h), r(h, 3 * h), r(h, 2 * h), r(h, h)
        self.b = np.zeros(3 * h, np.float32)
        self.b[:h] = -1.0
        p = counts.astype(float) + 0.5
        mass = np.add.reduceat(p, self.edges[:-1]) if n else np.ones(c)
        self.Oc, self.bc = np.zeros((h, c), np.float32), np.log(mass / mass.sum()).astype(np.float32)
        self.Ow, self.bw = np.zeros((n, h), np.float32), np.log(p / mass[self.of]).astype(np.float32)

    def pack(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in self.names])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k in self.names:
            old = getattr(self, k)
            setattr(self, k, flat[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size

    def run(self, prev: np.ndarray, h: np.ndarray, keep: bool):
        """States (T, B, H) after each of the tokens ``prev`` (T, B)."""
        T, B = prev.shape
        H = self.h
        x = self.E[prev.ravel()]
        xz = x @ self.Wx
        xz += self.b
        xz = xz.reshape(T, B, 3 * H)
        steps = T if keep else 1
        out = np.empty((T, B, H), xz.dtype)
        zs, rs, cs = (np.empty((steps, B, H), xz.dtype) for _ in range(3))
        for t in range(T):
            k = t if keep else 0
            g = h @ self.Wh
            g += xz[t, :, : 2 * H]
            sigmoid(g)
            z, r, c = zs[k], rs[k], cs[k]
            z[:], r[:] = g[:, :H], g[:, H:]
            np.matmul(r * h, self.Wc, out=c)
            c += xz[t, :, 2 * H :]
            np.tanh(c, out=c)
            step = c - h
            step *= z
            h = np.add(step, h, out=out[t])
        return out, (x, zs, rs, cs)

    def log_probability(self, hs: np.ndarray, target: np.ndarray) -> np.ndarray:
        """ln P(target | state) of rows."""
        order, ends = self.by_class(target)
        hs, target = hs[order], target[order]
        cls, rows = self.of[target], np.arange(len(target))
        logits = hs @ self.Oc
        logits += self.bc
        found = logits[rows, cls] - log_sum(logits)
        for c in np.flatnonzero(np.diff(ends)).tolist():
            lo, hi = self.edges[c], self.edges[c + 1]
            if hi - lo > 1:
                i, j = ends[c], ends[c + 1]
                inner = hs[i:j] @ self.Ow[lo:hi].T
                inner += self.bw[lo:hi]
                found[i:j] += inner[rows[: j - i], target[i:j] - lo]
                found[i:j] -= log_sum(inner)
        out = np.empty_like(found)
        out[order] = found
        return out

    def by_class(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An order of targets by class, and where each class starts in it."""
        cls = self.of[target]
        order = np.argsort(cls.astype(np.int16) if len(self.edges) < 1 << 15 else cls, kind="stable")
        return order, np.searchsorted(cls[order], np.arange(len(self.edges)))

    def learn(self, prev, h, target, valid, rate: float, state: dict) -> tuple[np.ndarray, float, int]:
        """One window: loss, gradients and an Adagrad step; the last state."""
        T, B = prev.shape
        H = self.h
        hs, (flat_x, z, r, c) = self.run(prev, h, True)
        flat = np.flatnonzero(valid.ravel())
        m = len(flat)
        if not m:
            return hs[-1], 0.0, 0
        # in order of class, so that a class's rows are a slice
        y = target.ravel()[flat]
        order, ends = self.by_class(y)
        flat, y = flat[order], y[order]
        cls = self.of[y]
        x = hs.reshape(-1, H)[flat]
        rows = np.arange(m)
        d = x @ self.Oc
        d += self.bc
        loss = -float(d[rows, cls].sum())
        d, total = exp_sum(d)
        loss += float(np.log(total).sum())
        d /= total[:, None]
        d[rows, cls] -= 1
        dx = d @ self.Oc.T
        grads = {"Oc": x.T @ d, "bc": d.sum(0), "Ow": np.zeros_like(self.Ow), "bw": np.zeros_like(self.bw)}
        for k in np.flatnonzero(np.diff(ends)).tolist():
            lo, hi = self.edges[k], self.edges[k + 1]
            if hi - lo > 1:
                i, j = ends[k], ends[k + 1]
                w = self.Ow[lo:hi]
                e = x[i:j] @ w.T
                e += self.bw[lo:hi]
                own = rows[: j - i], y[i:j] - lo
                loss -= float(e[own].sum())
                e, total = exp_sum(e)
                loss += float(np.log(total).sum())
                e /= total[:, None]
                e[own] -= 1
                dx[i:j] += e @ w
                grads["Ow"][lo:hi], grads["bw"][lo:hi] = e.T @ x[i:j], rows_of_ones(j - i) @ e
        dhs = np.zeros((T * B, H), np.float32)
        dhs[flat] = dx
        dhs = dhs.reshape(T, B, H)
        before = np.concatenate([h[None], hs[:-1]])
        dxz = np.empty((T, B, 3 * H), np.float32)
        # what does not hang on later steps, for all steps at once
        rest = 1 - z
        slope_c = c * c
        np.subtract(1, slope_c, out=slope_c)
        slope_c *= z
        c -= before
        c *= z
        c *= rest  # now the slope of z
        held = r * before
        slope_r = held * (1 - r)
        WhT, WcT = np.ascontiguousarray(self.Wh.T), np.ascontiguousarray(self.Wc.T)
        dh = np.zeros((B, H), np.float32)
        for t in range(T - 1, -1, -1):
            dh += dhs[t]
            dg, dc = dxz[t, :, : 2 * H], dxz[t, :, 2 * H :]
            np.multiply(dh, slope_c[t], out=dc)
            np.multiply(dh, c[t], out=dg[:, :H])
            back = dc @ WcT
            np.multiply(back, slope_r[t], out=dg[:, H:])
            dh *= rest[t]
            back *= r[t]
            dh += back
            dh += dg @ WhT
        dxz = dxz.reshape(T * B, 3 * H)
        grads |= {"Wh": before.reshape(-1, H).T @ dxz[:, : 2 * H], "Wc": held.reshape(-1, H).T @ dxz[:, 2 * H :], "Wx": flat_x.T @ dxz, "b": dxz.sum(0)}
        dE = dxz @ self.Wx.T
        ids = prev.ravel()
        order = np.argsort(ids.astype(np.int16) if self.size < 1 << 15 else ids, kind="stable")
        ids = ids[order]
        firsts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        grads["E"] = np.zeros_like(self.E)
        grads["E"][ids[firsts]] = np.add.reduceat(dE[order], firsts, axis=0)
        for k, g in grads.items():
            self._step(k, g, m, rate, state)
        return hs[-1], loss, m

    def _step(self, name: str, grad: np.ndarray, m: int, rate: float, state: dict) -> None:
        grad *= 1 / math.sqrt(m)
        np.clip(grad, -5, 5, out=grad)
        weights = getattr(self, name)
        seen = state.setdefault(name, np.full(weights.shape, 0.1, np.float32))
        seen += grad * grad
        grad /= np.sqrt(seen)
        weights -= np.float32(rate) * grad


def windows(texts: list[np.ndarray], steps: int, width: int) -> Iterator[tuple]:
    """Batches of documents in windows of about equal size, ``steps`` tokens long or up
    to 16 times that where few documents are left: (documents, previous tokens,
    targets, valid, first window).  texts: token ids that end with END; sorted by length so that a
    batch shrinks as documents end.  ``width`` bounds the batch."""
    lengths = np.array([len(t) for t in texts])
    order = np.argsort(-lengths, kind="stable")
    flat = np.concatenate([*texts, np.zeros(steps, np.int32)])
    starts = np.cumsum(lengths) - lengths
    for lo in range(0, len(order), width):
        rows = order[lo : lo + width]
        sizes, first = lengths[rows], starts[rows]
        at = 0
        while at < sizes[0]:
            live = int(np.searchsorted(-sizes, -at, side="left"))  # longer than at
            long = steps * max(1, min(16, width // live))  # few documents: longer windows
            t = np.arange(at, min(at + long, int(sizes[0])))[:, None]
            valid = t < sizes[:live]
            place = first[:live] + t
            target = flat.take(place, mode="clip")
            prev = flat.take(place - 1, mode="clip")
            if at == 0:
                prev[0] = END
            yield rows[:live], prev, target, valid, at == 0
            at += len(t)


def train_part(model: Recurrent, texts: list[np.ndarray], state: dict, *, steps: int, width: int, rate: float) -> tuple[float, int]:
    loss = tokens = 0
    h = None
    for rows, prev, target, valid, first in windows(texts, steps, width):
        h = np.zeros((len(rows), model.h), np.float32) if first else h[: len(rows)]
        h, more, m = model.learn(prev, h, target, valid, rate, state)
        loss, tokens = loss + more, tokens + m
    return loss, tokens


def score_texts(model: Recurrent, texts: list[np.ndarray], *, steps: int, width: int) -> np.ndarray:
    """ln probability of each text, its state carried across windows."""
    out = np.zeros(len(texts))
    h = None
    for rows, prev, target, valid, first in windows(texts, steps, width):
        h = np.zeros((len(rows), model.h), np.float32) if first else h[: len(rows)]
        hs, _ = model.run(prev, h, False)
        flat = np.flatnonzero(valid.ravel())
        lp = model.log_probability(hs.reshape(-1, model.h)[flat], target.ravel()[flat])
        out[rows] += np.bincount(flat % len(rows), lp, len(rows))
        h = hs[-1]
    return out


def train(docs: DataFrame, vocabulary: list[bytes], counts: np.ndarray, *, hidden: int, classes: int, rounds: int, steps: int, width: int, rate: float) -> Recurrent:
    """Rounds of local training and averaging over the training rows (h, raw)."""
    sc = docs.sparkSession.sparkContext
    model = Recurrent(counts, hidden, classes)
    words = sc.broadcast(vocabulary)
    tally = sc.broadcast(counts)
    for k in range(rounds):
        sent = sc.broadcast(model.pack())
        pace = rate / (1 + k)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number = {w: i + 2 for i, w in enumerate(words.value)}
            own = Recurrent(tally.value, hidden, classes)
            own.load(sent.value)
            state, held, size, seen = {}, [], 0, 0
            for batch in batches:
                for raw in batch.column(0):
                    ids = encode(raw.as_py(), number)
                    held.append(ids)
                    size += len(ids)
                    if size >= STREAM_TOKENS or len(held) >= STREAM_DOCS:
                        seen += train_part(own, held, state, steps=steps, width=width, rate=pace)[1]
                        held, size = [], 0
            if held:
                seen += train_part(own, held, state, steps=steps, width=width, rate=pace)[1]
            held, state = [], {}
            number.clear()
            tidy()
            if seen:
                flat = own.pack()
                task = TaskContext.get().partitionId()
                for c in range(0, len(flat), CHUNK):
                    yield pa.RecordBatch.from_arrays([pa.array([task % 64], pa.int64()), pa.array([c // CHUNK], pa.int64()), pa.array([float(seen)]), pa.array([flat[c : c + CHUNK].tobytes()])], ["salt", "chunk", "weight", "values"])

        schema = "salt bigint, chunk bigint, weight double, values binary"
        part = docs.where(F.pmod(F.shiftright("h", 20), F.lit(rounds)) == k)
        local = part.select("raw").mapInArrow(run, schema)
        local = local.groupBy("salt", "chunk").applyInArrow(average, schema).withColumn("salt", F.lit(0).cast("bigint"))
        found = local.groupBy("chunk").applyInArrow(average, schema).collect()  # the weights once
        if found:
            flat = model.pack()
            for r in found:
                flat[r.chunk * CHUNK : r.chunk * CHUNK + CHUNK] = np.frombuffer(r["values"], np.float32)
            model.load(flat)
    return model


def average(table: pa.Table) -> pa.Table:
    """The mean of the chunk's values, weighted by tokens."""
    weight = np.array(table.column("weight").to_pylist())
    total = 0
    for w, v in zip(weight, table.column("values"), strict=True):
        total = total + np.frombuffer(v.as_py(), np.float32).astype(np.float64) * w
    values = (total / weight.sum()).astype(np.float32).tobytes()
    return pa.table({"salt": table.column("salt")[:1], "chunk": table.column("chunk")[:1], "weight": pa.array([float(weight.sum())]), "values": pa.array([values])})


def encode(raw: bytes | None, number: dict[bytes, int]) -> np.ndarray:
    """Token ids of a text, with END."""
    words = words_of(raw)
    get = number.get
    out = np.empty(len(words) + 1, np.int32)
    out[:-1] = np.fromiter(map(get, words, repeat(UNK)), np.int32, len(words))
    out[-1] = END
    return out


def score_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, lm_words: int = 4094, hidden: int = 16, classes: int = 48, rounds: int = 3, steps: int = 16, width: int = 1024, rate: float = 0.1) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score); documents
    of fold 0 are held out, all others trained on."""
    spark = docs.sparkSession
    held_out = fold(F.col(id_col), folds) == 0
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw"), held_out.alias("held_out"), F.xxhash64(id_col).alias("h"))
    counts = settle(count_words(src.where("NOT held_out")), "lm-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    z = total + 0.1 * (distinct + 1)
    least = head_count(counts.where("word IS NOT NULL"))
    top = counts.where((F.col("word").isNotNull()) & (F.col("n") >= least)).collect()  # at most HEAD words
    top.sort(key=lambda r: (-r.n, bytes(r.word)))
    ends = counts.where("word IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    head_words, head_counts = [bytes(r.word) for r in top], np.array([r.n for r in top], np.int64)
    own = min(lm_words, len(head_words))
    unknown = total - ends - int(head_counts[:own].sum())
    tally = np.concatenate([[ends, unknown], head_counts[:own]]).astype(np.int64)
    model = train(src.where("NOT held_out").select("h", "raw"), head_words[:own], tally, hidden=hidden, classes=classes, rounds=rounds, steps=steps, width=width, rate=rate)

    # ln of the base probability mass of all words that the model has no token for
    outside = math.log((unknown + 0.1 * (distinct - own - (1 if ends else 0)) + 0.1) / z)
    sc = spark.sparkContext
    sent, head = sc.broadcast((model.pack(), tally, own)), sc.broadcast((head_words, head_counts))
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["row", "id", "held_out", "n_tokens", "known", "base", "score", "tail", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, tally, own = sent.value
        words, counts = head.value
        lm = Recurrent(tally, hidden, classes)
        lm.load(flat)
        number = {w: i for i, w in enumerate(words)}
        # places 0.. of the head, then words beyond it
        base_of = np.append(np.log((counts + 0.1) / z), 0.0)
        lm_of = np.append(np.where(np.arange(len(words)) < own, np.arange(len(words)) + 2, UNK), UNK).astype(np.int32)
        end_base = math.log((tally[0] + 0.1) / z)
        row = TaskContext.get().partitionId() << 40
        id_type = None

        def solve(held):
            nonlocal row
            lp = score_texts(lm, [x[2] for x in held], steps=steps, width=width)
            cols = [[row + k for k in range(len(held))], [x[0] for x in held], [x[1] for x in held], [len(x[2]) for x in held], [x[3] for x in held], [x[4] for x in held], [float(v) + x[5] for v, x in zip(lp, held, strict=True)]]
            row += len(held)
            tails = [Counter(x[6]) for x in held]
            ends = np.concatenate([[0], np.cumsum([len(t) for t in tails])]).astype(np.int32)
            flat = pa.array([w for t in tails for w in t], pa.binary())
            times = pa.array([n for t in tails for n in t.values()], pa.int64())
            types = [pa.int64(), id_type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, types, strict=True)), pa.ListArray.from_arrays(pa.array(ends), flat), pa.ListArray.from_arrays(pa.array(ends), times)], names)

        held, size = [], 0
        for batch in batches:
            id_type = batch.schema.field("id").type
            get, none = number.get, len(words)
            for doc, out, raw in zip(batch.column("id").to_pylist(), batch.column("held_out").to_pylist(), batch.column("raw"), strict=True):
                tokens = words_of(raw.as_py())
                at = np.fromiter(map(get, tokens, repeat(none)), np.int32, len(tokens))
                ids = np.append(lm_of[at], np.int32(END))
                beyond = np.flatnonzero(at == none)
                base = base_of[at]
                unk = ids[:-1] == UNK
                held.append((doc, out, ids, len(at) - len(beyond) + (tally[0] > 0), float(base.sum()) + end_base, float(base[unk].sum()) - outside * int(unk.sum()), [tokens[k] for k in beyond]))
                size += len(ids)
                if size >= STREAM_TOKENS or len(held) >= STREAM_DOCS:
                    yield solve(held)
                    held, size = [], 0
        if held:
            yield solve(held)
        held = []
        number.clear()
        tidy()

    scored = settle(src.select("id", "held_out", "raw").mapInArrow(run, f"row bigint, id {kind}, held_out boolean, n_tokens bigint, known bigint, base double, score double, tail array<binary>, times array<bigint>"), "lm-scored")
    tail = scored.where(F.size("tail") > 0).select("row", F.explode(F.arrays_zip("tail", "times")).alias("t")).select("row", F.col("t.tail").alias("word"), F.col("t.times").alias("k"))
    looked = tail.join(counts.where(F.col("n") < least), "word", "left")
    more = looked.groupBy("row").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("more_known"), F.sum(F.col("k") * F.ln((F.coalesce("n", F.lit(0)) + 0.1) / F.lit(z))).alias("more"))
    ln10 = F.lit(math.log(10))
    out = scored.drop("tail", "times").join(more, "row", "left")
    rest = F.coalesce("more", F.lit(0.0))
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), ((F.col("base") + rest) / ln10).alias("base_score"), ((F.col("score") + rest) / ln10).alias("score"))
