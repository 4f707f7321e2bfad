"""Whole results against plain recomputations."""

import math
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import langid, lm, media, queries, toxicity
from tidemark.llm.common import fold, sample

SF = "/root/testdata/sf0.001"


def test_jaccard_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.execute(f"SELECT doc_id, n_shingles, component_id FROM ({queries.oracle_sql()['op8_jaccard_join']})").fetchall())
    got = sorted(tuple(r) for r in queries.op8_jaccard_join(spark, SF).select("doc_id", "n_shingles", "component_id").collect())
    assert got == want and sum(c != d for d, _, c in got) > 5


def softmax(x):
    e = np.exp(x - x.max())
    return e / e.sum()


def slow_score(model, ids):
    """ln probability of token ids, a token at a time."""
    h, prev, total = np.zeros(model.h), lm.END, 0.0
    H = model.h
    for y in ids:
        x = model.E[prev].astype(float) @ model.Wx + model.b
        g = 1 / (1 + np.exp(-(x[: 2 * H] + h @ model.Wh)))
        z, r = g[:H], g[H:]
        h = (1 - z) * h + z * np.tanh(x[2 * H :] + (r * h) @ model.Wc)
        c = int(model.of[y])
        total += math.log(softmax(h @ model.Oc + model.bc)[c])
        lo, hi = model.edges[c], model.edges[c + 1]
        total += math.log(softmax(model.Ow[lo:hi].astype(float) @ h + model.bw[lo:hi])[y - lo])
        prev = y
    return total


@pytest.mark.parametrize("head", [1 << 17, 6])
def test_scores_are_the_models(spark, awkward, monkeypatch, head):
    """Every document's score against a model that is evaluated token by token; with a
    small head, words are looked up by the join."""
    held = {}

    def fixed(docs, vocabulary, counts, *, hidden, classes, **_):
        model = lm.Recurrent(counts, hidden, classes)
        rng = np.random.default_rng(4)
        for k in model.names:
            setattr(model, k, (rng.standard_normal(getattr(model, k).shape) * 0.4).astype(np.float32))
        held.update(model=model, words=list(vocabulary), counts=counts)
        return model

    monkeypatch.setattr(lm, "train", fixed)
    monkeypatch.setattr(lm, "HEAD", head)
    rows = awkward.where("length(text) < 2000 OR text IS NULL")
    got = lm.score_documents(rows, lm_words=4, hidden=5, classes=3, steps=4, width=8).collect()
    model, number = held["model"], {w: i + 2 for i, w in enumerate(held["words"])}
    out = lambda doc: zlib.crc32(b"" if doc is None else str(doc).encode()) % 10 == 0
    texts = [(r.doc_id, lm.words_of((r.text or "").encode())) for r in rows.collect()]
    counts = Counter(w for doc, words in texts if not out(doc) for w in [*words, None])
    n, v = sum(counts.values()), len(counts)
    base = lambda w: (counts[w] + 0.1) / (n + 0.1 * (v + 1))
    inside = sum(base(w) for w in [*held["words"], None])
    want = []
    for doc, words in texts:
        ids = [number.get(w, lm.UNK) for w in words] + [lm.END]
        rest = sum(math.log(base(w) / (1 - inside)) for w in words if w not in number)
        want.append((str(doc), len(words) + 1, sum(counts[w] > 0 for w in words) + (counts[None] > 0), (slow_score(model, ids) + rest) / math.log(10)))
    have = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.score) for r in got)
    for a, b in zip(have, sorted(want), strict=True):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-3 * max(1, abs(b[3])), (a, b)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_languages_are_the_models(spark):
    """Every row's language and score by the plain formula; kept columns are untouched."""
    docs = documents(spark).withColumns({"_lang": F.lit("mine"), "_lang_": F.lit(1)})
    learnable = fold(F.col("doc_id"), 4) != 2
    got = {r.doc_id: r for r in langid.identify(docs, learnable).collect()}
    model = langid.fit(docs.where(learnable).select("doc_id", "text", F.col("lang").alias("label")))
    hits = 0
    for r in docs.collect():
        want, score = langid.UND, 0.0
        if r.text and any(c.isalpha() for c in r.text):
            counts = langid.gram_counts(r.text)
            at = np.flatnonzero(counts)
            x = (1 + np.log(counts[at])) * model.idf[at]
            p = softmax((x / np.linalg.norm(x) @ model.weights[at] + model.bias) / model.temperature)
            want, score = model.labels[int(p.argmax())], float(p.max())
        row = got[r.doc_id]
        assert row.lang_pred == want and abs(row.score - score) < 1e-3 and (row["_lang"], row["_lang_"]) == ("mine", 1)
        hits += zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and want == r.lang
    assert hits > 30


def test_every_language_is_learnt(spark):
    """A language with few rows is in the model though the sample is small."""
    rows = [(i, f"the house and the garden number {i}", "en") for i in range(3000)] + [(9000 + i, f"το σπίτι και ο κήπος {i}", "el") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    out = langid.identify(docs, F.lit(True), max_fit=200, max_calibrate=50).where("doc_id >= 9000").collect()
    assert {r.lang_pred for r in out} == {"el"}


def test_samples_do_not_depend_on_partitions(spark):
    rows = [(i % 70, "abc"[i % 3]) for i in range(400)]
    df = spark.createDataFrame(rows, "a int, b string")
    picks = [sorted(map(tuple, sample(df.repartition(n), 40, by="b", least=5).select("a", "b").collect())) for n in (1, 5)]
    assert picks[0] == picks[1] and len(set(picks[0])) == len(picks[0])
    assert Counter(b for _, b in picks[0]).keys() == set("abc")


def test_toxicity_scores_are_the_models(spark):
    docs = documents(spark).select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    learnable = lambda c: fold(c, 5) != 0
    got = {r.doc_id: (r.score, r.predicted) for r in toxicity.score_toxicity(docs, labels, learnable, chunk=50).collect()}
    again = {r.doc_id: (r.score, r.predicted) for r in toxicity.score_toxicity(docs.repartition(5), labels, learnable, chunk=50).collect()}
    assert all(abs(got[k][0] - again[k][0]) < 1e-6 for k in got)
    known = labels.where(learnable(F.col("doc_id"))).select("doc_id", "toxic")
    model = toxicity.fit(docs.where(learnable(F.col("doc_id"))), known, chunk=50)
    weight = dict(zip(model.at.tolist(), model.values.tolist(), strict=True))
    for r in docs.collect():
        words = {zlib.crc32(w.encode()) >> (32 - toxicity.BITS) for w in toxicity.WORD.findall((r.text or "").lower())}
        score = 1 / (1 + math.exp(-max(-30.0, min(30.0, model.bias + sum(weight.get(w, 0.0) for w in words)))))
        assert abs(got[r.doc_id][0] - score) < 1e-4 and got[r.doc_id][1] == (got[r.doc_id][0] >= 0.5)


def decode_png(raw):
    """(width, height, samples) of an 8-bit grey image, by the format's own rules."""
    assert raw[:8] == b"\x89PNG\r\n\x1a\n"
    at, data, head = 8, b"", None
    while at < len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + size]
        assert struct.unpack(">I", raw[at + 8 + size : at + 12 + size])[0] == zlib.crc32(kind + body)
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data += body
        at += 12 + size
    width, height, depth, colour, *_, interlace = head
    assert (depth, colour, interlace) == (8, 0, 0)
    flat, rows, before = zlib.decompress(data), [], bytes(width)
    for y in range(height):
        line = flat[y * (width + 1) : (y + 1) * (width + 1)]
        out = bytearray()
        for x, b in enumerate(line[1:]):
            left, up, corner = (out[x - 1] if x else 0), before[x], (before[x - 1] if x else 0)
            guess = min((left, up, corner), key=lambda v, p=left + up - corner: abs(p - v))
            out.append((b + (0, left, up, (left + up) // 2, guess)[line[0]]) & 255)
        rows.append(bytes(out))
        before = bytes(out)
    return width, height, b"".join(rows)


@pytest.mark.parametrize("text", ["", "short", "é" * 500, "words and more words " * 300])
def test_images_decode_by_the_format(text):
    payload, _ = media.payload_of(text)
    width, height, samples = decode_png(media.to_png(payload))
    assert samples == payload and width * height == len(payload)
