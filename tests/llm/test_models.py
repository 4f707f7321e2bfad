import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontam, langid, lm, toxicity
from tidemark.llm.common import fold

WORDS = {"en": "the and with house river green walk".split(), "de": "der und mit haus fluss grün gehen".split(), "fr": "le et avec maison rivière vert marcher".split()}


def corpus(n=240, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(WORDS))
        words = rng.choices(WORDS[lang], k=rng.randint(5, 40))
        rows.append((i, " ".join(words), lang, lang))
    return rows


def test_language_held_out(spark, awkward, empty):
    df = spark.createDataFrame(corpus(), "doc_id bigint, text string, lang string, score string")
    rest = fold(F.col("doc_id"), 4)
    rows = langid.identify(df.drop("score"), rest != 2).where(rest == 2).collect()
    assert rows and np.mean([r.lang == r.lang_pred for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)
    odd = langid.identify(awkward.select("doc_id", "text", "lang"), fold(F.col("doc_id"), 4) != 2).collect()
    assert len(odd) == awkward.count()
    assert all(r.lang_pred == "und" for r in odd if not (r.text or "").strip())
    assert langid.identify(empty.select("doc_id", "text", "lang"), F.lit(True)).count() == 0


def test_slices_count_every_gram():
    text = "naïve words " * 900
    whole = langid.gram_counts(text)
    old = langid.SLICE
    try:
        langid.SLICE = 1000
        assert (langid.gram_counts(text) == whole).all()
    finally:
        langid.SLICE = old


def test_toxicity_held_out(spark, awkward, empty):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(900):
        bad = rng.random() < 0.15
        words = rng.choices(WORDS["en"] + WORDS["fr"], k=30) + (rng.sample(["vile", "scum", "trash"], 2) if bad else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs, known = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    out = {r.doc_id: r for r in toxicity.score_toxicity(docs, known, lambda c: fold(c, 5) != 0).collect()}
    held = [(out[i].predicted, t) for i, t in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([p == t for p, t in held]) > 0.95
    odd = toxicity.score_toxicity(awkward.select("doc_id", "text"), known, lambda c: fold(c, 5) != 0)
    assert odd.where("score between 0 and 1").count() == awkward.count()
    assert toxicity.score_toxicity(empty.select("doc_id", "text"), known.limit(0), lambda c: F.lit(True)).count() == 0


def brute_base(rows):
    words = {i: (t or "").encode().lower().split() + [None] for i, t in rows}
    train = Counter()
    for i, w in words.items():
        if zlib.crc32(str("" if i is None else i).encode()) % 10:
            train.update(w)
    n, v = sum(train.values()), len(train)
    return {i: (len(w), sum(train[x] > 0 for x in w), n, sum(math.log10((train[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) for i, w in words.items()}


@pytest.mark.parametrize("head", [5, 1000])
def test_lm_counts_and_scores(spark, head, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", head)
    rows = [(i, t) for i, t, *_ in corpus(200)] + [(900, None), (901, ""), (902, "THE the unseen-word " * 400), (910, "neverseen")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id bigint, text string, score double").repartition(3)
    want = brute_base(rows)
    got = {r.doc_id: r for r in lm.score_documents(df, lm_words=12, classes=4, hidden=8, width=32).collect()}
    assert len(got) == len(rows)
    for i, (n, known, total, base) in want.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert abs(r.base_score - base) < 1e-6 * abs(base)


def test_lm_is_a_distribution_and_learns():
    counts = np.array([10, 5, 40, 30, 20, 10, 5, 3])
    m = lm.Recurrent(counts, 6, 4)
    h = np.random.default_rng(0).standard_normal((3, 6)).astype(np.float32)
    total = sum(np.exp(m.log_probability(h, np.full(3, k))) for k in range(8))
    assert np.allclose(total, 1, atol=1e-4)
    texts = [np.array([2, 3, 4] * 30 + [lm.END], np.int32) for _ in range(64)]
    before = lm.score_texts(m, texts[:4], steps=8, width=4).sum()
    for _ in range(8):
        lm.train_part(m, texts, {}, steps=8, width=32, rate=0.1)
    assert lm.score_texts(m, texts[:4], steps=8, width=4).sum() > 0.6 * before
    # the state is carried: window lengths do not change a score
    assert np.allclose(lm.score_texts(m, texts[:2], steps=8, width=2), lm.score_texts(m, texts[:2], steps=1000, width=1), rtol=1e-4)


def test_lm_gradients():
    rng = np.random.default_rng(2)
    m = lm.Recurrent(np.array([4, 4, 9, 9, 5, 5]), 5, 3)
    for k in m.names:
        setattr(m, k, (rng.standard_normal(getattr(m, k).shape) * 0.3).astype(np.float64))
    prev, target, valid = rng.integers(0, 6, (4, 3)), rng.integers(0, 6, (4, 3)), np.ones((4, 3), bool)
    h = np.zeros((3, 5))
    seen = {}
    m._step = lambda name, grad, n, rate, state: seen.__setitem__(name, np.array(grad, float))

    def loss():
        hs, _ = m.run(prev, h, False)
        return -m.log_probability(hs.reshape(-1, 5).astype(float), target.ravel()).sum()

    m.learn(prev, h, target, valid, 0.1, {})
    for name in ("Wh", "Wc", "Wx", "E", "Oc", "Ow", "b"):
        w = getattr(m, name)
        at = tuple(int(rng.integers(0, s)) for s in w.shape)
        old, eps = w[at], 1e-2
        w[at] = old + eps
        up = loss()
        w[at] = old - eps
        down = loss()
        w[at] = old
        assert abs((up - down) / (2 * eps) - seen[name][at]) < 0.03 * max(1, abs(seen[name][at])), name


def test_lm_empty(empty):
    assert lm.score_documents(empty).count() == 0


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def test_lcs():
    rng = random.Random(3)
    for _ in range(200):
        a, b = rng.choices(range(6), k=rng.randint(1, 40)), rng.choices(range(7), k=rng.randint(0, 60))
        bits = {}
        for k, x in enumerate(a):
            bits[x] = bits.get(x, 0) | 1 << k
        assert decontam.lcs_length(bits, len(a), b) == lcs(a, b)


def test_leaks_are_found(spark, awkward, empty):
    rng = random.Random(9)
    vocabulary = [f"{a}{b}{c}" for a in "ba co du fe gi ho ju ka".split() for b in "lan mer nis tor pul".split() for c in "abcdefgh"] + ["the", "of", "and"] * 12
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(16, 60))), "x") for k in range(20)] + [(50, None, "x"), (51, "", "x"), (52, "too short", "x")]
    docs, want = [], set()
    for i in range(150):
        words = rng.choices(vocabulary, k=rng.randint(30, 300))
        if i % 5 == 0:
            k = rng.randrange(20)
            leak = items[k][1].split()
            if i % 10 == 0:  # a paraphrase: a few words changed
                for _ in range(len(leak) // 10):
                    leak[rng.randrange(len(leak))] = rng.choice(vocabulary)
            at = rng.randrange(len(words))
            words = words[:at] + leak + words[at:]
            want.add((i, k))
        docs.append((i, " ".join(words), 1.0))
    df = spark.createDataFrame(docs, "doc_id bigint, text string, cosine double").repartition(3)
    bench = spark.createDataFrame(items, "item_id bigint, text string, id string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(df, bench).collect()}
    assert got == want
    assert decontam.contaminated(awkward, bench).count() == 0
    assert decontam.contaminated(empty, bench).count() == 0
    assert decontam.contaminated(df, bench.limit(0)).count() == 0


def test_short_items_are_found_word_by_word(spark):
    items = [(1, "Seven words stand here in a row"), (2, "in a row"), (3, "row"), (4, "in a row"), (5, "nowhere to be seen"), (6, "unseen")]
    docs = [(10, "seven WORDS stand, here in a row!"), (11, "in a long row"), (12, "a row in"), (13, ""), (14, None)]
    bench, df = spark.createDataFrame(items, "item_id bigint, text string"), spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id, r.lcs, r.lcs_share) for r in decontam.contaminated(df, bench).collect()}
    assert got == {(10, 1, 7, 1.0), (10, 2, 3, 1.0), (10, 4, 3, 1.0), (10, 3, 1, 1.0), (11, 3, 1, 1.0), (12, 3, 1, 1.0)}


def test_long_items_across_parts(spark):
    """An item of 1,200 words, and a paraphrase of it, over the end of a text's part."""
    rng = random.Random(2)
    vocabulary = [f"{a}{b}" for a in "ba co du fe gi ho ju ka".split() for b in "lan mer nis tor pul gat".split()]
    item = rng.choices(vocabulary, k=1200)
    changed = [rng.choice(vocabulary) if k % 6 == 0 else w for k, w in enumerate(item)]
    fill = [f"z{k}" for k in range(decontam.CHUNK_WORDS - 600)]
    docs = [(1, " ".join(fill + item + fill[:500])), (2, " ".join(fill + changed + fill[:500])), (3, " ".join(fill))]
    df, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id bigint, text string")
    got = {r.doc_id: r.lcs for r in decontam.contaminated(df, bench).collect()}
    assert set(got) == {1, 2} and got[1] == 1200 and got[2] >= 1000


def test_whole_result_equals_brute_force(spark):
    """Every document against every item, without the latent search."""
    folder = "/root/testdata/sf0.001"
    docs, bench = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    texts = {r.doc_id: decontam.words_of(r.text) for r in docs.collect()}
    items = {r.item_id: decontam.words_of(r.text) for r in bench.collect()}
    df = Counter(w for words in texts.values() for w in set(words))
    idf = {w: float(np.log((1 + len(texts)) / (1 + df[w])) + 0.1) for words in items.values() for w in words}
    index = decontam.Index(sorted(items.items(), key=lambda r: str(r[0])), sorted(idf), np.zeros((decontam.DIM, 1), np.float32), idf)
    want = set()
    for doc, words in texts.items():
        own = [index.number[w] for w in words if w in index.number]
        for k, (item, size, bits, _) in enumerate(index.items):
            if len(bits.keys() & set(own)) >= 0.5 * len(bits) and index.check(k, own, 0.7, 0.5, 0.6):
                want.add((doc, item))
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()}
    assert len(got & want) >= 0.97 * len(want) > 0 and len(got - want) <= 0.03 * len(want), (got - want, want - got)


def test_svd_matches_dense(spark):
    rng = random.Random(1)
    passages = [rng.choices([f"t{k}" for k in range(50)], k=20) for _ in range(60)]
    idf = {f"t{k}": 1.0 + k % 3 for k in range(50)}
    basis = decontam.randomised_svd(spark.createDataFrame([(p,) for p in passages], "words array<string>").repartition(3), idf, 8, rounds=6)
    dense = np.zeros((60, decontam.DIM), np.float32)
    for row, p in zip(dense, passages, strict=True):
        at, v = decontam.passage_vector(p, idf)
        np.add.at(row, at, v)
    want = np.linalg.svd(dense, full_matrices=False)[1][:8]
    got = np.linalg.norm(dense @ basis, axis=0)
    assert np.allclose(np.sort(got), np.sort(want), rtol=0.05)
