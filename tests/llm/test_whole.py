"""Work that earlier code left out, a test each."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import decontam, lm


@pytest.mark.parametrize("scale", [1, 1_000, 1_000_000])
def test_leaks_are_candidates_at_any_number_of_documents(scale):
    """All document frequencies grow with the table; what is found must not change."""
    rng = random.Random(7)
    vocabulary = sorted(f"w{k}" for k in range(300))
    rows = [(k, rng.choices(vocabulary, k=rng.randint(20, 32))) for k in range(40)]
    docs, df = 5_000 * scale, {w: rng.randint(20, 2_000) * scale for w in vocabulary}
    idf = {w: float(np.log((1 + docs) / (1 + df[w])) + 0.1) for w in vocabulary}
    dense = np.zeros((len(rows), decontam.DIM), np.float32)
    for row, (_, words) in zip(dense, rows, strict=True):
        at, v = decontam.passage_vector(words, idf)
        np.add.at(row, at, v)
    basis = np.linalg.svd(dense, full_matrices=False)[2].T.astype(np.float32)
    index = decontam.Index(rows, vocabulary, basis, idf)
    other = len(vocabulary)
    missed = 0
    for k, (_, words) in enumerate(rows):
        ids = [index.number[w] for w in words]
        for at in rng.sample(range(len(ids)), len(ids) // 5):
            ids[at] = other  # a fifth of the words replaced by words of no item
        text = [other] * rng.randint(20, 50) + ids + [other] * 40
        text = np.array(text + [other + 1] * (-len(text) % decontam.HALF)).reshape(-1, decontam.HALF)
        found = index.candidates(text, np.zeros(len(text), int), 0.4, 0.45)[1]
        missed += k not in found
    assert missed == 0


def test_pipeline_takes_near_copies_by_five_words(spark):
    """Two copies with a five-word similarity of 0.81 and a three-word one of 0.88."""
    words = [f"w{k}" for k in range(100)]
    near = ["x" if k in (30, 60) else w for k, w in enumerate(words)]
    other = [f"v{k}" for k in range(100)]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert kept == {1, 3}


def test_every_training_document_reaches_the_model(spark):
    """Documents whose ids hash to the upper half teach the model as well."""
    high = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) >= 1 << 19
    ids = spark.range(400).select(F.col("id").alias("doc_id")).where(high)
    docs = ids.withColumn("text", F.repeat(F.lit("one two three four "), 10)).repartition(2)

    def mean(rate):
        out = lm.score_documents(docs, lm_words=12, classes=3, hidden=8, width=32, rate=rate)
        return out.agg(F.avg("score")).first()[0]

    assert mean(0.1) > 0.9 * mean(0.0)
