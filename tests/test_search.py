"""Vector search in tiles: the same rows whatever their size, and bounded memory."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tidemark.operators import search


def brute(v, asked, k):
    """(query_id, rank, vec_id, score) by sorting all scores of a query."""
    unit = {i: np.array(x, np.float64) / np.linalg.norm(x) for i, x in v if np.any(x)}
    out = []
    for i in asked:
        scored = sorted((-round(float(unit[i] @ u), 6), j) for j, u in unit.items() if j != i)
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("floats, scores", [(1 << 22, 1 << 20), (90, 1), (90, 7), (1 << 22, 64)])
def test_vector_topk_does_not_depend_on_tiles(spark, floats, scores):
    r = np.random.default_rng(3)
    v = [(i, [float(x) for x in r.integers(-1, 2, 4)]) for i in range(120)]  # many ties, some zero vectors
    df = spark.createDataFrame(v, "vec_id bigint, embedding array<float>").repartition(3)
    asked = [i for i, x in v if i % 9 == 0 and any(x)]
    got = search.vector_topk(df, df.where(df.vec_id.isin(asked)).withColumnRenamed("vec_id", "query_id"), top_k=7, query_floats=floats, scores=scores)
    assert sorted((x.query_id, x.rank, x.vec_id, x.score) for x in got.collect()) == brute(v, asked, 7)


def test_vector_topk_holds_a_tile_of_scores(spark, monkeypatch):
    """All scores of a batch and a block were held at once: 320 MB here, and as much of
    their order."""
    r = np.random.default_rng(4)
    x = r.normal(size=(10_000, 4)).astype(np.float32)
    df = spark.createDataFrame(pa.table({"vec_id": pa.array(range(4000)), "embedding": pa.array(list(x[:4000]))}))
    runs, whole = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, *a, **b: runs.append(f) or whole(self, f, *a, **b))
    search.vector_topk(df, df.withColumnRenamed("vec_id", "query_id"))
    batch = pa.RecordBatch.from_arrays([pa.array(range(5000, 15_000)), pa.array(list(x))], ["vec_id", "embedding"])
    tracemalloc.start()
    rows = sum(b.num_rows for b in runs[0](iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 40_000
    assert peak < 80 << 20
