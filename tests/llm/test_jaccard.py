import random
import re

import numpy as np
import pytest

from tidemark.llm import jaccard as J
from tidemark.llm.components import connected_components
from tidemark.llm.jaccard import jaccard_components


def sets_of(rows, k):
    out = []
    for doc, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        out.append((doc, frozenset(zip(*(w[j:] for j in range(k)), strict=False)) if len(w) >= k else frozenset([tuple(w)] if w else [])))
    return out


def brute(rows, num=9, den=10, k=3):
    s = sets_of(rows, k)
    root = list(range(len(s)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(s)):
        for j in range(i):
            a, b = s[i][1], s[j][1]
            if a and b and den * len(a & b) >= num * len(a | b):
                root[find(i)] = find(j)
    low = {}
    for i, (doc, _) in enumerate(s):
        if doc is not None:
            low[find(i)] = min(low.get(find(i), doc), doc)
    return sorted(((doc, len(x), low.get(find(i)) if x else doc) for i, (doc, x) in enumerate(s)), key=str)


def near_copies(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)] + ["the", "of", "and"] * 20
    rows, doc = [], 0
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.choice([2, 3, 9, 11, 20, 22, 60, 150, 400]))
        for _ in range(rng.choice([1, 2, 6, 14])):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 40))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                words += rng.choices(vocabulary, k=rng.randint(1, 4))
            rows.append((doc, " ".join(words)))
            doc += 1
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    rows = near_copies(seed)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted(map(tuple, jaccard_components(df, block_rows=5).collect()), key=str)
    assert got == brute(rows)


def test_awkward(awkward, empty):
    got = sorted(map(tuple, jaccard_components(awkward).where("doc_id IS NOT NULL").collect()), key=str)
    want = [r for r in brute([(r.doc_id, r.text) for r in awkward.collect()]) if r[0] is not None]
    assert got == want
    assert jaccard_components(empty).count() == 0


def linked(x, y, num, den):
    o = len(np.intersect1d(x, y))
    return den * o >= num * (len(x) + len(y) - o)


def corpus(seed):
    """Sets made of shared passages and own shingles in all proportions."""
    rng = np.random.default_rng(seed)
    new = lambda n: rng.integers(0, 2**64 - 1, n, np.uint64)
    passages = [new(int(rng.integers(1, 120))) for _ in range(6)]
    sets = []
    for _ in range(40):
        parts = [p for p in passages if rng.random() < 0.5] + [new(int(rng.integers(1, 60)))]
        base = np.concatenate(parts)[: int(rng.integers(1, 400))]
        for _ in range(int(rng.integers(1, 5))):
            keep = base[rng.random(len(base)) >= rng.choice([0.0, 0.02, 0.05, 0.1])]
            sets.append(np.concatenate([keep, new(int(rng.integers(0, 1 + len(base) // 12)))]))
    a, b = new(12), new(1)
    sets += [a, np.concatenate([a, b]), np.concatenate([a, new(1)]), a[1:], a[:9], a[:8]]
    return list({np.unique(s).tobytes(): np.unique(s) for s in sets if len(s)}.values())


@pytest.mark.parametrize("num, den", [(9, 10), (4, 5), (3, 4), (1, 2)])
@pytest.mark.parametrize("frequent, common", [(2, 3), (3, 8), (32, 1024)])
def test_linked_sets_share_prefixes_and_keys(num, den, frequent, common):
    plan = J.Plan(num, den, frequent, common)
    for seed in range(3):
        sets = corpus(seed)
        tokens, count = np.unique(np.concatenate(sets), return_counts=True)
        df = dict(zip(tokens.tolist(), count.tolist(), strict=True))
        prefixes = [s[: plan.prefix(len(s))] for s in sets]
        held, times = np.unique(np.concatenate(prefixes), return_counts=True)
        shared = held[times > 1]
        keys = []
        for s in sets:
            n = np.array([df[t] for t in s.tolist()])
            keys.append(plan.keys(len(s), s[n > 1], n[n > 1]))
        links = 0
        for i, x in enumerate(sets):
            for j in range(i):
                if linked(x, sets[j], num, den):
                    links += 1
                    assert np.intersect1d(keys[i], keys[j]).size
                    for k in (i, j):
                        assert np.isin(prefixes[k], shared).sum() >= plan.least(len(sets[k]))
        assert links > 20


def test_every_prefix_ends():
    for num, den in ((9, 10), (4, 5), (1, 2), (1, 5)):
        plan = J.Plan(num, den, 2, 3)
        for n in range(2, 3000, 7):
            assert plan.prefix(n) <= n
            assert all(3 * g <= n - plan.differ(n) - 1 for _, g in plan.levels(n))
            assert plan.levels(n)


def test_the_two_ways_to_filter_agree(spark):
    rows = near_copies(4)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert sorted(map(tuple, jaccard_components(df, bitmap_keys=0).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("num, den, k", [(1, 2, 1), (4, 5, 5), (1, 5, 2)])
def test_other_thresholds(spark, num, den, k):
    rows = [(1000 + i, t) for i, t in enumerate(["a", "a b", "b c", "a b c d", "z", "z z", "q r s t", "q", "", "r s t"])] + near_copies(6)[:60]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted(map(tuple, jaccard_components(df, num=num, den=den, words=k, frequent=3, common=6, block_rows=16).collect()), key=str)
    assert got == brute(rows, num, den, k)


def test_a_group_that_no_hub_holds_together(spark):
    """A chain of texts under common keys: neighbours link, most pairs don't."""
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[4 * k : 4 * k + 200])) for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = jaccard_components(df, frequent=4, common=9, block_rows=7).collect()
    assert {r.component_id for r in got} == {0}


def test_rows_without_ids_link_others(spark):
    words = [f"w{k}" for k in range(100)]
    text = lambda a, b: " ".join(words[a:b])
    rows = [(1, text(0, 90)), (None, text(4, 94)), (None, text(4, 94)), (2, text(8, 98)), (2, "something else here")]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in got) == sorted([(1, 88, 1), (-1, 88, 1), (-1, 88, 1), (2, 88, 1), (2, 1, 2)])


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(-5, 200), (200, 7000)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()))
    assert {got[k] for k in range(41)} == {0}
    assert {got[k] for k in range(100, 140)} == {100}
    assert {got[k] for k in (-5, 200, 7000)} == {-5}
