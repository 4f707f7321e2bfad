"""Exact Jaccard self-join of word-shingle sets by token-combination prefixes.

A document's set holds its distinct k-word shingles (lower-cased A-Z, words split at
ASCII white space; fewer words: the whole sequence as one).  Documents with equal
sets form a class first, so copies cost one class.  Two sets of at least num / den
similarity differ, seen from either one of n shingles, in at most
t(n) = n - ceil(num n / den) of its shingles.

Hash prefixes.  In the order of their hashes, the first t + l shingles of two linked
sets have at least the lesser l in common.  So a class whose prefix holds fewer
shingles of other prefixes than the least l of a possible partner links with nothing
and goes no further; this costs a fraction of the shingles and leaves few classes.

Combinations.  Over what is left the classes of each shingle are counted, and shingles
are ordered by that.  A shingle of one class only can't be shared, so a class with more
than t of them links with nothing.  Rare shingles are indexed one by one; frequent ones
(``Plan.frequent`` classes or more) are dealt by hash into token classes whose pairs are
indexed, and very frequent ones (``Plan.common``) into token classes whose triples are.
The prefix is extended until rare shingles, plus what each token class has beyond
k - 1, come to t + 1: of two linked sets, the one whose prefix ends first then has a
whole combination in common with the other.  How many token classes there are depends
on the size level; levels overlap such that any two sets that can link are in one level
together, and there are few enough classes for every prefix to end.

Counts reach the sets by tables of fixed size (a bitmap of the shared shingles, and
bands of frequency by cells) while there are at most ``bitmap_keys`` shared shingles,
else by joins.  A table may take a shingle for a more frequent one, alike for all sets:
that changes the order and costs time, but loses nothing.

Verification.  Of all classes under a key only the lowest and the highest are compared
with the others at first, so pairs grow with the index and not with its square.  The
links give components; keys whose classes are all in one component are done.  What
lies under the others is compared all against all, in blocks of bounded size that
return a spanning forest of the links.  Components of all links, then of the classes'
documents, are the result.  Overlaps are of 64-bit hashes of whole shingles.

Null or blank text has an empty set and links with nothing; repeated rows (and ids)
fall in one class; an id with several texts is in a class for each; null ids are kept
and their texts link like others; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BITMAP_KEYS, bitmap, discard, in_bitmap, rows_in, settle, tidy
from .components import connected_components

WORDS = 3
GROWTH = 1.3
BLOCK_ROWS = 1024
BLOCK_SHINGLES = 1 << 20
CELLS = 1 << 20

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


class Memo(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 200_000:
            self[word] = h
        return h


def shingles(text: str | None, k: int, memo: Memo) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    k = min(k, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        out = mix(out * M1 + h[j : len(h) - k + 1 + j])
    return np.unique(out)


def class_of(s: np.ndarray) -> int | None:
    """The name of all sets equal to this one."""
    import xxhash

    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None


@dataclass(frozen=True)
class Plan:
    """Threshold num / den, and what counts as frequent."""

    num: int
    den: int
    frequent: int = 32
    common: int = 1024

    def differ(self, n: int) -> int:
        """The most shingles of a set of n that a linked set lacks."""
        return n - -(-self.num * n // self.den)

    def more(self, n: int) -> int:
        """By how much a hash prefix of a set of n is longer than ``differ``: longer
        prefixes tell more, but cost more where more may differ."""
        d = self.differ(n)
        return min(n - d, max(1, d if 10 * (self.den - self.num) <= self.den else d // 2))

    def prefix(self, n: int) -> int:
        return self.differ(n) + self.more(n)

    def least(self, n: int) -> int:
        """The fewest prefix shingles in common with a linked set."""
        smallest = -(-self.num * n // self.den)
        return min(self.more(smallest), self.more(n))

    def bands(self) -> list[int]:
        """Numbers of classes from which a shingle counts as more frequent."""
        return sorted({2, 4, 12, self.frequent, self.common})

    def levels(self, n: int) -> list[tuple[int, int]]:
        """(level, token classes of a band) of the size levels that sets of n belong
        to: level i holds sizes from GROWTH ** i up to GROWTH ** (i + 1) * den / num.
        0 classes: there all shingles are indexed one by one."""
        out = []
        i = int(math.log(n) / math.log(GROWTH)) + 1
        while i >= 0:
            low, high = math.floor(GROWTH**i), math.ceil(GROWTH ** (i + 1) * self.den / self.num)
            if high < n:
                break
            if low <= n:
                g = max(1, low // 12)
                out.append((i, g if 3 * g <= -(-self.num * low // self.den) - 1 else 0))
            i -= 1
        return out

    def keys(self, n: int, tokens: np.ndarray, df: np.ndarray) -> np.ndarray:
        """Index keys of a set of n shingles.  tokens: those of several classes; df:
        the number of classes of each."""
        need = self.differ(n) + 1 - (n - len(tokens))
        if need <= 0:
            return tokens[:0]
        order = np.lexsort((tokens, df))
        tokens, df = tokens[order], df[order]
        rare = int(np.searchsorted(df, self.frequent))
        if rare >= need:
            return mix(tokens[:need] + M1)
        out = [mix(tokens[:rare] + M1)]
        rest, need = tokens[rare:], need - rare
        size = np.where(df[rare:] >= self.common, 3, 2)
        for level, classes in self.levels(n):
            if not classes:
                out.append(mix(rest[:need] + M1))
                continue
            tag = np.uint64(level + 1) << np.uint64(40)
            dealt = (mix(rest ^ mix(np.array([tag]))) % np.uint64(classes)).astype(np.int64) * 4 + size
            by = np.argsort(dealt, kind="stable")
            first = np.flatnonzero(np.append(True, dealt[by][1:] != dealt[by][:-1]))
            rank = np.empty(len(rest), np.int64)
            rank[by] = np.arange(len(rest)) - np.repeat(first, np.diff(np.append(first, len(rest))))
            end = int(np.searchsorted(np.cumsum(rank >= size - 1), need)) + 1
            mixed = mix(rest[:end] + M2)
            by = by[by < end]
            for group in np.split(by, np.flatnonzero(dealt[by][1:] != dealt[by][:-1]) + 1):
                k = int(size[group[0]])
                if len(group) >= k:
                    sums = np.array(list(combinations(mixed[group], k)), np.uint64).sum(1, dtype=np.uint64)
                    out.append(mix(sums ^ mix(np.array([tag + np.uint64(k)]))))
        return np.unique(np.concatenate(out))


def lists_of(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)))


def index_documents(docs: DataFrame, k: int, plan: Plan) -> DataFrame:
    """(id, h, row, n, class, prefix) per document (id, h, text)."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo()
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            sets = [shingles(text.as_py(), k, memo) for text in batch.column("text")]
            n = [len(s) for s in sets]
            rows = range(row, row := row + len(sets))
            cols = [batch.column("id"), batch.column("h"), pa.array(rows, pa.int64()), pa.array(n, pa.int64()), pa.array(map(class_of, sets), pa.int64())]
            yield pa.RecordBatch.from_arrays([*cols, lists_of([s[: plan.prefix(len(s))] for s in sets])], ["id", "h", "row", "n", "class", "prefix"])
        memo.clear()
        tidy()

    return docs.select("id", "h", "text").mapInArrow(run, f"id {kind}, h bigint, row bigint, n bigint, class bigint, prefix array<bigint>")


def alive_classes(index: DataFrame, plan: Plan, bitmap_keys: int) -> DataFrame:
    """(class, h) of the classes that may link, with the hash of a text of theirs."""
    index = index.where("n > 0" if 2 * plan.num <= plan.den else "n > 1")  # a single shingle is half of a set at most
    index = index.join(index.groupBy("class").agg(F.min("row").alias("row")).select("row"), "row", "left_semi")  # a row of each class
    shared = index.select(F.explode("prefix").alias("token")).groupBy("token").count().where("count > 1").select("token")
    shared = settle(shared, "jaccard-shared")
    if shared.count() <= bitmap_keys:
        sent = index.sparkSession.sparkContext.broadcast(bitmap(shared, "token"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = sent.value
            for batch in batches:
                lists = batch.column("prefix")
                ends = lists.offsets.to_numpy()
                hits = np.concatenate([[0], np.cumsum(in_bitmap(bits, lists.flatten().to_numpy()))])
                got = np.diff(hits[ends - ends[0]])
                least = np.array([plan.least(n) for n in batch.column("n").to_pylist()])
                yield batch.select(["class", "h"]).filter(pa.array(got >= least))
            tidy()

        return index.select("class", "h", "n", "prefix").mapInArrow(run, "class bigint, h bigint")
    some = index.select("class", "h", "n", F.explode("prefix").alias("token")).join(shared, "token", "left_semi")

    @F.pandas_udf("bigint")
    def least(sizes):
        return sizes.map(plan.least)

    return some.groupBy("class", "h", "n").agg(F.count("*").alias("got")).where(F.col("got") >= least("n")).select("class", "h")


def sets_of(docs: DataFrame, alive: DataFrame, k: int, bitmap_keys: int) -> DataFrame:
    """(class, n, tokens) of the classes in ``alive``."""
    texts = docs.select("h", "text")
    if alive.count() <= bitmap_keys:
        texts = rows_in(texts, F.col("h"), bitmap(alive, "h"))
    texts = texts.groupBy("h").agg(F.first("text").alias("text")).join(alive, "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo()
        for batch in batches:
            sets = [shingles(text.as_py(), k, memo) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("class"), pa.array([len(s) for s in sets], pa.int64()), lists_of(sets)], ["class", "n", "tokens"])
        memo.clear()
        tidy()

    return texts.select("class", "text").mapInArrow(run, "class bigint, n bigint, tokens array<bigint>")


def index_keys(sets: DataFrame, plan: Plan, bitmap_keys: int) -> DataFrame:
    """(key, class, n) by the number of classes of each token."""
    df = sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    df = settle(df, "jaccard-df")
    schema = "key bigint, class bigint, n bigint"

    def batch_of(keys, name, n):
        times = [len(x) for x in keys]
        flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(np.repeat(name.to_numpy(), times)), pa.array(np.repeat(n.to_numpy(), times))], ["key", "class", "n"])

    if df.count() <= bitmap_keys:
        edges = np.array(plan.bands())
        band = sum((F.col("df") >= int(e)).cast("int") for e in edges) - 1
        cell = F.shiftrightunsigned("token", 38).bitwiseAND(F.lit(CELLS - 1)).cast("int")
        cells = df.where(F.col("df") >= int(edges[1])).groupBy(cell.alias("cell")).agg(F.max(band).cast("tinyint").alias("band")).toArrow()  # at most CELLS rows
        bands = np.zeros(CELLS, np.int8)
        bands[cells.column("cell").to_numpy()] = cells.column("band").to_numpy()
        sent = sets.sparkSession.sparkContext.broadcast((bitmap(df, "token"), bands))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits, bands = sent.value
            for batch in batches:
                tokens, keys = batch.column("tokens"), []
                t, ends = tokens.flatten().to_numpy(), tokens.offsets.to_numpy()
                inside, times = in_bitmap(bits, t), edges[bands[t.view(np.uint64) >> np.uint64(38) & np.uint64(CELLS - 1)]]
                t, ends = t.view(np.uint64), ends - ends[0]
                for n, a, b in zip(batch.column("n").to_pylist(), ends[:-1], ends[1:], strict=True):
                    at = np.flatnonzero(inside[a:b]) + a
                    keys.append(plan.keys(n, t[at], times[at]))
                yield batch_of(keys, batch.column("class"), batch.column("n"))
            tidy()

        return sets.select("class", "n", "tokens").mapInArrow(run, schema)

    rows = sets.select("class", "n", F.explode("tokens").alias("token")).join(df, "token")
    found = rows.groupBy("class", "n").agg(F.collect_list("token").alias("tokens"), F.collect_list("df").alias("df"))  # a set each

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, df = batch.column("tokens"), batch.column("df")
            t, d, ends = tokens.flatten().to_numpy().view(np.uint64), df.flatten().to_numpy(), tokens.offsets.to_numpy()
            ends = ends - ends[0]
            keys = [plan.keys(n, t[a:b], d[a:b]) for n, a, b in zip(batch.column("n").to_pylist(), ends[:-1], ends[1:], strict=True)]
            yield batch_of(keys, batch.column("class"), batch.column("n"))

    return found.mapInArrow(exact, schema)


def verified(pairs: DataFrame, sets: DataFrame, plan: Plan) -> DataFrame:
    """The pairs (u, v) that link."""
    side = lambda c: sets.select(F.col("class").alias(c), F.col("tokens").alias(f"{c}_tokens"))
    both = pairs.join(side("u"), "u").join(side("v"), "v")
    overlap = F.size(F.array_intersect("u_tokens", "v_tokens"))
    union = F.size("u_tokens") + F.size("v_tokens") - overlap
    return both.where(plan.den * overlap >= plan.num * union).select("u", "v")


def block_links(left: list[np.ndarray], right: list[np.ndarray] | None, num: int, den: int, labels: list[int]) -> list[tuple[int, int]]:
    """Links among ``left``, or between ``left`` and ``right``, as many as it takes to
    join what they join; indexes of ``right`` follow those of ``left``.  Sets with the
    same label are joined already."""
    sets = left + (right or [])
    if len(set(labels)) < 2:
        return []
    sizes = np.array([len(s) for s in sets])
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    names, number, count = np.unique(tokens, return_inverse=True, return_counts=True)
    shared = count[number] > 1
    number, owner = number[shared], owner[shared]
    compact = np.cumsum(count > 1) - 1
    number = compact[number]
    order = np.argsort(number, kind="stable")
    number, owner = number[order], owner[order]
    a = len(left)
    b0 = 0 if right is None else a
    overlap = np.zeros((a, len(sets) - b0), np.float32)
    width = 4096
    for lo in range(0, int(number[-1]) + 1 if len(number) else 0, width):
        i, j = np.searchsorted(number, [lo, lo + width])
        x = np.zeros((len(sets), width), np.float32)
        x[owner[i:j], number[i:j] - lo] = 1
        overlap += x[:a] @ x[b0:].T
    o = overlap.astype(np.int64)
    union = sizes[:a, None] + sizes[None, b0:] - o
    linked = den * o >= num * union
    first: dict[int, int] = {}
    root = [first.setdefault(label, x) for x, label in enumerate(labels)]

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in np.argwhere(linked):
        i, j = int(i), int(j) + b0
        p, q = find(i), find(j)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((i, j))
    return out


def block_pairs(members: DataFrame, sets: DataFrame, plan: Plan, block_rows: int, block_shingles: int) -> DataFrame:
    """(u, v) links within each key of (key, class, n, label) rows that join different
    labels, all against all, dealt into blocks of bounded size; every pair of a key's
    blocks meets in one task."""
    sizes = members.groupBy("key").agg(F.count("*").alias("rows"), F.sum("n").alias("all"))
    blocks = F.greatest(F.ceil(F.col("rows") / block_rows), F.ceil(F.col("all") / block_shingles)).cast("int")
    dealt = members.join(sizes.select("key", blocks.alias("blocks")), "key")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("left"), F.greatest("block", o).alias("right"), F.when(o < F.col("block"), 1).otherwise(0).alias("side")))
    held = dealt.join(sets.select("class", "tokens"), "class").select("key", "class", "label", "tokens", F.explode(pair).alias("pair")).select("key", "class", "label", "tokens", "pair.left", "pair.right", "pair.side")

    def run(table: pa.Table) -> pa.Table:
        sides, names, labels = (table.column(c).to_pylist() for c in ("side", "class", "label"))
        found = [t.values.to_numpy().view(np.uint64) for t in table.column("tokens")]
        left = [x for x, s in enumerate(sides) if s == 0]
        right = [x for x, s in enumerate(sides) if s == 1]
        rows = left + right
        links = block_links([found[x] for x in left], [found[x] for x in right] if right else None, plan.num, plan.den, [labels[x] for x in rows]) if left else []
        return pa.table({"u": pa.array([names[rows[i]] for i, _ in links], pa.int64()), "v": pa.array([names[rows[j]] for _, j in links], pa.int64())})

    return held.groupBy("key", "left", "right").applyInArrow(run, "u bigint, v bigint")


def class_links(sets: DataFrame, plan: Plan, block_rows: int, block_shingles: int, bitmap_keys: int) -> DataFrame:
    """(class, label) of the classes that link with another."""
    keys = settle(index_keys(sets, plan, bitmap_keys), "jaccard-keys")
    ends = keys.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high")
    kept = settle(keys.join(ends, "key"), "jaccard-kept")
    pairs = kept.select(F.explode(F.array("low", "high")).alias("w"), "class").where("w <> class")
    pairs = settle(pairs.select(F.least("w", "class").alias("u"), F.greatest("w", "class").alias("v")).distinct(), "jaccard-pairs")
    links = settle(verified(pairs, sets, plan), "jaccard-links")
    labels = connected_components(links).select(F.col("node").alias("class"), "label")

    # keys whose classes are not yet all in one component; of keys with the same
    # classes, one
    member = kept.select("key", "class", "n").join(labels, "class", "left").withColumn("label", F.coalesce("label", "class"))
    open_keys = member.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("rows"), F.sum(F.xxhash64("class").cast("decimal(30,0)")).alias("hash")).where("low <> high AND rows > 3")
    open_keys = open_keys.groupBy("rows", "hash").agg(F.min("key").alias("key")).select("key")
    rest = settle(member.join(open_keys, "key"), "jaccard-open")
    more = settle(links.unionByName(block_pairs(rest, sets, plan, block_rows, block_shingles)), "jaccard-links")
    for df in (keys, kept, pairs, rest, links):
        discard(df)
    return connected_components(more).select(F.col("node").alias("class"), "label")


def jaccard_groups(docs: DataFrame, *, num: int = 9, den: int = 10, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", block_rows: int = BLOCK_ROWS, block_shingles: int = BLOCK_SHINGLES, frequent: int = 32, common: int = 1024, bitmap_keys: int = BITMAP_KEYS) -> DataFrame:
    """(id, h, n, group) of every row: xxhash64 of its text, the size of its set and a
    name of its component (null: empty set); threshold num / den."""
    plan = Plan(num, den, frequent, common)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    index = settle(index_documents(src, words, plan), "jaccard-index")
    alive = settle(alive_classes(index, plan, bitmap_keys), "jaccard-alive")
    sets = settle(sets_of(src, alive, words, bitmap_keys), "jaccard-sets")
    labels = class_links(sets, plan, block_rows, block_shingles, bitmap_keys)
    return index.select("id", "h", "n", "class").join(labels, "class", "left").select("id", "h", "n", F.coalesce("label", "class").alias("group"))


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """(id, n_shingles, component_id) of every row; options as for jaccard_groups."""
    base = settle(jaccard_groups(docs, id_col=id_col, **options), "jaccard-groups")
    lowest = base.where("group IS NOT NULL").groupBy("group").agg(F.min("id").alias("component_id"))
    out = base.join(lowest, "group", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
