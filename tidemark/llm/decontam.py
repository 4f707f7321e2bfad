"""Benchmark decontamination by latent semantic retrieval.

Index.  Benchmark items are cut into passages of at most ``WINDOW`` words.  Their
TF-IDF matrix (document frequencies of their words, over all documents) is factored by a
distributed randomised SVD: executors return partial products A^T (A Q) of their
passages, the driver orthonormalises the thin factor, and a few such rounds give
the ``rank`` leading right singular vectors.

Search.  A word's latent vector is its idf times its singular row, so a window's
vector is a sum over its words.  Every document is cut into windows of ``WINDOW``
words that overlap by half.  The cosine of a window and a passage is taken in the
latent space, against the full TF-IDF norm of the window's benchmark words and scaled
so that a passage has 1 with itself; from ``min_cosine`` the window is a candidate,
less for a passage that fills only part of a window.  Other words weigh nothing: any
weight that grows with the number of documents would lose in a large table what is
found in a small one.  All windows of all documents meet all passages.

Checks.  A candidate window must hold at least ``bag_least`` of the passage's words
in any order.  Its region is then compared word by word with the whole item: the
longest common subsequence of a stretch at most a quarter longer than the item, as a
share of the item, must reach ``lcs_sure``, or ``lcs_least`` with at least ``answer_least`` of the item's answer words (its rarest
quarter) in the region, which admits paraphrases but not a shared style.

Items of fewer than ``MIN_WORDS`` words say too little for that: they are found where
their words stand in the document one after another (cosine and shares 1).

The benchmark is taken in blocks of at most ``BLOCK_ITEMS`` items and
``BLOCK_BYTES`` bytes, so what is broadcast is bounded; each block makes a pass.
Very long texts are searched in parts, which overlap by twice the longest item.

Null or wordless texts match nothing, on either side; an item repeated under
several ids is reported under each, and a document that holds several items for each of
them; of the places of one item the one with the largest LCS, then answer share, then
cosine is reported; repeated documents are each reported; extra columns are ignored; an
empty side gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import relieve, tidy

WORD = re.compile(r"\w+")
WINDOW = 32
HALF = WINDOW // 2
BITS = 14
DIM = 1 << BITS
CHUNK_ROWS = 512
MIN_WORDS = 8
CELLS = 1 << 10
TABLE_BYTES = 1 << 26
BLOCK_ITEMS = 4096
BLOCK_BYTES = 1 << 20
CHUNK_WORDS = 1 << 15
SLICE = 1 << 16


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def passages_of(words: list[str]) -> list[list[str]]:
    """Windows of WINDOW words, overlapping by half; the last ends the text."""
    if len(words) <= WINDOW:
        return [words] if words else []
    starts = list(range(0, len(words) - WINDOW, HALF)) + [len(words) - WINDOW]
    return [words[s : s + WINDOW] for s in starts]


def slot_of(word: str) -> int:
    """The feature that a word of the benchmark is hashed to."""
    import zlib

    return zlib.crc32(word.encode("utf-8", "replace")) >> (32 - BITS)


def passage_vector(words: list[str], idf: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values) of a unit TF-IDF vector; slots may repeat."""
    tf = Counter(words)
    at = np.array([slot_of(w) for w in tf], np.int64)
    v = np.array([n * idf[w] for w, n in tf.items()], np.float32)
    return at, v / max(float(np.sqrt((v * v).sum())), 1e-9)


def document_frequency(docs: DataFrame, vocabulary: list[str]) -> tuple[np.ndarray, int]:
    """In how many documents each word is, over all documents, and their number."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: k for k, w in enumerate(sent.value)}
        df, n = np.zeros(len(number) + 1, np.int64), 0
        known = frozenset(number)
        for batch in batches:
            for text in batch.column(0):
                found = known.intersection(words_of(text.as_py()))
                df[[number[w] for w in found]] += 1
                n += 1
        df[-1] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["word", "n"])

    df = np.zeros(len(vocabulary) + 1, np.int64)
    for k, n in docs.select("text").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n")).collect():
        df[k] = n
    return df[:-1], int(df[-1])


def randomised_svd(passages: DataFrame, idf: dict[str, float], rank: int, *, extra: int = 8, rounds: int = 3, seed: int = 5) -> np.ndarray:
    """The leading right singular vectors (DIM x rank) of the passages' TF-IDF
    matrix.  passages: one column of word arrays, any number of partitions."""
    spark = passages.sparkSession
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((DIM, rank + extra)))[0].astype(np.float32)
    sent_idf = spark.sparkContext.broadcast(idf)

    def gram(q: np.ndarray) -> np.ndarray:
        sent = spark.sparkContext.broadcast(q)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, idf = sent.value, sent_idf.value
            out = np.zeros_like(q)
            for batch in batches:
                for words in batch.column(0).to_pylist():
                    at, v = passage_vector(words, idf)
                    np.add.at(out, at, v[:, None] * (v @ q[at])[None, :])
            for c in np.flatnonzero(np.abs(out).reshape(DIM // CHUNK_ROWS, -1).sum(1)):
                yield pa.RecordBatch.from_arrays([pa.array([int(c)]), pa.array([out[c * CHUNK_ROWS : (c + 1) * CHUNK_ROWS].tobytes()])], ["chunk", "rows"])

        def add(table: pa.Table) -> pa.Table:
            total = np.sum([np.frombuffer(r.as_py(), np.float32) for r in table.column("rows")], axis=0, dtype=np.float64)
            return pa.table({"chunk": table.column("chunk")[:1], "rows": pa.array([total.astype(np.float32).tobytes()])})

        schema = "chunk bigint, rows binary"
        out = np.zeros_like(q)
        found = passages.mapInArrow(run, schema).groupBy("chunk").applyInArrow(add, schema).toArrow()  # DIM / CHUNK_ROWS rows
        for chunk, rows in zip(found.column("chunk").to_pylist(), found.column("rows"), strict=True):
            out[chunk * CHUNK_ROWS : (chunk + 1) * CHUNK_ROWS] = np.frombuffer(rows.as_buffer(), np.float32).reshape(CHUNK_ROWS, -1)
        sent.destroy()
        relieve(spark)
        return out

    for _ in range(rounds):
        q = np.linalg.qr(gram(q))[0].astype(np.float32)
    value, vector = np.linalg.eigh(q.T @ gram(q))
    return (q @ vector[:, np.argsort(-value)[:rank]]).astype(np.float32)


def lcs_length(bits: dict[int, int], size: int, other: list[int]) -> int:
    """Longest common subsequence with the text whose positions by word are
    ``bits``, by bit-parallel dynamic programming."""
    full = (1 << size) - 1
    v = full
    for w in other:
        m = bits.get(w)
        if m is not None:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


class Index:
    """A block's items, ready for search; plain arrays only, so it can be sent."""

    def __init__(self, items: list[tuple], vocabulary: list[str], basis: np.ndarray, idf: dict[str, float]):
        self.number = {w: k for k, w in enumerate(vocabulary)}
        idf_of = np.array([idf[w] for w in vocabulary], np.float32)
        # two more rows: any word that the benchmark lacks, and padding
        self.table = np.zeros((len(vocabulary) + 2, basis.shape[1]), np.float32)
        self.table[:-2] = basis[[slot_of(w) for w in vocabulary]] * idf_of[:, None]
        self.energy = np.concatenate([idf_of**2, [0.0, 0.0]]).astype(np.float32)
        self.items, owner, vectors, sizes, full, held = [], [], [], [], [], []
        self.short: dict[int, dict[tuple, list]] = {}  # by length: items by their words
        for item, words in items:
            ids = [self.number[w] for w in words]
            if len(ids) < MIN_WORDS:
                self.short.setdefault(len(ids), {}).setdefault(tuple(ids), []).append((len(ids), item))
                continue
            bits: dict[int, int] = {}
            for at, w in enumerate(ids):
                bits[w] = bits.get(w, 0) | 1 << at
            rare = sorted(set(ids), key=lambda w: (-idf_of[w], w))
            self.items.append((item, len(ids), bits, set(rare[: max(2, len(rare) // 4)])))
            for part in passages_of(words):
                owner.append(len(self.items) - 1)
                at = [self.number[w] for w in part]
                vectors.append(self.table[at].sum(0))
                full.append(np.sqrt(self.energy[at].sum()))
                sizes.append(len(at))
                held.append(np.unique(at))
        self.longest = max((x[1] for x in self.items), default=0)
        self.words = [frozenset(x[2]) for x in self.items]
        self.owner, self.sizes = np.array(owner, np.int64), np.array(sizes, np.int64)
        # words of the passages: sorted keys passage * words + word, and a table of bounded
        # size by cells of the word number that never says no to a word that is there;
        # with a cell for each word it is exact
        passage = np.repeat(np.arange(len(held)), [len(x) for x in held])
        flat = np.concatenate(held) if held else np.zeros(0, np.int64)
        self.keys = passage * len(self.table) + flat
        self.exact = len(owner) * len(self.table) <= TABLE_BYTES
        cells = len(vocabulary) if self.exact else CELLS
        self.cell = np.append(np.arange(len(vocabulary)) % max(1, cells), [cells, cells])
        self.coarse = np.zeros((len(owner), cells + 1), bool)
        self.coarse[passage, self.cell[flat]] = True
        p = np.array(vectors, np.float32).reshape(len(owner), basis.shape[1])
        norm = np.maximum((p * p).sum(1), 1e-9)
        self.passages = (p * (np.array(full, np.float32) / norm)[:, None]).T.copy()

    def may_hold(self, passage: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which words of ``ids`` (a row for each of ``passage``) may be in the passage."""
        return self.coarse.reshape(-1).take((passage * self.coarse.shape[1])[:, None] + self.cell.take(ids))

    def holds(self, passage: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which words of ``ids`` (a row for each of ``passage``) are in the passage."""
        keys = passage[:, None] * len(self.table) + ids
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys

    def short_items(self, ids: np.ndarray) -> set:
        """Short items whose words stand one after another in a text."""
        found = set()
        for size, items in self.short.items():
            if len(ids) >= size:
                spans = np.lib.stride_tricks.sliding_window_view(ids, size)
                names = np.array(list(items), np.int64)
                powers = np.uint64(0x9E3779B97F4A7C15) ** np.arange(size, dtype=np.uint64)
                mixed = lambda x: (x.astype(np.uint64) * powers).sum(1, dtype=np.uint64)
                for at in np.flatnonzero(np.isin(mixed(spans), mixed(names))).tolist():
                    found.update(items.get(tuple(spans[at].tolist()), ()))
        return found

    def candidates(self, ids: np.ndarray, blocks: np.ndarray, min_cosine: float, bag_least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, cosine) of windows near a passage.  ids: words in rows of
        HALF, padded; blocks: a document number for each row; a window is a row and
        the next of its document."""
        same = np.append(blocks[:-1] == blocks[1:], False)
        half, energy = self.table[ids].sum(1), self.energy[ids].sum(1)
        window, full = half.copy(), energy.copy()
        window[same] += half[1:][same[:-1]]
        full[same] += energy[1:][same[:-1]]
        norm = np.maximum(np.sqrt(full), np.linalg.norm(window, axis=1))
        cosine = (window / np.maximum(norm, 1e-9)[:, None]) @ self.passages
        at, p = np.nonzero(cosine >= min_cosine * np.sqrt(self.sizes / WINDOW, dtype=np.float32))
        rows, passages = [at[:0]], [p[:0]]
        for lo in range(0, len(at), SLICE):
            a, q = at[lo : lo + SLICE], p[lo : lo + SLICE]
            for among in (self.may_hold,) if self.exact else (self.may_hold, self.holds):
                bag = among(q, ids[a]).sum(1)
                two = same[a]
                bag[two] += among(q[two], ids[a[two] + 1]).sum(1)
                good = bag >= bag_least * self.sizes[q]
                a, q = a[good], q[good]
            rows.append(a)
            passages.append(q)
        at, p = np.concatenate(rows), np.concatenate(passages)
        return at, self.owner[p], cosine[at, p]

    def check(self, item: int, words: list[int], lcs_sure: float, lcs_least: float, answer_least: float) -> tuple[int, float] | None:
        """(LCS, answer share) of a region that holds the item, else None."""
        _, size, bits, answer = self.items[item]
        lost = len(bits) - len(self.words[item].intersection(words))
        if size - lost < lcs_least * size:
            return None  # each word that is missing costs one at least
        got = lcs_length(bits, size, words)
        if got < lcs_least * size:
            return None
        # the same within a stretch about as long as the item
        width, step = size + size // 4, max(1, size // 8)
        best = (0, 0.0)
        for at in range(0, max(1, len(words) - width + step), step):
            part = words[at : at + width]
            best = max(best, (lcs_length(bits, size, part), len(answer.intersection(part)) / len(answer)))
        got, share = best
        return best if got >= lcs_sure * size or got >= lcs_least * size and share >= answer_least else None


def search(docs: DataFrame, index: Index, item_type: T.DataType, *, min_cosine: float, bag_least: float, lcs_sure: float, lcs_least: float, answer_least: float) -> DataFrame:
    """(id, item_id, cosine, lcs, lcs_share, answer_share) of what holds an item."""
    kind, item_kind = docs.schema["id"].dataType.simpleString(), item_type.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(index.__dict__)
    names = ["id", "item_id", "cosine", "lcs", "lcs_share", "answer_share"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index.__new__(Index)
        index.__dict__.update(sent.value)
        get, other = index.number.get, len(index.number)
        pad = other + 1
        overlap = 2 * (index.longest + WINDOW)

        def solve(held):
            """held: (id, word numbers) of some documents."""
            sizes = [-(-len(w) // HALF) for _, w in held]
            ids = np.full((sum(sizes), HALF), pad, np.int64)
            flat, first, at = ids.reshape(-1), [], 0
            for (_, w), n in zip(held, sizes, strict=True):
                flat[at * HALF : at * HALF + len(w)] = w
                first.append(at)
                at += n
            blocks = np.repeat(np.arange(len(held)), sizes)
            best: dict[tuple, tuple] = {}
            for b, item, cosine in zip(*(x.tolist() for x in index.candidates(ids, blocks, min_cosine, bag_least)), strict=True):
                doc = int(blocks[b])
                words, size = held[doc][1], index.items[item][1]
                at = (b - first[doc]) * HALF
                region = words[max(0, at - size) : at + WINDOW + size]
                found = index.check(item, region[region < other].tolist(), lcs_sure, lcs_least, answer_least)
                if found:
                    new = (found[0], found[1], cosine)
                    best[doc, item] = max(best.get((doc, item), new), new)
            return [(held[d][0], index.items[i][0], float(c), n, n / index.items[i][1], a) for (d, i), (n, a, c) in sorted(best.items())]

        for batch in batches:
            rows, held, size = [], [], 0
            id_type = batch.schema.field("id").type
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                words = words_of(text.as_py())
                numbers = np.fromiter(map(get, words, repeat(other)), np.int64, len(words))
                rows += [(doc, item, 1.0, n, 1.0, 1.0) for n, item in sorted(index.short_items(numbers), key=str)]
                for lo in range(0, len(numbers) if index.items else 0, CHUNK_WORDS):
                    part = numbers[max(0, lo - overlap) : lo + CHUNK_WORDS]
                    if len(part):
                        held.append((doc, part))
                        size += len(part)
                if size >= CHUNK_WORDS:
                    rows += solve(held)
                    held, size = [], 0
            if held:
                rows += solve(held)
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            types = [id_type, None, pa.float64(), pa.int64(), pa.float64(), pa.float64()]
            if rows or types:
                types[1] = pa.int64() if item_kind == "bigint" else pa.int32() if item_kind == "int" else pa.string()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)
        tidy()

    out = docs.mapInArrow(run, f"id {kind}, item_id {item_kind}, cosine double, lcs bigint, lcs_share double, answer_share double")
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rank: int = 128, min_cosine: float = 0.4, bag_least: float = 0.45, lcs_sure: float = 0.7, lcs_least: float = 0.5, answer_least: float = 0.6) -> DataFrame:
    """A row for each document and benchmark item that it holds."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).where("text IS NOT NULL")
    item_type = benchmark.schema[item_col].dataType
    if item_type.simpleString() not in ("bigint", "int"):
        items, item_type = items.withColumn("item", F.col("item").cast("string")), T.StringType()
    total, size = items.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    blocks = max(1, -(-total // BLOCK_ITEMS), -(-(size or 0) // BLOCK_BYTES))
    out = None
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        rows = [(item, words) for item, words in ((r.item, words_of(r.text)) for r in part.collect()) if words]  # a bounded block
        rows.sort(key=lambda r: str(r[0]))
        if not rows:
            continue
        vocabulary = sorted({w for _, words in rows for w in words})
        df, n = document_frequency(src, vocabulary)
        idf = {w: float(np.log((1 + n) / (1 + d)) + 0.1) for w, d in zip(vocabulary, df.tolist(), strict=True)}
        passages = [(p,) for _, words in rows if len(words) >= MIN_WORDS for p in passages_of(words)]
        basis = randomised_svd(spark.createDataFrame(passages, "words array<string>"), idf, rank) if passages else np.zeros((DIM, 1), np.float32)
        found = search(src, Index(rows, vocabulary, basis, idf), item_type, min_cosine=min_cosine, bag_least=bag_least, lcs_sure=lcs_sure, lcs_least=lcs_least, answer_least=answer_least)
        out = found if out is None else out.unionByName(found)
    if out is None:
        schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("item_id", item_type), T.StructField("cosine", T.DoubleType()), T.StructField("lcs", T.LongType()), T.StructField("lcs_share", T.DoubleType()), T.StructField("answer_share", T.DoubleType())])
        out = spark.createDataFrame([], schema)
    return out.withColumnRenamed("id", id_col)
