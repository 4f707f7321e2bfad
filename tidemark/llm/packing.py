"""Order-preserving packing of token streams into windows of bounded length.

The documents of one input partition form one stream in scan order, each
followed by an end id.  A dynamic program chooses the window cuts:

    best[i] = min over j, 0 < pos[i] - pos[j] <= size, of
              best[j] + padding(pos[i] - pos[j]) + penalty[i]

Candidate cuts are document ends (no penalty), sentence ends (``sentence_cost``)
and, in stretches without either, every ``hard_step`` tokens (``hard_cost``).
Padding is ``size - length``, so best[j] + pos[j] is kept in a monotone queue and
each cut costs amortised constant time.  A window whose length is a power of two needs
no padding: for each cut and each power there is one such transition more.

The stream is solved in blocks of ``block`` tokens that share their last, still
open window, so memory is bounded however long a document or partition is, and a
lost task repeats the same cuts.  At a partition's end the open window is padded.

Null text counts as empty (one end id); repeated rows are packed once each; extra
columns are ignored; an empty input gives no pieces.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import tidy
from .token_counts import load_tokenizer, stable_pieces

SIZE = 2048
END_ID = 1
BLOCK = 1 << 16
PIECE = 1 << 18
SCHEMA = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


class Encoder:
    """Ids as the ``tokenizers`` library gives them for a byte-level vocabulary.

    The ranks and merges of such a vocabulary are the same data, so the ids come
    from the faster ``tiktoken`` engine; special strings in a text become their
    special id, as is the default of ``tokenizers``.
    """

    def __init__(self, path: str, ranks_path: str | None, pattern: str | None):
        self.tok = None
        if ranks_path is None:
            self.tok = load_tokenizer(path)
            return
        import base64
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            special = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.enc = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        if self.tok is not None:
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)
        parts = [self.enc.encode_to_numpy(t, allowed_special="all") for t in stable_pieces(text, PIECE)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def sentence_ends(self) -> np.ndarray:
        """For each id: does its text end a sentence or line?"""
        if self.tok is not None:
            n = self.tok.get_vocab_size()
            texts = [self.tok.decode([i]).encode() for i in range(n)]
        else:
            n = self.enc.n_vocab
            texts = [b""] * n
            for raw, i in self.enc._mergeable_ranks.items():
                texts[i] = raw
        return np.array([t.endswith((b".", b"!", b"?", b"\n")) for t in texts], bool)


def best_cuts(pos: list[int], cost: list[int], size: int, tail: bool = False) -> list[int]:
    """Indexes of the chosen cuts.  ``pos`` ascends from a start at pos[0]; gaps
    are at most ``size``.  The last position is always a cut; unless ``tail``,
    it is not charged for padding, as its window stays open."""
    n = len(pos)
    best, back = [0] * n, [0] * n
    queue: deque[int] = deque()
    exact: dict[int, list[int]] = {}
    places = np.asarray(pos)
    for w in (1 << k for k in range(size.bit_length()) if 1 << k < size):
        before = np.searchsorted(places, places - w)
        for i in np.flatnonzero(places[before] == places - w).tolist():
            exact.setdefault(i, []).append(int(before[i]))
    last = n - 1
    for i in range(1, n):
        j = i - 1
        key = best[j] + pos[j]
        while queue and best[queue[-1]] + pos[queue[-1]] > key:
            queue.pop()
        queue.append(j)
        p = pos[i]
        low = p - size
        while pos[queue[0]] < low:
            queue.popleft()
        j = queue[0]
        if i == last and not tail:
            # the window stays open: any earlier cut in reach, cheapest first
            j = min(queue, key=lambda k: (best[k], -k))
            best[i], back[i] = best[j], j
            break
        value, from_ = best[j] + size - p + pos[j], j
        for k in exact.get(i, ()):
            if best[k] < value:
                value, from_ = best[k], k
        best[i], back[i] = value + cost[i], from_
    cuts, i = [], last
    while i > 0:
        cuts.append(i)
        i = back[i]
    return cuts[::-1]


class Packer:
    """Streams documents in, yields pieces as rows."""

    def __init__(self, ends: np.ndarray, base: int, size: int, block: int, sentence_cost: int, hard_cost: int, hard_step: int):
        self.ends, self.size, self.block = ends, size, block
        self.sentence_cost, self.hard_cost, self.hard_step = sentence_cost, hard_cost, hard_step
        self.sequence = base
        self.parts: list[tuple] = []  # (doc, ids, start in its document, tokens of the document, closes the document)
        self.held = 0

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        total = len(ids)
        for lo in range(0, total, self.block):
            part = ids[lo : lo + self.block]
            self.parts.append((doc, part, lo, total, lo + len(part) == total))
            self.held += len(part)
            if self.held >= self.block:
                yield from self.solve(False)

    def solve(self, tail: bool) -> Iterator[tuple]:
        if not self.held:
            return
        ids = self.parts[0][1] if len(self.parts) == 1 else np.concatenate([p[1] for p in self.parts])
        cost = np.full(len(ids) + 1, -1, np.int32)
        cost[1:][self.ends[ids]] = self.sentence_cost
        edges = np.cumsum([len(p[1]) for p in self.parts])
        cost[edges] = [0 if p[4] else max(self.hard_cost, 0) for p in self.parts]
        cost[0], cost[-1] = 0, 0
        pos = np.flatnonzero(cost >= 0)
        gaps = np.diff(pos)
        wide = np.flatnonzero(gaps > 2 * self.hard_step)
        if len(wide):
            extra = np.concatenate([np.arange(pos[k] + self.hard_step, pos[k + 1], self.hard_step) for k in wide])
            cost[extra] = self.hard_cost
            pos = np.flatnonzero(cost >= 0)
        where = pos.tolist()
        cuts = [where[i] for i in best_cuts(where, cost[pos].tolist(), self.size, tail)]
        done = cuts if tail else cuts[:-1]
        k, inside, low = 0, 0, 0
        for high in done:
            fill = 0
            while fill < high - low:
                doc, part, start, total, _ = self.parts[k]
                take = min(len(part) - inside, high - low - fill)
                piece = part[inside : inside + take]
                yield doc, start + inside, take, zlib.crc32(np.ascontiguousarray(piece, "<u4").tobytes()), total, self.sequence, fill
                fill += take
                inside += take
                if inside == len(part):
                    k, inside = k + 1, 0
            self.sequence += 1
            low = high
        rest = self.parts[k:]
        if rest and inside:
            doc, part, start, total, closes = rest[0]
            rest[0] = (doc, part[inside:], start + inside, total, closes)
        self.parts, self.held = rest, self.held - low


def pack(docs: DataFrame, tokenizer_path: str, *, ranks_path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end_id: int = END_ID, block: int = BLOCK, sentence_cost: int = 8, hard_cost: int = 64, hard_step: int = 64) -> DataFrame:
    """Pieces (id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    ``ranks_path`` and ``pattern`` name the same vocabulary as ranks; without them
    the ids come from ``tokenizers`` itself.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.selectExpr(f"`{id_col}` AS id", f"coalesce(`{text_col}`, '') AS text")
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(tokenizer_path, ranks_path, pattern)
        packer = Packer(enc.sentence_ends(), TaskContext.get().partitionId() << 40, size, block, sentence_cost, hard_cost, hard_step)
        end = np.array([end_id], np.uint32)
        rows: list[tuple] = []
        id_type = None

        def batch_of(rows):
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), *(pa.array(c, pa.int64()) for c in cols[1:])], names)

        for batch in batches:
            id_type = batch.schema.field("id").type
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                rows.extend(packer.add(doc, np.concatenate([enc.ids(text.as_py()), end])))
                if len(rows) >= 20_000:
                    yield batch_of(rows)
                    rows = []
        rows.extend(packer.solve(True))
        if rows:
            yield batch_of(rows)
        tidy()

    return src.mapInArrow(run, f"id {kind}, {SCHEMA}").withColumnRenamed("id", id_col)
