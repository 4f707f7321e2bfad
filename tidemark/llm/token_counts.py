"""Token counts by overlap resynchronisation.

A text of more than ``chunk`` characters is encoded in overlapping chunks that
keep their offsets; neighbours are spliced at a *stable common boundary*: a
position where both encodings end a token and which every encoding of the text
must end a token at, namely a space between two characters that are not white
space.  The vocabulary's pre-tokeniser takes a space only as the first character
of a piece and looks no further back, so the pieces before such a space do not
depend on what follows it, nor the pieces after it on what precedes it.  Where an
overlap holds no such position it is widened, and the chunk itself after that,
until one is found or the text ends.

Shorter texts are cut at all their stable positions, and the tokenizer is asked
once for each distinct part while it is known (``KNOWN`` parts, then it starts
anew).  Where most parts are new, and with a tokenizer whose texts may not be cut
there, texts are encoded at once.

Null text counts as empty; every input row gives one output row, repeated rows
too; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame

CHUNK = 1 << 16
OVERLAP = 1 << 10
LIMIT = 512
GROUP = 64
KNOWN = 1 << 19
KEPT = 64  # characters of a part that is kept
STABLE = re.compile(r" (?=\S)(?<=\S )")


def load_tokenizer(path: str):
    """A single-threaded tokenizer of the ``tokenizers`` library."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def is_stable(text: str, at: int) -> bool:
    return 0 < at < len(text) - 1 and text[at] == " " and not text[at - 1].isspace() and not text[at + 1].isspace()


def stable_cut(text: str, start: int, end: int) -> int:
    """The last stable position in (start, end), or -1."""
    at = text.rfind(" ", start + 1, end)
    while at > start:
        if is_stable(text, at):
            return at
        at = text.rfind(" ", start + 1, at)
    return -1


def stable_pieces(text: str, size: int) -> Iterator[str]:
    """Cut a text at stable positions into pieces of about ``size`` characters."""
    start = 0
    while len(text) - start > size:
        end, cut = start + size, -1
        while cut < 0 and end < len(text):
            cut = stable_cut(text, start, end)
            end += size
        if cut < 0:
            break
        yield text[start:cut]
        start = cut
    yield text[start:]


def _encode(tok, text: str) -> list[int]:
    """End offsets of the tokens, in order."""
    return [end for _, end in tok.encode(text, add_special_tokens=False).offsets]


def _splice(text: str, left: list[int], left_at: int, right: list[int], right_at: int, low: int, high: int) -> tuple[int, int, int] | None:
    """A stable position in [low, high) at which both encodings end a token,
    with the number of tokens of either that end there or before."""
    at = text.find(" ", low, high)
    while at >= 0:
        if is_stable(text, at):
            i, j = bisect_right(left, at - left_at), bisect_right(right, at - right_at)
            if i and left[i - 1] == at - left_at and (at == right_at or j and right[j - 1] == at - right_at):
                return at, i, j
        at = text.find(" ", at + 1, high)
    return None


def count_long(tok, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of one text, encoded in chunks."""
    total, start, end = 0, 0, min(chunk, len(text))
    left, skip = _encode(tok, text[:end]), 0
    while end < len(text):
        width, found = overlap, None
        while found is None:
            begin = max(start + 1, end - width)
            stop = min(len(text), begin + max(chunk, 2 * width))
            right = _encode(tok, text[begin:stop])
            found = _splice(text, left, start, right, begin, begin, end - 1)
            if found is None and begin == start + 1:
                break
            width *= 2
        if found is None:
            end = min(len(text), end + (end - start))
            left = _encode(tok, text[start:end])
            continue
        _, i, j = found
        total += i - skip
        start, end, left, skip = begin, stop, right, j
    return total + len(left) - skip


def cuts_at_spaces(tok) -> bool:
    """Do the tokens on either side of a stable position not depend on the other side?"""
    from tokenizers.pre_tokenizers import ByteLevel

    pre = tok.pre_tokenizer
    if tok.normalizer is not None or not isinstance(pre, ByteLevel) or pre.add_prefix_space or not pre.use_regex or getattr(tok.model, "dropout", None):
        return False
    return not any(" " in x.content or x.lstrip or x.rstrip or x.single_word for x in tok.get_added_tokens_decoder().values())


def _counts(tok, texts: list[str]) -> Iterator[int]:
    for lo in range(0, len(texts), 4096):
        yield from map(len, tok.encode_batch_fast(texts[lo : lo + 4096], add_special_tokens=False))


def _new(parts: list[list[str]], known: dict[str, int]) -> list[str]:
    return list({p for ps in parts for p in islice(ps, 1, None) if p not in known})


def count_short(tok, texts: list[str], known: dict[str, int] | None) -> list[int]:
    """Tokens of each text.  ``known``: tokens of parts that follow a space, with
    it; None if texts may not be cut."""
    if known is None:
        return list(_counts(tok, texts))
    if len(known) > KNOWN:
        known.clear()
    parts = [STABLE.split(t) for t in texts]
    new = _new(parts, known)
    if 2 * len(new) > sum(map(len, parts)):  # asking for parts costs more than it saves: only a few texts are learnt from
        parts = parts[: len(parts) // 8]
        new = _new(parts, known)
    known.update(zip(new, _counts(tok, [" " + p for p in new]), strict=True))
    first = _counts(tok, [ps[0] for ps in parts])
    out = [n + sum(map(known.__getitem__, islice(ps, 1, None))) for n, ps in zip(first, parts, strict=True)]
    for p in new:
        if len(p) > KEPT:
            del known[p]
    return out + list(_counts(tok, texts[len(parts) :]))


def count_tokens(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row's whole text."""
    kind = docs.schema[id_col].dataType
    src = docs.selectExpr(f"`{id_col}` AS id", f"coalesce(`{text_col}`, '') AS text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load_tokenizer(tokenizer_path)
        known: dict[str, int] | None = {} if cuts_at_spaces(tok) else None
        for batch in batches:
            texts = batch.column("text").to_pylist()
            counts = [0] * len(texts)
            short = [k for k, t in enumerate(texts) if len(t) <= chunk]
            for lo in range(0, len(short), GROUP):
                part = short[lo : lo + GROUP]
                for k, n in zip(part, count_short(tok, [texts[k] for k in part], known), strict=True):
                    counts[k] = n
            for k, t in enumerate(texts):
                if len(t) > chunk:
                    counts[k] = count_long(tok, t, chunk, overlap)
            sizes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())], ["id", "n_bytes", "n_tokens", "over_limit"])

    out = src.mapInArrow(run, f"id {kind.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
