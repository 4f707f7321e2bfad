import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from tidemark.llm.packing import Encoder, best_cuts, pack  # noqa: E402
from tidemark.llm.queries import tokenizer_paths  # noqa: E402
from tidemark.llm.token_counts import count_long, count_short, count_tokens, cuts_at_spaces, load_tokenizer, stable_pieces  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tok():
    return load_tokenizer(PATH)


def ids(tok, text):
    return tok.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("chunk,overlap", [(50, 4), (300, 20), (4096, 64)])
def test_chunks_count_as_the_whole(tok, chunk, overlap):
    mixed = "Hello, wörld don't 12 345!\n\n  x" * 30
    for text in (mixed, mixed + "<|endoftext|> a b" * 40, "a" * 2000, " " * 900 + "x y", "é" * 1500, "a b c " * 300, ""):
        assert count_long(tok, text, chunk, overlap) == len(ids(tok, text))


def test_stable_pieces_join(tok):
    text = "some words, and more.  " * 500 + "z" * 3000
    parts = list(stable_pieces(text, 700))
    assert "".join(parts) == text
    assert sum((ids(tok, p) for p in parts), []) == ids(tok, text)


def test_counts(spark, tok, awkward, empty):
    got = sorted(map(tuple, count_tokens(awkward, PATH).collect()), key=str)
    want = sorted(((r.doc_id, len((r.text or "").encode()), len(ids(tok, r.text)), len(ids(tok, r.text)) > 512) for r in awkward.collect()), key=str)
    assert got == want
    assert count_tokens(empty, PATH).count() == 0


class Asked:
    """A tokenizer that notes how many texts and characters it encodes."""

    def __init__(self, tok):
        self.tok, self.texts, self.chars = tok, 0, 0

    def encode_batch_fast(self, texts, **kwargs):
        self.texts += len(texts)
        self.chars += sum(map(len, texts))
        return self.tok.encode_batch_fast(texts, **kwargs)


def test_known_parts_are_encoded_once(tok):
    rng, asked, known = random.Random(5), Asked(tok), {}
    words = ["alpha", "Straße,", "été.", "don't", "x1!\ny", "z" * 90]
    texts = [" ".join(rng.choices(words, k=400)) for _ in range(8)]
    for t in texts:
        assert count_short(asked, [t], known) == [len(ids(tok, t))]
    assert asked.chars < sum(map(len, texts)) / 20
    assert sorted(known) == sorted(words[:-1])


def test_texts_of_new_parts_are_encoded_at_once(tok):
    asked, known = Asked(tok), {}
    texts = [" ".join(f"w{100 * i + j}" for j in range(100)) for i in range(64)]
    want = [len(ids(tok, t)) for t in texts]
    assert count_short(asked, texts, known) == want
    assert asked.texts <= 64 + 8 * 100 and len(known) == 8 * 99
    for _ in range(30):  # what comes again is learnt, a few texts at a time
        texts, want = texts[8:] + texts[:8], want[8:] + want[:8]
        assert count_short(asked, texts, known) == want
    assert len(known) == 64 * 99


def test_parts_count_as_the_whole(tok, monkeypatch):
    rng = random.Random(6)
    bits = [" "] * 12 + ["a", "B", "é", "'s", "'", "7", "²", "!", "中", "\u0301", "🙂", "\n", "\t", "\r", "\x1c", "\x85", "\xa0", "\u2003", "\u2028", "\u200b", "\ufeff", "\x00", "<|endoftext|>", "<|endof"]
    texts = ["", " ", "  ", " a", "a ", "a b", *("".join(rng.choices(bits, k=rng.randint(1, 40))) for _ in range(20_000))]
    want = [len(ids(tok, t)) for t in texts]
    for cap in (1 << 19, 50):
        monkeypatch.setattr("tidemark.llm.token_counts.KNOWN", cap)
        known, got = {}, []
        for lo in range(0, len(texts), 64):
            got += count_short(tok, texts[lo : lo + 64], known)
        assert got == want


def test_other_tokenizers_are_not_cut(spark, tok, tmp_path):
    from tokenizers import AddedToken, normalizers, pre_tokenizers

    assert cuts_at_spaces(tok)
    others = [load_tokenizer(PATH) for _ in range(4)]
    others[0].pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
    others[1].pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    others[2].normalizer = normalizers.Strip()
    others[3].add_tokens([AddedToken("the end", normalized=False)])
    texts = ["the end of the end", " a b  c ", "x the end", ""]
    for i, other in enumerate(others):
        assert not cuts_at_spaces(other)
        other.save(path := str(tmp_path / f"{i}.json"))
        rows = count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), path).collect()
        assert {r.doc_id: r.n_tokens for r in rows} == {k: len(ids(other, t)) for k, t in enumerate(texts)}


def test_encoders_agree(tok):
    enc = Encoder(**{k.replace("tokenizer_path", "path"): v for k, v in tokenizer_paths().items()})
    for text in ("a<|endoftext|>b", "", "Zürich, it's 5 o'clock\n\n  yes", "x" * 5000):
        assert enc.ids(text).tolist() == ids(tok, text)


def padding(length, size):
    return 0 if length & (length - 1) == 0 else size - length


@pytest.mark.parametrize("tail", [True, False])
def test_cuts_are_optimal(tail):
    rng = np.random.default_rng(0)
    for _ in range(600):
        n, size = int(rng.integers(2, 14)), int(rng.choice([16, 12, 32]))
        pos = np.concatenate([[0], np.cumsum(rng.integers(1, 9, n))]).tolist()
        cost = [0, *rng.integers(0, 9, n - 1).tolist(), 0]
        last = len(pos) - 1
        best = {0: 0}
        for i in range(1, len(pos)):
            charge = lambda j, i=i: 0 if i == last and not tail else padding(pos[i] - pos[j], size)
            best[i] = min(best[j] + charge(j) for j in range(i) if pos[i] - pos[j] <= size) + cost[i]
        total, at = 0, 0
        for c in best_cuts(pos, cost, size, tail):
            assert 0 < pos[c] - pos[at] <= size
            total += (0 if c == last and not tail else padding(pos[c] - pos[at], size)) + cost[c]
            at = c
        assert at == last and total == best[last]


def test_inner_windows_of_a_power_of_two_need_no_padding():
    pos = np.concatenate([[0], np.cumsum([1030, 700, 1024, 1030, 1010])]).tolist()
    cuts = best_cuts(pos, [0] * 6, 2048, True)
    assert sum(padding(b - a, 2048) for a, b in zip([0, *(pos[c] for c in cuts)], (pos[c] for c in cuts), strict=False)) == 326


@pytest.mark.parametrize("block", [4096, 1 << 16])
def test_packing_is_lossless(spark, tok, awkward, empty, block):
    rows = pack(awkward, block=block, **tokenizer_paths()).collect()
    want = sorted(ids(tok, r.text) + [1] for r in awkward.collect())
    seqs, docs = {}, {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append(r)
        docs.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for parts in seqs.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    total = sum(r.length for r in rows)
    assert total == sum(map(len, want))
    assert sum(padding(sum(r.length for r in parts), 2048) for parts in seqs.values()) < 0.1 * total
    crc = {}
    for doc in awkward.collect():
        crc.setdefault(doc.doc_id, []).append(ids(tok, doc.text) + [1])
    for r in rows:
        assert any(zlib.crc32(np.array(d[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for d in crc[r.doc_id] if len(d) == r.doc_tokens)
    assert pack(empty, **tokenizer_paths()).count() == 0
