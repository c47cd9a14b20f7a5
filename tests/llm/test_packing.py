import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fusewright.llm import packing

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, length bigint, start string"


def brute_force(ends, penalties, window):
    """The least cost, by trying every start of each window."""
    points, cost = [0, *ends], [0]
    for j in range(1, len(points)):
        options = []
        for i in range(j):
            n = points[j] - points[i]
            if n <= window:
                options.append(cost[i] + (0 if n & (n - 1) == 0 else window - n))
        cost.append(min(options) + penalties[j - 1])
    return cost[-1]


@pytest.mark.parametrize("seed", range(20))
def test_plan_is_optimal(seed):
    rng = np.random.default_rng(seed)
    ends = np.cumsum(rng.integers(1, 16, 60)).tolist()
    penalties = rng.integers(0, 9, 60).tolist()
    cuts = packing.plan(np.array(ends), np.array(penalties), 32)
    assert cuts[-1] == ends[-1] and set(cuts) <= set(ends)
    total, before = 0, 0
    for c in cuts:
        n = c - before
        assert 0 < n <= 32
        total += (0 if n & (n - 1) == 0 else 32 - n) + penalties[ends.index(c)]
        before = c
    assert total == brute_force(ends, penalties, 32)


def test_pieces_hold_every_id_once(spark):
    texts = ["Hello there. How are you? " * 300, None, "", "   \n ", "one", "ÀÉ naïve\u2003spaces\x1cand <|endoftext|> 3.14!", "word " * 5000, "one"]
    docs = spark.createDataFrame([(i if i else None, t, "en", "s", 0, 7, "x") for i, t in enumerate(texts)], SCHEMA)
    rows = packing.pack(docs.coalesce(1)).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[i if i else None], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding < 0.02 * sum(r.length for r in rows)


def test_ids_are_the_tokenizers():
    rng = np.random.default_rng(3)
    signs = list("abcdeABCDÉéñßœĿ0123456789.,!?'\"-_*@#<|>()") + ["'s", "'LL", "\u0301", "ı", "中", "😀", "\x07", " ", " ", " ", "\n", "\t", "\r\n", "\x0b", "\u2003", "<|endoftext|>", "\x00", "\x1d"]
    tokenizer, encoder = Tokenizer.from_file(packing.default_vocabulary()), packing.WordEncoder(packing.default_vocabulary())
    for k in range(4000):
        text = "".join(rng.choice(signs, rng.integers(0, 40), p=None))
        ids, ends = encoder.encode(text)
        assert ids.tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1], repr(text)
        assert ends[-1] == len(ids) and (np.diff(ends) > 0).all() and ends[0] > 0
        if k == 2000:
            encoder.forget()


def test_cuts_lie_at_sentence_ends():
    """Only a sentence longer than a window is cut inside."""
    rng = np.random.default_rng(4)
    docs = []
    for i in range(60):
        sizes = rng.choice([3, 17, 60, 300, 900, 2048], rng.integers(1, 9))
        if i == 30:
            sizes = np.append(sizes, 7000)
        ends = np.cumsum(sizes)
        docs.append((i, rng.integers(0, 9, ends[-1]).astype("<u4"), ends))
    rows, n = packing.pack_block(docs, 5)
    assert {r[5] for r in rows} == set(range(5, n))
    for doc_id, start, length, *_ in rows:
        ends, end = docs[doc_id][2], start + length
        inside = np.flatnonzero((ends > end) & (np.concatenate([[0], ends[:-1]]) < end))
        assert all(np.diff(np.concatenate([[0], ends]))[k] > packing.WINDOW for k in inside)
    ids, ends = packing.WordEncoder(packing.default_vocabulary()).encode("One two. Three\n\nfour! five")
    assert len(ends) == 4


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_another_vocabulary(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = ["Hello there. How are you? " * 400, None, "", " \n ", "It's 3.14!\n\nNew line. é", "word " * 5000]
    rows = packing.pack(spark.createDataFrame([(i, t, "en", "s", 0, 7, "x") for i, t in enumerate(texts)], SCHEMA), path, end=50256).collect()
    for i, t in enumerate(texts):
        ids, at = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 50256], "<u4"), 0
        for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert packing.splits_as_assumed(public_tokenizers.path("word_bpe_49k.json")) and not packing.splits_as_assumed(path)
