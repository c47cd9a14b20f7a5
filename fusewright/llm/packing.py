"""Packing documents into token sequences by order-preserving dynamic programming.

Documents stay in the order of their partition and form one stream of tokens. Windows of at most
2048 tokens cover the stream; they end after a document, after a sentence of one, or, in a sentence
longer than a window, within it. A window costs its padding, and its end costs a truncation penalty
unless a document ends there. The cheapest cuts come from dynamic programming: a monotone queue
holds the best starts of windows that are padded, and the starts of windows whose length is a
power of two, which need no padding, are looked up. The stream is planned a block of documents at
a time, so that memory doesn't grow with the partition.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from array import array
from collections import deque
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import slices, tenant

WINDOW, END = 2048, 1
#: What a cut costs, in tokens of padding: after a sentence, and within one.
SENTENCE_CUT, HARD_CUT = 8, 64
#: Within a sentence longer than a window, a window may end every so many tokens.
GRID = 64
#: A block is planned once it has this many tokens.
BLOCK = 1 << 20
#: Words whose tokens a worker remembers.
REMEMBERED = 900_000

SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
#: White space that str.split() and the tokenizer don't treat alike, or that isn't ASCII; and what stands for a line's end.
_ODD_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_LINE = "\x00"
#: Words that are split here, and the vocabulary's pattern over them, in lower case.
_LATIN = re.compile(r"[!-~\xa1\xab\xbb\xbf\xc0-\u0148\u014a-\u017f]+")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|[\W_]+")
#: The vocabulary's signs for bytes: printable ones of Latin-1 stand for themselves, the others follow from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SIGNS = dict(zip(_PLAIN, map(chr, _PLAIN))) | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_PLAIN)))}
#: The normaliser, pre-tokenizer and word end for which words are split here; texts go whole through vocabularies with others.
_ASSUMED = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: One for each worker and vocabulary.
_encoders: dict[str, "WordEncoder"] = {}


def splits_as_assumed(path: str) -> bool:
    """Whether a vocabulary file normalises and splits as words are here."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    return all(told.get(k) == v for k, v in _ASSUMED.items()) and told["model"].get("end_of_word_suffix") == "</w>" and all("<|" in x["content"] for x in told["added_tokens"])


class WordEncoder(dict):
    """Ids of texts, by words: the vocabulary's own splitting never crosses white space, so a word's ids hold anywhere.

    The dictionary numbers the words met so far; their ids stand one after another in flat. Words of
    Latin letters, digits and signs are normalised and split here as the vocabulary says (NFC, lower
    case, its pattern), and their parts go through its merges. All other words go through the
    vocabulary whole. A full memory is emptied between texts.
    """

    def __init__(self, path: str, by_words: bool = True):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model.tokenize
        self.by_words = by_words
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.flat, self.begin, self.count, self.stops = array("I"), array("q"), array("q"), array("b")
        self.keep(_LINE, ())

    @staticmethod
    def of(path: str, by_words: bool = True) -> WordEncoder:
        if path not in _encoders:
            _encoders[path] = WordEncoder(path, by_words)
        return _encoders[path]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def keep(self, word: str, ids: Iterable[int]) -> int:
        i, at = len(self.begin), len(self.flat)
        self.flat.extend(ids)
        self.begin.append(at)
        self.count.append(len(self.flat) - at)
        self.stops.append(word[-1] in ".!?" or word == _LINE)
        self[word] = i
        return i

    def again(self, part: str) -> list[int]:
        """The ids of letters in lower case or of one sign, from memory if met as a word."""
        i = self.get(part)
        return [t.id for t in self.merges(part)] if i is None else self.flat[self.begin[i] : self.begin[i] + self.count[i]].tolist()

    def parts(self, word: str) -> list[int]:
        if word.isascii():
            word = word.lower()
            if word.isalpha():
                return self.again(word)
            if word[-1] in ".,;:!?" and word[:-1].isalpha():
                return self.again(word[:-1]) + self.again(word[-1])
            return [t.id for p in _PARTS.findall(word) for t in self.merges(p)]
        found = _PARTS.findall(unicodedata.normalize("NFC", word).lower())
        return [t.id for p in found for t in self.merges("".join(map(_SIGNS.__getitem__, p.encode())))]

    def __missing__(self, word: str) -> int:
        return self.keep(word, self.parts(word) if _LATIN.fullmatch(word) and "<|" not in word else self.whole(word).tolist())

    def encode_whole(self, text: str, end: int) -> tuple[np.ndarray, np.ndarray]:
        """encode() by the vocabulary alone: a sentence ends with the token that ends with its sign, or with a line."""
        e = self.tokenizer.encode(text, add_special_tokens=False)
        ids = np.array([*e.ids, end], "<u4")
        stops = [i + 1 for i, (a, b) in enumerate(e.offsets) if b > a and (text[b - 1] == "\n" or (text[b - 1] in ".!?" and text[b : b + 1].isspace()))]
        return ids, np.array([*(x for x in dict.fromkeys(stops) if x < len(e.ids)), len(ids)])

    def encode(self, text: str, end: int = END) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a text with the end id, and the places where its sentences end, the last one where the text ends."""
        if not self.by_words:
            return self.encode_whole(text, end)
        if _LINE in text or (any(x in text for x in "\x1c\x1d\x1e\x1f") if text.isascii() else _ODD_SPACE.search(text)):
            ids = np.append(self.whole(text), np.uint32(end)).astype("<u4")
            return ids, np.array([len(ids)])
        if len(self) > REMEMBERED:
            self.forget()
        words = (text.replace("\n", f" {_LINE} ") if "\n" in text else text).split()
        w = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        flat, begin, count, stops = np.frombuffer(self.flat or b"\0\0\0\0", "<u4"), np.frombuffer(self.begin, np.int64), np.frombuffer(self.count, np.int64), np.frombuffer(self.stops, np.bool_)
        n = count[w]
        after = np.cumsum(n)
        total = int(after[-1]) if len(w) else 0
        ids = np.empty(total + 1, "<u4")
        ids[:total] = flat[np.repeat(begin[w] - (after - n), n) + np.arange(total)]
        ids[total] = end
        ends = after[stops[w]]
        return ids, np.append(np.unique(ends[(ends > 0) & (ends < total)]), total + 1)


def plan(ends: np.ndarray, penalties: np.ndarray, window: int = WINDOW) -> list[int]:
    """The ends of the cheapest windows. ends: allowed ends, rising, the last is the stream's; none is over window after its predecessor.

    Padding of a window of n tokens is window - n, but none if n is a power of two.
    """
    if not len(ends):
        return []
    points = np.concatenate([[0], ends])
    where = np.full(int(points[-1]) + 1, -1, np.int32)
    where[points] = np.arange(len(points))
    exact: dict[int, list[int]] = {}  # of a point: those a power of two before it
    for k in range(window.bit_length()):
        back = points - (1 << k)
        found = np.flatnonzero(back >= 0)
        i = where[back[found]]
        for j, x in zip(found[i >= 0].tolist(), i[i >= 0].tolist()):
            exact.setdefault(j, []).append(x)
    cost, came = [0] * len(points), [0] * len(points)
    queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])  # (cost + position, position, index), costs rising
    for j, (p, penalty) in enumerate(zip(ends.tolist(), penalties.tolist()), 1):
        while p - queue[0][1] > window:
            queue.popleft()
        key, _, i = queue[0]
        best = key + window - p
        for k in exact.get(j, ()):
            if cost[k] < best:
                best, i = cost[k], k
        best += penalty
        cost[j], came[j] = best, i
        key = best + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, p, j))
    out, j = [], len(points) - 1
    while j:
        out.append(int(points[j]))
        j = came[j]
    return out[::-1]


def cut_points(docs: list[np.ndarray], window: int = WINDOW, grid: int = GRID) -> tuple[np.ndarray, np.ndarray]:
    """Allowed ends in the stream and their penalties, from the places in each document where its sentences end."""
    base = np.cumsum([0, *(int(d[-1]) for d in docs)])
    ends = np.concatenate([d + b for d, b in zip(docs, base)])
    penalties = np.full(len(ends), SENTENCE_CUT)
    penalties[np.cumsum([len(d) for d in docs]) - 1] = 0
    before = np.concatenate([[0], ends[:-1]])
    inner = [np.arange(before[i] + grid, ends[i], grid) for i in np.flatnonzero(ends - before > window).tolist()]
    if inner:
        more = np.concatenate(inner)
        ends, penalties = np.concatenate([ends, more]), np.concatenate([penalties, np.full(len(more), HARD_CUT)])
        order = np.argsort(ends, kind="stable")
        ends, penalties = ends[order], penalties[order]
    return ends, penalties


def pack_block(docs: list[tuple[int | None, np.ndarray, np.ndarray]], first_id: int, window: int = WINDOW) -> tuple[list[tuple], int]:
    """Rows of SCHEMA for one block, and the next sequence's id. Each document: its id, its ids and its sentences' ends."""
    cuts = plan(*cut_points([ends for _, _, ends in docs], window), window)
    rows, at, c, begun = [], 0, 0, 0  # begun: where the open window began
    for doc_id, ids, _ in docs:
        total, start = len(ids), 0
        while start < total:
            n = min(total - start, cuts[c] - at)
            rows.append((doc_id, start, n, zlib.crc32(ids[start : start + n]), total, first_id + c, at - begun))
            start, at = start + n, at + n
            if at == cuts[c]:
                c, begun = c + 1, at
    return rows, first_id + len(cuts)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)


def _packer(path: str, window: int, end: int, by_words: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(path, by_words)
        tenant(f"packing {path}", encoder.forget)
        next_id, docs, held = TaskContext.get().partitionId() << 40, [], 0
        for b in slices(batches, 1):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                docs.append((doc_id, *encoder.encode(text or "", end)))
                held += len(docs[-1][1])
                if held >= BLOCK:
                    rows, next_id = pack_block(docs, next_id, window)
                    docs, held = [], 0
                    yield _batch(rows)
        if docs:
            yield _batch(pack_block(docs, next_id, window)[0])

    return run


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, end: int = END) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Ids of a whole document, very long ones too, then the end id, each in exactly one piece; a
    sequence's pieces lie without gaps from offset 0. Sequences are numbered within their partition of the input, so
    there is no shuffle and no global counter. Null and blank text: the end id alone. Null doc_id
    stays null; repeated rows are packed each. Of plans that cost the same the one whose windows begin first is taken.
    Empty table: empty result. Other columns are ignored, whatever their names. Any vocabulary file of tokenizers gives
    its own ids; only those that split as _ASSUMED says are remembered by words.
    """
    path = vocabulary or default_vocabulary()
    return docs.select("doc_id", "text").mapInArrow(_packer(path, window, end, splits_as_assumed(path)), SCHEMA)
