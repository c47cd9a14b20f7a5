"""Toxicity: boosted trees over dense features of a text, with isotonic calibration.

The lexicon is learnt from the labelled rows: words that label 1 has far more often than label 0.
Densities of its words and of words of second person, their closeness, and the rates of capitals,
punctuation and obfuscation are the features.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting
from .common import held_out, numbered, slices, tenant, unused

#: At most this many labelled rows are learnt from (by the least digests of their ids), none of them longer than so many characters.
SAMPLE, SAMPLE_CHARS = 12_000, 200_000
#: Characters of the sampled texts that come to the driver, at most.
SAMPLE_ALL = 48 << 20
LEXICON = 400
#: Words of second person in the four languages, and letters that digits and signs stand for.
SECOND = frozenset("you your yours yourself du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos usted tú ti tuyo vosotros".split())
LEET = str.maketrans("013457@$!", "oieastasi")
EDGES = ".,;:!?\"'()[]{}<>|*#$%&-_/\\…“”„«»¿¡"
_OBFUSCATED = re.compile(r"[^\W\d_]+[*@$!013457]+[^\W\d_]|(.)\1{3}")
_PUNCT = re.compile(r"[^\w\s]")
NEAR, SPELLED = 5, 4
#: Different strings between white space that a worker remembers.
REMEMBERED = 150_000

FEATURES = (
    "log_words", "hits", "hit_density", "distinct_hits", "log_odds_sum", "log_odds_max", "log_odds_mean", "strong_hits", "strong_density",
    "leet_hits", "second_density", "second_near", "capital_rate", "shouted_rate", "punctuation_rate", "mark_rate", "obfuscation_rate", "hits_first_third",
)


def core(chunk: str) -> str:
    """A string between white space, in lower case, without the punctuation at its ends."""
    return chunk.lower().strip(EDGES)


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: boosting.Boosted
    strong: float = 2.0

    def __post_init__(self) -> None:
        self._rows, self._ids = np.zeros((1 << 12, 11)), {}

    def __getstate__(self) -> dict:
        return {"lexicon": self.lexicon, "trees": self.trees, "strong": self.strong}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def describe(self, chunk: str) -> list[float]:
        """What one string adds to the sums: hit, log odds, strong, leet, second person, capitals, shouted, punctuation, marks, obfuscated, single letter."""
        word = core(chunk)
        odds = self.lexicon.get(word)
        leet = 0
        if odds is None and word and not word.isalpha():
            odds = self.lexicon.get(_PUNCT.sub("", word.translate(LEET)))
            leet = odds is not None
        upper = sum("A" <= c <= "Z" for c in chunk)
        return [
            odds is not None, odds or 0.0, (odds or 0.0) >= self.strong, leet, word in SECOND, upper, len(word) > 1 and chunk.isupper(),
            len(_PUNCT.findall(chunk)), max(0, chunk.count("!") + chunk.count("?") - 1), _OBFUSCATED.search(chunk) is not None, len(word) == 1 and word.isalpha(),
        ]

    def _learn(self, chunks: set[str]) -> None:
        new = [c for c in chunks if c not in self._ids]
        if new and len(self._ids) + len(new) > REMEMBERED:
            self._ids, new = {}, list(chunks)
        at = len(self._ids)
        if at + len(new) > len(self._rows):
            self._rows = np.concatenate([self._rows[:at], np.zeros((max(at, len(new)) * 2, self._rows.shape[1]))])
        for i, c in enumerate(new, at):
            self._ids[c] = i
            self._rows[i] = self.describe(c)

    def features(self, text: str) -> list[float]:
        chunks = text.split()
        if not chunks:
            return [0.0] * len(FEATURES)
        self._learn(set(chunks))
        ids = np.fromiter(map(self._ids.__getitem__, chunks), np.int64, len(chunks))
        rows = self._rows[ids]
        hits, odds_sum, strong, leet, second, upper, shouted, punct, marks, obfuscated, _ = rows.sum(0).tolist()
        n, chars = len(chunks), len(text)
        near = first = top = distinct = 0
        if hits:
            p = np.flatnonzero(rows[:, 0])
            distinct, top, first = len(np.unique(ids[p])), float(rows[p, 1].max()), int((p < n / 3).sum())
            if second:
                s = np.flatnonzero(rows[:, 4])
                at = np.searchsorted(s, p)
                near = int(((np.abs(s[np.minimum(at, len(s) - 1)] - p) <= NEAR) | (np.abs(s[np.maximum(at - 1, 0)] - p) <= NEAR)).sum())
        single = rows[:, 10]
        if single.sum() >= SPELLED:  # words spelled letter by letter
            run = np.diff(np.flatnonzero(np.concatenate([[True], single == 0, [True]]))) - 1
            obfuscated += int((run >= SPELLED).sum())
        return [
            np.log1p(n), hits, hits / n, distinct, odds_sum, top, odds_sum / max(1, hits), strong, strong / n,
            leet, second / n, near / n, upper / chars, shouted / n, punct / chars, marks / n, obfuscated / n, first / n,
        ]

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        return self.trees.probability(np.array([self.features(t) for t in texts], float))


def lexicon_of(texts: list[str], labels: list[int], size: int = LEXICON) -> dict[str, float]:
    """Log odds ratios, by documents that have the word, of the words most typical of label 1."""
    counts = Counter(), Counter()
    for t, y in zip(texts, labels):
        counts[y].update({core(c) for c in set(t.split())} - {""})
    n = [max(1, sum(y == k for y in labels)) for k in (0, 1)]
    out = {}
    for w, c in counts[1].items():
        if c >= 3:
            p, q = (c + 0.5) / (n[1] + 1), (counts[0][w] + 0.5) / (n[0] + 1)
            z = (c / n[1] - counts[0][w] / n[0]) / np.sqrt(max(1e-12, (c + counts[0][w]) / (n[0] + n[1]) * (1 / n[0] + 1 / n[1])))
            if z > 3:
                out[w] = (z, float(np.log(p / (1 - p)) - np.log(q / (1 - q))))
    best = sorted(out.items(), key=lambda x: (-x[1][0], x[0]))[:size]
    return {w: o for w, (_, o) in best}


def fit(texts: list[str], labels: list[int]) -> Model:
    """Learns the lexicon on one half of the rows and the trees on the other, so that the trees meet the lexicon as new texts do."""
    half = len(texts) // 2
    lexicon = lexicon_of(texts[:half], labels[:half])
    model = Model(lexicon, boosting.fit(np.zeros((0, len(FEATURES))), np.zeros(0)))
    x = np.array([model.features(t) for t in texts[half:]], float).reshape(-1, len(FEATURES))
    model.trees = boosting.fit(x, np.array(labels[half:]), trees=60, depth=3, rate=0.15, ridge=4.0, least=3.0)
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, longest: int = SAMPLE_CHARS, total: int = SAMPLE_ALL) -> Model:
    """A model of a bounded sample of the labelled documents, none of them held out.

    The sample: labelled documents with a text of at most longest characters, in the order of
    md5(doc_id), the first `sample` of them; of these, rows with which the sum would exceed total
    characters are left out. It bounds what is learnt from only; all rows are scored, whole. Labels
    without such a document, null texts and longer ones take no place. Columns of any names may stand by.
    """
    key = F.md5(F.col("doc_id").cast("string").cast("binary"))
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    usable = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= longest))
    ids = known.join(usable.select("doc_id"), "doc_id", "left_semi").orderBy(key, "doc_id").limit(sample)
    rows = usable.join(F.broadcast(ids), "doc_id")  # at most sample rows
    rows = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    texts, ys, held = [], [], 0
    for r in rows.select(key.alias("key"), "label", "text").orderBy("key").toLocalIterator():
        if held + len(r.text) <= total:
            held += len(r.text)
            texts.append(r.text)
            ys.append(r.label)
    return fit(texts, ys)


SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int"


def score_column(docs: DataFrame, model: Model, keep: str | bool | None = None) -> DataFrame:
    """keep: the columns of docs and the score under this name (True: toxic_score, made longer if docs has it); else doc_id, held_out, score, predicted.

    Null and empty texts are scored like any text without words; very long ones are scored whole. Null doc_id: held_out as for an
    empty id. Repeated rows and equal texts get equal scores. Empty table: empty result.
    """
    keep = unused(docs, "toxic_score") if keep is True else keep
    sent = docs.sparkSession.sparkContext.broadcast(model)
    src = docs if keep else docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    at, names = src.columns.index("text"), [*src.columns, keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tenant(f"toxicity {id(sent.value)}", sent.value.__post_init__)
        for b in slices(batches, at):
            s = sent.value.score([t or "" for t in b.column(at).to_pylist()])
            if keep:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], names=names)
            else:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    from pyspark.sql import types as T

    schema = T.StructType([*src.schema.fields, T.StructField(keep, T.DoubleType())]) if keep else SCHEMA
    return (numbered(src) if keep else src).mapInArrow(run, schema)
