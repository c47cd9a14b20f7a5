import random
from itertools import combinations

import numpy as np
import pytest

from fusewright.llm import components, ngram_join

SCHEMA = "doc_id bigint, text string, ent bigint, n bigint, component_id string"


def brute_force(rows):
    """(doc_id, n, component) by comparing all pairs of shingle sets."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    prose = lambda n: [rng.choice(words) for _ in range(n)]

    def near(text, share):
        return [w if rng.random() > share else rng.choice(words) for w in text]

    texts = [prose(rng.choice([1, 3, 4, 5, 6, 9, 20, 60, 200, 500])) for _ in range(150)]
    base = prose(120)
    texts += [near(base, rng.choice([0.005, 0.02, 0.03])) for _ in range(70)]  # a group of more than HOT near copies
    passage = prose(60)
    texts += [prose(rng.choice([5, 20, 80, 300])) + passage + prose(rng.choice([0, 2, 5, 40])) for _ in range(80)]
    for _ in range(25):
        t = prose(rng.choice([30, 100, 400]))
        texts += [near(t, rng.choice([0.01, 0.02, 0.04])) for _ in range(rng.choice([1, 2, 5]))] + [t]
    texts += [["a", "b", "c", "d"]] * 3 + [["A", "b", "C", "d"], ["x"], ["x"], []]
    texts = [" ".join(t) if rng.random() < 0.5 else "\n ".join(t).title() if rng.random() < 0.3 else "\t".join(t) for t in texts]
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return [(i * 3 % 1009, t) for i, t in rows] + [(2000, None), (2001, ""), (2002, " \n"), rows[0], rows[0], (None, texts[0]), (None, "nobody else has this text")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_all_pairs(spark, seed, monkeypatch):
    if seed > 1:  # many small tiles, a join in place of the filter, one partner a member at first
        for k, v in {"TILE_ROWS": 8, "TILE_BYTES": 4096, "FILTER_MOST": 1, "LIMITS": (1, 2, None), "HOT": 12, "CENTRES": 1}.items():
            monkeypatch.setattr(ngram_join, k, v)
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, 1, 2, "x") for d, t in rows], SCHEMA).repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_join(df).collect()), key=str)
    assert got == brute_force(rows)


def test_near_copies_of_one_another(spark):
    """3,000 texts whose pairs are mostly no links: each changes some words of one text that isn't there itself."""
    rng = random.Random(7)
    base = [f"w{rng.randrange(5000)}" for _ in range(140)]
    rows = []
    for i in range(3000):
        t = list(base)
        for _ in range(rng.choice([1, 2, 3, 4])):
            t[rng.randrange(140)] = f"x{rng.randrange(5000)}"
        rows.append((i, " ".join(t)))
    df = spark.createDataFrame([(d, t, 1, 2, "x") for d, t in rows], SCHEMA).repartition(3)
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_join(df).collect()}
    sets = [ngram_join.shingles(t.encode()) for _, t in rows]
    every = np.unique(np.concatenate(sets))
    m = np.zeros((3000, len(every)), np.float32)
    for i, s in enumerate(sets):
        m[i, np.searchsorted(every, s)] = 1
    inter, n = m @ m.T, m.sum(1)
    link = 100 * inter >= 80 * (n[:, None] + n[None, :] - inter)
    root, todo = np.full(3000, -1), []
    for i in range(3000):
        if root[i] < 0:
            todo = [i]
            root[i] = i
            while todo:
                near = np.flatnonzero(link[todo.pop()] & (root < 0))
                root[near] = i
                todo += near.tolist()
    assert [got[i] for i in range(3000)] == root.tolist()


def test_columns_of_helpers_names_and_a_long_text(spark):
    text = " ".join(f"w{i * i % 7919}" for i in range(60_000))
    rows = [(5, text, 1, 1, b"", 1, 1), (3, text + " end", 1, 1, b"", 1, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, node bigint, n bigint, bits binary, key bigint, component_id bigint")
    assert sorted((r.doc_id, r.component_id) for r in ngram_join.ngram_join(df).collect()) == [(3, 3), (5, 3)]


def test_pairs_whose_sizes_leave_no_room_are_never_dealt(spark, monkeypatch):
    """Texts of very different lengths share a passage: their pairs and rows of tiles are dropped before bitmaps are joined to them."""
    rng = random.Random(4)
    prose = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    passage = prose(60)
    rows = [(i, " ".join(prose(40 * 2 ** (i % 6)) + passage)) for i in range(18)] + [(30 + i, " ".join(passage[: 60 - i])) for i in range(4)]
    asked, verified = [], ngram_join.NgramJoin.verified

    def watched(self, pairs, name):
        sizes = dict(self.ents.select("node", "n").collect())
        asked.extend((sizes[r.a], sizes[r.b]) for r in pairs.collect())
        return verified(self, pairs, name)

    monkeypatch.setattr(ngram_join.NgramJoin, "verified", watched)
    df = spark.createDataFrame([(d, t, 1, 2, "x") for d, t in rows], SCHEMA)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_join(df).collect()), key=str)
    assert got == brute_force(rows)
    assert asked and all(100 * min(p) >= 80 * max(p) for p in asked)


def test_runs_of_like_sizes(spark):
    m = [("g", i, i, n, True) for i, n in enumerate([100, 125, 156, 10, 13, 1000, 1251, 7, 7])] + [("h", 20, 1, 50, True), ("h", 21, 1, 50, True), ("h", 22, 2, 500, True), ("i", 30, 3, 9, False), ("i", 31, 4, 9, False)]
    j = ngram_join.NgramJoin(spark.createDataFrame([], SCHEMA))
    got = {}
    for r in j.alike(spark.createDataFrame(m, "gid string, node bigint, root bigint, n bigint, minor boolean")).collect():
        got.setdefault((r.gid, r.run), set()).add(r.node)
    assert sorted(map(sorted, got.values())) == [[0, 1, 2], [7, 8]]


@pytest.mark.parametrize("n", [1, 2, 31, 32, 33, 1000, 1 << 17, 1 << 19, 1 << 20])
def test_bytes_of_bitmaps(spark, n):
    got = spark.range(1).selectExpr(f"{n}L as n").selectExpr(ngram_join.BITMAP_BYTES).first()[0]
    assert got == len(ngram_join.bitmap(np.arange(n, dtype=np.uint64)))


def test_empty_table(spark):
    assert ngram_join.ngram_join(spark.createDataFrame([], SCHEMA)).count() == 0


def test_bit_counts_never_lose_a_link():
    rng = np.random.default_rng(0)
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**64, rng.integers(1, 400), np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.1], rng.integers(0, 2**64, rng.integers(0, 60), np.uint64)]))
        if len(b) and ngram_join.linked(a, b):
            assert ngram_join.may_link(len(a), ngram_join.bitmap(a), len(b), ngram_join.bitmap(b))
    x, y = (np.unique(rng.integers(0, 2**64, 500, np.uint64)) for _ in range(2))
    assert not ngram_join.may_link(len(x), ngram_join.bitmap(x), len(y), ngram_join.bitmap(y))


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 90), (95, 100), (7, 7), (200, 201), (201, 200)]
    got = dict(components.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect())
    assert got == {i: 0 for i in range(61)} | {90: 90, 95: 90, 100: 90, 200: 200, 201: 200}
