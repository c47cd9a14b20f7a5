import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from fusewright.llm import common, conv_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string"


def brute(rows):
    turns = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    built = {}
    for c in turns:
        turns[c].sort()
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        base = (abs(c) - abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = [t[2:] for t in turns.get(base, [])[:h]] + [t[2:] for t in turns[c][h:]]
    nodes = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            nodes[tuple(seq[:d])].append(c)
    children = defaultdict(list)
    for key in nodes:
        if key:
            children[key[:-1]].append(key)
    out = []
    done = {}
    for key, members in sorted(nodes.items(), key=lambda x: -len(x[0])):
        leaves, saved = 0, (len(members) - 1) * len(key[-1][1].split()) if key else 0
        for k in children[key]:
            leaves += done[k][0]
            saved += done[k][1]
        done[key] = (leaves or 1, saved)
        ends = ",".join(map(str, sorted(c for c in members if len(built[c]) == len(key))))
        up = min(nodes[key[:-1]]) if key else None
        out.append((min(members), len(key), up, len(members), len(children[key]), leaves or 1, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-60, 400), 150):
        rows += [(c, t, rng.choice(["user", "bot", None]), rng.choice(["a", "b c", "d e f", "", None]), "x") for t in range(rng.randrange(1, 7))]
    rows += [(1000 + i, t, "user", f"same words {t}", "x") for i in range(60) for t in range(5)]  # a hot prefix, many ends at one node
    rows += [(2000, t, "bot", f"long {t}", "x") for t in range(300)]  # one long conversation
    rows += [(None, 1, "user", "nobody's", "x"), (3000, None, "user", "first", "x"), (3000, 0, None, None, "x"), (3001, 0, "user", "z" * 100_000 + " y", "x")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("most", "hot"), [(100_000, common.HOT), (40, common.HOT), (40, 4), (0, 7)])
def test_same_as_brute(spark, monkeypatch, most, hot):
    monkeypatch.setattr(common, "HOT", hot)
    rows = conversations(most + hot)
    got = conv_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), most_rows=most)
    assert got.columns == "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute(rows)))


def test_empty_ties_repeats(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert conv_trie.prefix_trie(df).count() == 0
    rows = [(3, 1, "user", "a b", ""), (3, 1, "user", "a b", ""), (3, 1, "user", "c", ""), (3, None, "x", "y", "")]
    one = conv_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()
    two = conv_trie.prefix_trie(spark.createDataFrame(rows[::-1], SCHEMA)).collect()
    assert sorted(map(repr, one)) == sorted(map(repr, two))
    h = zlib.crc32(b"3") % 4
    assert sorted(r.depth for r in one) == list(range(4 - h + 1))


def test_louds():
    parents = np.array([0, 0, 1, 1, 1, 3])
    bits = conv_trie.louds(parents)
    assert bits.astype(int).tolist() == [1, 1, 0, 1, 1, 1, 0, 0, 1, 0, 0, 0, 0]
    assert conv_trie.parents_of(bits).tolist() == parents.tolist()
    assert conv_trie.louds(np.array([], int)).tolist() == [False]
