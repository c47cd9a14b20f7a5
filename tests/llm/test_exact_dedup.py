import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fusewright.llm import common, exact_dedup

LONG = "y" * 200_000


def rows_of():
    rng = random.Random(3)
    texts = [None, "", "", "a", "b", "A", "é", "é", " a", LONG, LONG, LONG[:-1] + "z", "x" * 300 + "1", "x" * 300 + "2", "x" * 300 + "1"]
    texts += ["".join(rng.choice("ab") for _ in range(rng.randrange(6))) for _ in range(200)]
    texts += ["the hot text"] * 150
    rows = [(i, t, "p", 1) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


def check(rows, got):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    assert len(got) == len(rows)
    kept = defaultdict(int)
    for r in got:
        ids = groups[r["_0"]]
        assert r["group_size"] == len(ids)
        most = max(ids, key=lambda i: (i is not None, i or 0))
        assert r["keep_id"] == most
        assert not r["kept"] or r["doc_id"] == most
        kept[r["_0"]] += r["kept"]
    assert set(kept) == set(groups) and set(kept.values()) <= {1}


@pytest.mark.parametrize("bits", [1 << 27, 64])
@pytest.mark.parametrize("hot", [common.HOT, 3])
def test_same_as_brute(spark, monkeypatch, bits, hot):
    monkeypatch.setattr(common, "HOT", hot)
    rows = rows_of()
    df = spark.createDataFrame(rows, "doc_id bigint, text string, keep_id string, n int")
    check(rows, exact_dedup.exact_dedup(df, carry=(F.coalesce("text", F.lit("")),), bits=bits).collect())


def test_ties_nulls_empty_names(spark):
    rows = [(None, "t", "p", 1), (None, "t", "p", 1), (4, "u", "p", 1), (4, "u", "q", 2), (3, "u", "q", 2), (None, "v", "q", 2), (1, "v", "q", 2), (None, None, "q", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, keep_id string, `row.of` int")
    check(rows, exact_dedup.exact_dedup(df, carry=(F.coalesce("text", F.lit("")),)).collect())
    left = exact_dedup.one_of_each(df)
    assert left.columns == df.columns
    assert sorted((r[0] is None, r[0] or 0, r[1]) for r in left.collect() if r[1]) == [(False, 1, "v"), (False, 4, "u"), (True, 0, "t")]
    assert left.count() == 4
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0
    assert exact_dedup.one_of_each(df.limit(0)).count() == 0


def test_sieve_lets_nothing_through_that_repeats(spark):
    groups = spark.range(1000).select((F.col("id") * 7).alias("k"))
    holes = exact_dedup.sieve(groups, ["k"], 1 << 20)
    out = exact_dedup.may_repeat(spark.range(20_000).withColumnRenamed("id", "k"), ["k"], holes, "may", 1 << 20).where("may").select("k").collect()
    got = {r.k for r in out}
    assert got >= {7 * i for i in range(1000)}
    assert len(got) < 1200
