"""Ordered resolution against the sequential loop, on random graphs and random events."""

import random

import pytest

from fusewright.operators import conflicts


@pytest.mark.parametrize("seed", range(3))
def test_rounds_are_the_sequential_loop(spark, seed):
    rng = random.Random(seed)
    n = (40, 150, 300)[seed]
    edges = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(n * (1 + seed))}  # the lesser number is the stronger
    gone = set()
    for x in range(n):
        if x not in gone:
            gone |= {b for a, b in edges if a == x}
    got = conflicts.losers(spark.createDataFrame(sorted(edges), "strong bigint, weak bigint"))
    assert {r.id for r in got.collect()} == gone
    assert conflicts.losers(spark.createDataFrame([], "strong bigint, weak bigint")).count() == 0


def test_homologous_partners(spark):
    rng = random.Random(9)
    homologs = {(1, 11), (2, 12), (3, 13), (12, 22)}
    same = lambda a, b: (a, b) in homologs or (b, a) in homologs
    genes = [1, 2, 3, 11, 12, 13, 22, 5]
    rows = []
    for i in range(160):
        a, b = rng.choice(genes), rng.choice(genes)
        rows.append((f"e{i:03d}", a, b, rng.randrange(6), rng.randrange(6), rng.randrange(3), rng.randrange(2), rng.randrange(3), rng.choice([0.1, 0.2]), rng.choice(["none", "none", "none", "hairpin"])))
    fate = {r[0]: "homologs" if r[9] == "none" and same(r[1], r[2]) else r[9] for r in rows}
    power = lambda r: (sum(x > 0 for x in r[5:8]), sum(r[5:8]), -r[8], r[0])
    order = sorted((r for r in rows if fate[r[0]] == "none"), key=power, reverse=True)
    for x in order:
        if fate[x[0]] != "none":
            continue
        for y in order:
            if power(y) < power(x) and any(x[s] == y[t] and same(x[3 - s], y[3 - t]) and x[5 - s] != y[5 - t] for s in (1, 2) for t in (1, 2)):
                fate[y[0]] = "homologs"
    df = spark.createDataFrame(rows, "event_id string, gene1 bigint, gene2 bigint, bp1 bigint, bp2 bigint, split1 bigint, split2 bigint, disc bigint, evalue double, fate string")
    got = conflicts.homologous_partners(df, spark.createDataFrame(sorted(homologs), "gene1 bigint, gene2 bigint"))
    assert {r.event_id: r.fate for r in got.collect()} == fate
    assert set(fate.values()) == {"none", "homologs", "hairpin"}
