"""Where fragments start and end, and which sides of events they cover, by brute force."""

import random

from fusewright.operators import event_filters as ef
from fusewright.operators import stats

UP, DOWN = "upstream", "downstream"


def test_edges_of_proper_fragments(spark):
    cols = "read_key string, contig string, start int, end int, strand boolean, paired boolean, proper boolean, supplementary boolean"
    rows = [("a", "1", 40, 59, True, True, True, False), ("a", "1", 100, 125, False, True, True, False), ("b", "1", 200, 219, True, True, False, False), ("c", "2", 7, 90, False, False, False, False), ("d", "1", 400, 450, True, True, True, True), ("e", "1", 600, 650, True, True, True, False)]
    seg = spark.createDataFrame(rows, cols)
    got = sorted(map(tuple, stats.fragment_edges(seg, spark.createDataFrame([("e",)], "read_key string")).collect()))
    assert got == [("1", "end", 6), ("1", "start", 2), ("2", "end", 4), ("2", "start", 0)]


def covered(edges, contig, bp, way, anchor, split):
    trunc = lambda x: int(x / 20)
    if way == UP:
        low, high = (bp if split else bp - 200), max(bp + 200, anchor)
        return any((contig, "start", w) in edges for w in range(trunc(low) + 1, trunc(high) + 1))
    low, high = min(bp - 200, anchor), (bp if split else bp + 200)
    return any((contig, "end", w) in edges for w in range(trunc(low), trunc(high)))


def test_sides_by_brute_force(spark):
    rng = random.Random(4)
    edges = {(rng.choice("12"), rng.choice(["start", "end"]), rng.randrange(0, 2000)) for _ in range(250)}
    exons = [(g, a, a + 300, p, n) for g in (1, 2) for a, p, n in ((1000, None, 9000), (9000, 1300, 20_000), (20_000, 9300, None))]
    rows = []
    for i in range(400):
        b1, b2 = rng.randrange(0, 40_000), rng.randrange(0, 40_000)
        rows.append((f"e{i}", rng.choice([1, 2]), rng.choice([1, 2, 3]), rng.choice("12"), rng.choice("12"), b1, b2, rng.choice([UP, DOWN]), rng.choice([UP, DOWN]), max(0, b1 + rng.randrange(-15_000, 15_000)), max(0, b2 + rng.randrange(-900, 900)), rng.randrange(2), 0, rng.randrange(2), rng.random() < 0.1, False, rng.choice(["none", "none", "hairpin"])))
    cols = "event_id string, gene1 bigint, gene2 bigint, contig1 string, contig2 string, bp1 bigint, bp2 bigint, dir1 string, dir2 string, anchor1 bigint, anchor2 bigint, split1 bigint, split2 bigint, disc bigint, spliced1 boolean, spliced2 boolean, fate string"
    got = ef.filter_no_coverage(spark.createDataFrame(rows, cols), spark.createDataFrame(sorted(edges), "contig string, kind string, win bigint"), spark.createDataFrame(exons, "gene bigint, start bigint, end bigint, prev_end bigint, next_start bigint"))
    fates = {r.event_id: r.fate for r in got.collect()}
    seen = set()
    for e, g1, g2, c1, c2, b1, b2, d1, d2, a1, a2, s1, s2, disc, p1, p2, fate in rows:
        through = c1 == c2 and b2 - b1 < 400_000 and d1 == DOWN and d2 == UP
        strong = (through and p1 and p2) or (not through and ((s1 + s2 > 0 and s1 + disc > 0 and s2 + disc > 0) or p1 or p2))
        ends = lambda g, b: any(x == g and a <= b <= z and (p is None or n is None) for x, a, z, p, n in exons)
        bare = not (ends(g1, b1) or covered(edges, c1, b1, d1, a1, s1 + s2)) or not (ends(g2, b2) or covered(edges, c2, b2, d2, a2, s1 + s2))
        want = "no_coverage" if fate == "none" and not strong and bare else fate
        assert fates[e] == want, e
        seen.add(want)
    assert seen == {"none", "hairpin", "no_coverage"}
