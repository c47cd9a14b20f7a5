"""Hand-computed cases and sequential brute force of event rules whose order matters."""

import random

import pytest

from fusewright.operators import annotate, pivot, stats
from fusewright.operators import event_filters as ef
from fusewright.sources import text
from pyspark.sql import functions as F

EVENT = "event_id string, gene1 bigint, gene2 bigint, contig1 string, contig2 string, dir1 string, dir2 string, bp1 bigint, bp2 bigint, split1 bigint, split2 bigint, disc bigint, listed_split bigint, listed bigint, fate string"
UP, DOWN = "upstream", "downstream"


def test_only_the_winners_own_neighbours_are_merged(spark):
    rows = [(f"e{i}", 1, 2, "1", "2", DOWN, UP, 100 + i, 200 + i, n, 0, 0, n, n, "none") for i, n in ((0, 3), (4, 5), (8, 7))]
    got = {r.event_id: (r.fate, r.split1) for r in ef.merge_adjacent(spark.createDataFrame(rows, EVENT)).collect()}
    assert got == {"e0": ("none", 3), "e4": ("merge_adjacent", 5), "e8": ("none", 12)}


def sequential(rows, reach, longest):
    """The scan, over all events in one list."""
    state = [dict(zip([x.split()[0] for x in EVENT.split(", ")], r)) for r in rows]
    itd = lambda e: e["gene1"] == e["gene2"] and e["dir1"] == UP and e["dir2"] == DOWN and 0 <= e["bp2"] - e["bp1"] < longest
    key = lambda e: tuple(e[k] for k in ("gene1", "gene2", "contig1", "contig2", "dir1", "dir2"))
    scan = sorted((e for e in state if e["fate"] == "none" or itd(e)), key=lambda e: (e["contig1"], e["bp1"], e["contig2"], e["bp2"], e["event_id"]))
    merged = set()
    for e in scan:
        own = itd(e)
        if (e["listed_split"] if own else e["split1"] + e["split2"]) == 0:
            continue
        sign = -1 if e["dir1"] == e["dir2"] else 1
        near = [x for x in scan if x is not e and key(x) == key(e) and abs(x["bp1"] - e["bp1"]) <= reach and (x["bp2"] - e["bp2"] == sign * (x["bp1"] - e["bp1"]) or (own and abs(x["bp2"] - e["bp2"]) <= reach)) and (x["split1"] + x["split2"] > 0 or (own and x["listed_split"] > 0))]
        support = lambda x: x["split1"] + x["split2"] + x["disc"]
        if any(support(e) < support(x) or (support(e) == support(x) and e["listed_split"] < x["listed_split"]) for x in near):
            continue
        for k in ("split1", "split2", *(("listed_split", "listed") if own else ())):
            e[k] += sum(x[k] for x in near)
        merged |= {x["event_id"] for x in near}
    return sorted((e["event_id"], "merge_adjacent" if e["event_id"] in merged else e["fate"], e["split1"], e["split2"], e["listed_split"], e["listed"]) for e in state)


@pytest.mark.parametrize("seed", range(4))
def test_the_scan_by_runs_is_the_sequential_scan(spark, seed):
    rng = random.Random(seed)
    rows = set()
    for _ in range(700):
        g = rng.choice([(1, 1), (1, 1), (1, 2), (3, 4)])
        a = rng.randrange(0, 120 if seed % 2 else 600)
        rows.add((*g, "1", "1" if g[0] == g[1] else rng.choice("12"), rng.choice([UP, DOWN]), rng.choice([UP, DOWN]), a, a + rng.randrange(0, 130)))
    full = []
    for i, r in enumerate(sorted(rows)):
        s1, s2 = rng.randrange(4), rng.randrange(3)
        more = rng.randrange(3)
        full.append((f"e{i:04d}", *r, s1, s2, rng.randrange(3), s1 + s2 + more, s1 + s2 + more + 2, rng.choice(["none", "none", "hairpin"])))
    got = ef.merge_adjacent(spark.createDataFrame(full, EVENT), 5, 100)
    assert sorted(map(tuple, got.select("event_id", "fate", "split1", "split2", "listed_split", "listed").collect())) == sequential(full, 5, 100)


GENES = "g1_start bigint, g1_end bigint, g1_dummy boolean, g2_start bigint, g2_end bigint, g2_dummy boolean"


def nearest(spark, event, variants, gene1=(0, 10_000_000, False), gene2=(0, 10_000_000, False), same_gene=False, reach=100_000):
    c1, c2, d1, d2, b1, b2 = event
    row = ("e", 1, 1 if same_gene else 2, c1, c2, d1, d2, b1, b2, *gene1, *gene2)
    events = spark.createDataFrame([row], "event_id string, gene1 bigint, gene2 bigint, contig1 string, contig2 string, dir1 string, dir2 string, bp1 bigint, bp2 bigint, " + GENES)
    v = spark.createDataFrame([(c1, c2, d1, d2, p, q) for p, q in variants], "contig1 string, contig2 string, dir1 string, dir2 string, pos1 bigint, pos2 bigint")
    r = pivot.nearest_variant(events, v, reach).first()
    return (r.gbp1, r.gbp2)


NONE = (None, None)


def test_nearest_variants(spark):
    deletion = ("1", "1", DOWN, UP, 1_000, 5_000)
    assert nearest(spark, deletion, [(20_000, 4_000)]) == NONE  # behind the second breakpoint
    assert nearest(spark, deletion, [(2_000, 900)]) == NONE and nearest(spark, deletion, [(2_000, 4_000)]) == (2_000, 4_000)
    # the reach begins at the gene's bound, at the breakpoint for a dummy gene
    far = ("1", "2", UP, UP, 2_000_000, 500)
    assert nearest(spark, far, [(950_000, 400)], (1_000_000, 2_100_000, False)) == (950_000, 400)
    assert nearest(spark, far, [(890_000, 400)], (1_000_000, 2_100_000, False)) == NONE
    assert nearest(spark, far, [(950_000, 400)], (1_000_000, 2_100_000, True)) == NONE
    # downstream the first position only, whatever its partners; upstream all
    down = ("1", "2", DOWN, UP, 1_000, 500_000)
    assert nearest(spark, down, [(1_100, 900_000), (1_200, 499_000)]) == NONE
    assert nearest(spark, down, [(994, 499_999), (995, 900_000), (995, 499_000)]) == (995, 499_000)
    up = ("1", "2", UP, UP, 1_000, 500_000)
    assert nearest(spark, up, [(990, 900_000), (900, 499_000), (1_005, 500_000)]) == (900, 499_000)
    assert nearest(spark, up, [(1_004, 500_005)]) == (1_004, 500_005) and nearest(spark, up, [(1_004, 500_006)]) == NONE
    # inversions, duplications, tandem duplications
    assert nearest(spark, ("1", "1", UP, UP, 10_000, 20_000), [(9_000, 9_500)]) == NONE and nearest(spark, ("1", "1", UP, UP, 10_000, 20_000), [(9_000, 19_500)]) == (9_000, 19_500)
    assert nearest(spark, ("1", "1", DOWN, DOWN, 10_000, 20_000), [(21_000, 21_500)]) == NONE and nearest(spark, ("1", "1", DOWN, DOWN, 10_000, 20_000), [(12_000, 21_500)]) == (12_000, 21_500)
    itd = ("1", "1", UP, DOWN, 10_000, 10_050)
    assert nearest(spark, itd, [(9_800, 10_060)], same_gene=True) == NONE and nearest(spark, itd, [(9_950, 10_060)], same_gene=True) == (9_950, 10_060)
    assert nearest(spark, itd, [(9_800, 10_060)]) == (9_800, 10_060)


def test_distances_of_near_genes_and_of_events_without_reads(spark):
    exons = spark.createDataFrame([(1, 0, 99, 1000), (1, 1000, 1099, None), (2, 500, 2000, None)], "gene bigint, start bigint, end bigint, next_start bigint")
    rows = [("same", 1, 1, 50, 1050), ("over", 1, 2, 50, 1050), ("far", 1, 3, 50, 920_000), ("bare", 2, 1, 600, 1050)]
    bounds = {1: (0, 1099), 2: (500, 2000), 3: (900_000, 950_000)}
    events = spark.createDataFrame([(k, a, b, "1", "1", p, q, *bounds[a], *bounds[b]) for k, a, b, p, q in rows], "event_id string, gene1 bigint, gene2 bigint, contig1 string, contig2 string, bp1 bigint, bp2 bigint, g1_start bigint, g1_end bigint, g2_start bigint, g2_end bigint")
    got = {r.event_id: r.spliced_distance for r in annotate.spliced_distance(exons, events).collect()}
    assert set(got) == {"same", "over", "bare"} and got["same"] == got["over"] < 200 and got["bare"] == 450
    base = {"gene1": 1, "gene2": 1, "contig1": "1", "contig2": "1", "bp1": 10, "bp2": 60, "dir1": UP, "dir2": DOWN, "split2": 0, "disc": 0, "p1": 1, "p2": 1, "l1": 1000.0, "l2": 1000.0, "spliced1": False, "spliced2": False, "exonic1": True, "exonic2": True, "g1_start": 0, "g1_end": 99, "g2_start": 0, "g2_end": 99}
    df = spark.createDataFrame([base | {"split1": n, "spliced_distance": d} for n in (0, 3) for d in (50, 5000)])
    value = {(r.split1, r.spliced_distance): r.v for r in df.select("split1", "spliced_distance", stats.evalue(df, 10_000_000).alias("v")).collect()}
    assert value[0, 50] == value[0, 5000] and value[3, 50] > 1000 * value[3, 5000]


def test_tandem_duplications_get_their_reads_back(spark):
    cols = "event_id string, gene1 bigint, gene2 bigint, dir1 string, dir2 string, bp1 bigint, bp2 bigint, fate string, same_coding_exon boolean, all_split bigint, cov1 bigint, cov2 bigint, duplicate_rate double, split1 bigint, split2 bigint, spared_split1 bigint, spared_split2 bigint"
    rows = [("a", 1, 1, UP, DOWN, 10, 60, "hairpin", True, 12, 50, 40, 0.0, 2, 1, 5, 4), ("b", 1, 1, UP, DOWN, 10, 60, "hairpin", True, 9, 50, 40, 0.0, 2, 1, 5, 4), ("c", 1, 1, UP, DOWN, 10, 60, "min_support", True, 99, 50, 40, 0.0, 2, 1, 5, 4)]
    got = {r.event_id: (r.fate, r.split1, r.split2) for r in ef.tandem_duplications(spark.createDataFrame(rows, cols)).collect()}
    assert got == {"a": ("none", 7, 5), "b": ("hairpin", 2, 1), "c": ("min_support", 2, 1)}


def test_fasta_headers_may_hold_the_sign(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">chr1 from a->b\nACGT\nac\n>2 x>y>z\r\nTT\r\n")
    rows = text.fasta(spark, str(tmp_path / "a.fa")).select("contig", "seq").collect()
    assert sorted(map(tuple, rows)) == [("1", "ACGTAC"), ("2", "TT")]
    assert spark.createDataFrame([(10, 19, 10.0)], "start int, end int, exonic_length double").select(annotate.intronic_fraction(None).alias("x")).where(F.col("x") == 0).count() == 1
