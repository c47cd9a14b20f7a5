"""Steps by hand-computed cases."""

import random

from pyspark.sql import functions as F

from fusewright.operators import event_filters as ef
from fusewright.operators import intervals, rules, stats
from fusewright.operators import read_filters as rf

c = F.col
EVENT = "event_id string, gene1 int, gene2 int, contig1 string, contig2 string, bp1 int, bp2 int, dir1 string, dir2 string, split1 bigint, split2 bigint, disc bigint, exonic1 boolean, exonic2 boolean, spliced1 boolean, spliced2 boolean"
GENES = "g1_start int, g1_end int, g1_strand boolean, g1_dummy boolean, g1_coding boolean, g2_start int, g2_end int, g2_strand boolean, g2_dummy boolean, g2_coding boolean"
D, U = "downstream", "upstream"


def event(k, bp1=1000, bp2=9000, d1=D, d2=U, s1=2, s2=0, disc=0, g2=1, ex=(True, True), sp=(False, False), c2="1"):
    return (k, 1, g2, "1", c2, bp1, bp2, d1, d2, s1, s2, disc, *ex, *sp, 0, 20000, True, False, True, 0, 20000, True, False, True)


def test_intragenic_exonic(spark):
    """Out of 8,000 bases between the breakpoints: few exonic ones or none but exonic ones are artefacts, half of them is a deletion."""
    rows = [(*event(k), d) for k, d in (("few", 1000), ("half", 4000), ("most", 7000), ("all", 8000))] + [(*event("spliced", sp=(True, True)), 1000)]
    df = spark.createDataFrame(rows, f"{EVENT}, {GENES}, spliced_distance bigint")
    assert {r.event_id for r in df.where(ef.intragenic_exonic()).collect()} == {"few", "all"}


def test_evalue(spark):
    """One spliced side earns the spliced share: 10 of 100, against 65 for two exonic sides. Three reads, 20 million mapped: no depth factor."""
    rows = [(*event(k, g2=2, c2="2", s1=3, sp=sp), 10_000.0, 10_000.0, 1, 1, 0) for k, sp in (("none", (False, False)), ("one", (True, False)), ("both", (True, True)))]
    df = spark.createDataFrame(rows, f"{EVENT}, {GENES}, l1 double, l2 double, p1 int, p2 int, spliced_distance bigint").withColumns({"g2_start": F.lit(500_000), "g2_end": F.lit(600_000)})
    got = {r.event_id: r.e for r in df.select("event_id", stats.evalue(df, 20_000_000).alias("e")).collect()}
    base = (3 - 0.73) ** -2.28 * 10**-1.75 * 4 / 100
    assert abs(got["one"] - base * 10) < 1e-9 and abs(got["both"] - base * 10) < 1e-9 and abs(got["none"] - base * 65) < 1e-9


def test_mirrored_pairs_are_duplicates(spark):
    rows = [("a", "1", "2", 50, 10, "none"), ("b", "2", "1", 10, 50, "none"), ("c", "1", "2", 10, 50, "none"), ("d", "1", "2", 50, 10, "homopolymer"), ("e", "1", "2", 10, 50, "none")]
    df = spark.createDataFrame(rows, "read_key string, ca string, cb string, pa int, pb int, fate string")
    d = rf.ordered_ends(df, c("ca"), c("cb"), c("pa"), c("pb"))
    got = {r.read_key: r.fate for r in rf.mark_duplicates(d, ["contig1", "contig2", "pos1", "pos2"]).collect()}
    assert got == {"a": "none", "b": "duplicates", "c": "none", "d": "homopolymer", "e": "duplicates"}


def test_the_best_supported_neighbour_wins(spark):
    """Discordant pairs count; a tie goes to the one with more listed split reads."""
    rows = [(*event("few", 1000, s1=3), "none", 3), (*event("pairs", 1002, 9002, s1=1, disc=9), "none", 1), (*event("x", 2000, s1=2), "none", 2), (*event("y", 2001, 9001, s1=2), "none", 5), (*event("far", 3000), "none", 9)]
    df = spark.createDataFrame(rows, f"{EVENT}, {GENES}, fate string, listed_split bigint")
    got = {r.event_id: (r.fate, r.split1) for r in ef.merge_adjacent(df).collect()}
    assert got == {"few": ("merge_adjacent", 3), "pairs": ("none", 4), "x": ("merge_adjacent", 2), "y": ("none", 4), "far": ("none", 2)}


def test_terminal_exons_are_no_sites(spark):
    rows = [(1, 100, 200, None, 300, None, None), (1, 300, 400, 200, None, None, None), (2, 500, 600, None, None, 520, 580), (3, 700, 800, None, None, None, None), (4, 900, 999, None, 1200, 900, 999)]
    exons = spark.createDataFrame(rows, "gene int, start int, end int, prev_end int, next_start int, coding_start int, coding_end int")
    got = {(r.gene, r.direction, r.pos) for r in intervals.splice_sites(exons, 0).collect()}
    assert got == {(1, D, 200), (1, U, 300), (2, U, 500), (2, D, 600), (4, U, 900), (4, D, 999)}


def test_rule_files_reach_events(spark, tmp_path):
    from fusewright.sources import text

    (tmp_path / "r").write_text("G1\tany\n1:1001\t2:9001\n+1:1-30000\tlow_support\n9:5-9\tany\nnobody\tG1\nchrU*:1-9\tG1\n# note\n")
    genes = spark.createDataFrame([(1, "G1", "1", 0, 20000), (2, "G2", "2", 0, 20000)], "id int, name string, contig string, start int, end int")
    contigs = spark.createDataFrame([("1",), ("2",), ("U22",), ("U1",)], "contig string")
    r = rules.located(text.rules(spark, str(tmp_path / "r")), genes, contigs)
    kinds = sorted((x.a_kind, x.b_kind, x.a_contig) for x in r.collect())
    assert kinds == [("gene", "any", "1"), ("position", "position", "1"), ("range", "any", "9"), ("range", "gene", "U1"), ("range", "low_support", "1")]
    rows = [(*event("e", g2=2, c2="2"), False, False, True, 0.1), (*event("f", 1001, g2=2, c2="2"), False, True, True, 0.9)]
    df = spark.createDataFrame(rows, f"{EVENT}, {GENES}, ambiguous boolean, strand1 boolean, strand2 boolean, evalue double")
    hits = rules.rule_hits(df, r).join(r, "rule_id").collect()
    assert sorted((x.event_id, x.a_kind, x.b_kind) for x in hits) == [("e", "gene", "any"), ("e", "position", "position"), ("f", "gene", "any"), ("f", "range", "low_support")]


def test_strandedness(spark):
    cols = "m2_contig string, m2_strand boolean, m2_start int, m2_end int, m2_genes array<int>, sp_contig string, sp_strand boolean, sp_start int, m1_strand boolean, m1_first boolean, m2_first boolean, gene_strand boolean"
    sites = spark.createDataFrame([(7, U, 100)], "gene int, direction string, pos int")
    one = lambda first: ("1", True, 100, 150, [7], "1", True, 5000, False, not first, first, True)
    df = lambda n, k: spark.createDataFrame([one(i < k) for i in range(n)], cols)
    assert [stats.strandedness(df(*x), sites) for x in ((120, 119), (120, 60), (120, 2), (90, 90))] == ["yes", "no", "reverse", "no"]


def test_sites_are_never_broadcast(spark):
    """A few exons grow into many positions, whose estimated size is that of the exons."""
    exons = spark.range(3).select(c("id").alias("gene"), (c("id") * 100).alias("start"), (c("id") * 100 + 50).alias("end"))
    at = spark.createDataFrame([(0, D, 52), (0, D, 53), (1, U, 98), (2, U, 250), (5, U, 0)], "gene bigint, way string, pos bigint")
    out = intervals.spliced(at, intervals.boundary_sites(exons), "gene", "way", "pos", "hit")
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.gene, r.pos): r.hit for r in out.collect()} == {(0, 52): True, (0, 53): False, (1, 98): True, (2, 250): False, (5, 0): False}


def test_neighbours_across_bins(spark):
    """Bins of ten bases: neighbours may stand many bins away, at the same base they don't count, and an unknown position has none."""
    rng = random.Random(3)
    spots = [(str(rng.randrange(2)), s, s + rng.randrange(40), i) for i, s in enumerate(rng.sample(range(900), 30))] + [("0", 1400, 1410, 30)]
    asked = [(i, str(rng.randrange(3)), rng.choice([rng.randrange(1500), spots[i % 30][1], spots[i % 30][2]])) for i in range(200)] + [(200, "0", None)]
    points = spark.createDataFrame(asked, "k int, contig string, pos bigint")
    got = {r.k: r for r in intervals.flanking(points, spark.createDataFrame(spots, "contig string, start bigint, end bigint, id int"), width=10).collect()}
    for k, contig, pos in asked:
        left = max(((e, -i) for t, _, e, i in spots if pos is not None and t == contig and e < pos), default=None)
        right = min(((s, i) for t, s, _, i in spots if pos is not None and t == contig and s > pos), default=None)
        r = got[k]
        assert (r.left_id, r.left_distance) == ((-left[1], pos - left[0]) if left else (None, None))
        assert (r.right_id, r.right_distance) == ((right[1], right[0] - pos) if right else (None, None))
    assert len(got) == 201
