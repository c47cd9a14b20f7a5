"""Genes and strands of alignments from the splice sites they meet, and from their mates."""

import random

from fusewright.functions import cigar
from fusewright.operators import annotate, intervals
from pyspark.sql import functions as F

SEGMENT = "contig string, start int, end int, strand boolean, cigar string, genes array<bigint>, predicted boolean"


def wide(spark, rows):
    """rows: read key, is_split, and three segments (contig, start, end, strand, cigar, genes, predicted)."""
    schema = "read_key string, is_split boolean, " + ", ".join(f"{p} struct<{SEGMENT.replace(' ', ':').replace(',:', ',')}>" for p in annotate.PARTS)
    d = spark.createDataFrame(rows, schema)
    for p in annotate.PARTS:
        d = d.select("*", *(F.col(f"{p}.{x.split()[0]}").alias(f"{p}_{x.split()[0]}") for x in SEGMENT.split(", "))).drop(p)
        d = d.withColumn(f"{p}_ops", cigar.parse(F.col(f"{p}_cigar"))).withColumn(f"{p}_exonic", F.size(f"{p}_genes") > 0)
    return d


def segment(at, ops, genes, strand=True, predicted=None, end=None):
    return ("1", at, end or at + 50, strand, ops, genes, predicted)


EXONS = "gene bigint, start int, end int, prev_end int, next_start int, coding_start int, coding_end int"


def setting(spark):
    """Genes 1 (+) and 2 (-) overlap; exons of 1 end at 199 and start at 400, those of 2 end at 249 and start at 450."""
    genes = spark.createDataFrame([(1, "1", 100, 600, True), (2, "1", 100, 600, False), (3, "1", 5000, 5999, True)], "id bigint, contig string, start int, end int, strand boolean")
    exons = spark.createDataFrame([(1, 100, 199, None, 400, None, None), (1, 400, 600, 199, None, None, None), (2, 100, 249, None, 450, None, None), (2, 450, 600, 249, None, None, None), (3, 5000, 5099, None, 5200, None, None), (3, 5200, 5999, 5099, None, None, None)], EXONS)
    return genes, intervals.splice_sites(exons)


def test_splice_sites_choose_genes_and_strands(spark):
    genes, sites = setting(spark)
    none = None
    rows = [
        ("clip", True, segment(120, "50M", [1, 2], False), segment(400, "20S30M", [1, 2]), segment(5050, "50M20S", [3])),
        ("skip", False, segment(160, "40M200N10M", [1, 2]), segment(5010, "50M", [3]), none),
        ("other", False, segment(160, "91M200N10M", [1, 2]), segment(120, "50M", [1, 2], False), none),
        ("no site", False, segment(165, "30M5I15M20S", [1, 2]), segment(130, "50M", [1], False), none),
        ("told", False, segment(400, "20S30M", [1], True, False), segment(120, "50M", [1], False, False), none),
    ]
    got = {r.read_key: r for r in annotate.by_splice_sites(wide(spark, rows), genes, sites).collect()}
    r = got["clip"]
    assert (r.m1_genes, r.m2_genes, r.m1_predicted, r.m2_predicted, r.sp_predicted) == ([1], [1], True, True, True)
    r = got["skip"]
    assert (r.m1_genes, r.m1_predicted, r.m2_predicted) == ([1], True, False)  # both mates forward: the second is read the other way
    r = got["other"]
    assert (r.m1_genes, r.m1_predicted, r.m2_genes, r.m2_predicted) == ([2], False, [1, 2], False)
    r = got["no site"]
    assert (r.m1_genes, r.m1_predicted, r.m2_predicted) == ([1, 2], None, None)
    assert got["told"].m1_predicted is False and got["told"].m2_predicted is False


def mates(is_split, a, b, s, x, y, z):
    """The rules in order; x, y, z: strands; a, b, s: predicted ones."""
    same = x == y
    if a is None and b is not None:
        a = not b if same else b
    elif a is not None and b is None:
        b = not a if same else a
    elif a is not None and (a != b) != same:
        a = b = None
    if is_split:
        flips = y != z
        if b is None and s is not None:
            a = b = not s if flips else s
        elif b is not None and s is None:
            s = not b if flips else b
        elif b is not None and (b != s) != flips:
            a = b = s = None
    return a, b, s


def test_mates_infer_and_contradict(spark):
    rng = random.Random(1)
    pick = lambda: rng.choice([True, False, None])
    rows, want = [], {}
    for i in range(300):
        split, x, y, z, a, b = rng.random() < 0.6, rng.random() < 0.5, rng.random() < 0.5, rng.random() < 0.5, pick(), pick()
        s = pick() if split else None
        rows.append((str(i), split, segment(1, "5M", [1], x, a), segment(1, "5M", [1], y, b), segment(1, "5M", [1], z, s) if split else None))
        want[str(i)] = mates(split, a, b, s, x, y, z)
    got = annotate.mate_strands(wide(spark, rows)).select("read_key", "m1_predicted", "m2_predicted", "sp_predicted").collect()
    assert {r[0]: tuple(r)[1:] for r in got} == want


def test_what_has_no_exon_takes_genes_then_dummies(spark):
    genes, _ = setting(spark)
    genes = genes.withColumns({"name": F.lit("g"), "is_dummy": F.lit(False), "is_coding": F.lit(True), "exonic_length": F.lit(1).cast("bigint")})
    rows = [
        ("held", False, segment(5110, "50M", []), segment(8000, "50M", []), None),
        ("split", True, segment(7000, "50M", [], False), segment(7100, "20S51M", []), segment(20_000, "51M20S", [])),
        ("beside", False, segment(300, "50M", [1]), segment(4900, "50M", []), None),  # the known gene stands between 4,950 and 7,100
    ]
    reads, every = annotate.remaining_genes(wide(spark, rows), genes)
    r = {x.read_key: x for x in reads.collect()}
    dummies = {(x.start, x.end): x.id for x in every.where("is_dummy").collect()}
    assert set(dummies) == {(4950, 4950), (7100, 8050), (20_050, 20_050)}
    assert r["held"].m1_genes == [3] and r["held"].m2_genes == [dummies[7100, 8050]] and not r["held"].m1_exonic
    assert r["split"].m2_genes == r["split"].m1_genes == [dummies[7100, 8050]] and r["split"].sp_genes == [dummies[20_050, 20_050]]
    assert r["beside"].m2_genes == [dummies[4950, 4950]]


def test_many_sites_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(annotate, "FEW_SITES", 0)
    test_splice_sites_choose_genes_and_strands(spark)
