"""A small genome: two genes on two contigs, joined by split reads and pairs."""

from statistics import mean, stdev

import pytest

from fusewright.operators import annotate, intervals, stats
from fusewright.operators import event_filters as ef
from fusewright.plans import detect
from fusewright.sources import sinks, text
from pyspark.sql import functions as F

c = F.col
BASES = "ACGTTGCAAGCTTACGGATCCATTGCAGGCTAACCGTTAGCATCGGATTCAGGCCTA"


def seq(n, k):
    return "".join(BASES[(i * 7 + k * 13 + i * i % 11) % len(BASES)] for i in range(n))


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("genome")
    gene = lambda contig, a, b, s, n: [f'chr{contig}\tx\t{k}\t{x}\t{y}\t.\t{s}\t.\tgene_id "ENSG{n}.1"; transcript_id "T{n}"; gene_name "G{n}";' for x, y in ((a, a + 999), (b, b + 999)) for k in ("exon", "CDS")]
    (d / "a.gtf").write_text("\n".join(gene(1, 1001, 5001, "+", 1) + gene(2, 10001, 20001, "+", 2)) + "\n")
    rows = []
    for k in range(12):  # split reads: G1 up to 2000, then G2 from 20001
        s = seq(80, k)
        rows += [f"s{k}\t97\t1\t{1700 + k * 9}\t60\t60M\t1\t1961\t0\t{s[:60]}\t*", f"s{k}\t147\t1\t1961\t60\t40M40S\t1\t1\t0\t{s}\t*\tSA:Z:x", f"s{k}\t2195\t2\t20001\t60\t40S40M\t1\t1\t0\t{s}\t*\tSA:Z:x"]
    for k in range(8):  # pairs
        rows += [f"d{k}\t65\t1\t{1901 + k * 5}\t60\t50M\t2\t20011\t0\t{seq(50, 30 + k)}\t*", f"d{k}\t145\t2\t{20011 + k * 6}\t60\t50M\t1\t1901\t0\t{seq(50, 60 + k)}\t*"]
    rows += [r.replace("d0\t", "dup\t") for r in rows if r.startswith("d0\t")]
    rows += [f"n{k}\t99\t1\t1500\t60\t50M\t=\t1600\t150\t{seq(50, k)}\t*\nn{k}\t147\t1\t1600\t60\t50M\t=\t1500\t-150\t{seq(50, k)}\t*" for k in range(5)]
    (d / "a.sam").write_text("\n".join(rows) + "\n")
    return d


def test_annotation(spark, files):
    genes, transcripts, exons = annotate.build(text.gtf(spark, str(files / "a.gtf")))
    assert {(r.name, r.start, r.end, r.exonic_length, r.is_coding) for r in genes.collect()} == {("G1", 1000, 5999, 2000, True), ("G2", 10000, 20999, 2000, True)}
    assert {(r.transcript_id, r.coding_length) for r in transcripts.collect()} == {("T1", 2000), ("T2", 2000)}
    assert {(r.transcript_id, r.exon_rank, r.prev_end, r.next_start) for r in exons.collect()} == {("T1", 1, None, 5000), ("T1", 2, 1999, None), ("T2", 1, None, 20000), ("T2", 2, 10999, None)}


def test_greedy_distance():
    exons = [{"start": 0, "end": 99, "next_start": 1000}, {"start": 1000, "end": 1099, "next_start": None}]
    assert annotate.greedy_distance(50, 1050, [-1, 99, 999, 1099], exons) < 200
    assert annotate.greedy_distance(50, 80, [-1, 99, 999, 1099], exons) == 30


def test_dummy_genes(spark):
    p = spark.createDataFrame([("1", 5), ("1", 9_000), ("1", 50_000), ("2", 1)], "contig string, pos int")
    assert sorted((r.contig, r.start, r.end) for r in annotate.dummy_genes(p).collect()) == [("1", 5, 9000), ("1", 50000, 50000), ("2", 1, 1)]


def test_the_chain_finds_the_event(spark, files, tmp_path):
    events = detect.detect(spark, str(files / "a.sam"), str(files / "a.gtf")).cache()
    found = events.where("fate = 'none'").collect()
    assert len(found) == 1
    e = found[0]
    assert (e.name1, e.name2, e.bp1, e.bp2, e.dir1, e.dir2) == ("G1", "G2", 1999, 20000, "downstream", "upstream")
    assert e.split1 + e.split2 == 12 and e.disc >= 7 and e.type == "translocation" and e.spliced1 and e.spliced2
    table = detect.ranked(events)
    assert table.columns == sinks.COLUMNS
    row = table.first()
    assert (row["#gene1"], row["breakpoint1"], row["breakpoint2"]) == ("G1", "1:2000", "2:20001")
    sinks.write_tsv(table, str(tmp_path / "t"))
    assert text.fusion_table(spark, str(tmp_path / "t")).first().split == 12


def test_viral_contigs_go_by_expression_and_coverage(spark, files, tmp_path):
    """One virus with reads all over, one with many reads in one place; both pair with host gene 1."""
    reads = (files / "a.sam").read_text()
    head = "@HD\tVN:1\n@SQ\tSN:chr1\tLN:20000\n@SQ\tSN:2\tLN:30000\n@SQ\tSN:AC_000001\tLN:3000\n@SQ\tSN:AC_000002\tLN:3000\n"
    pair = lambda k, v, at: f"{k}\t65\t1\t{1700 + at // 20}\t60\t50M\t{v}\t{at}\t0\t{seq(50, at % 40)}\t*\n{k}\t145\t{v}\t{at}\t60\t50M\t1\t1700\t0\t{seq(50, at % 31 + 3)}\t*\n"
    more = "".join(pair(f"w{i}", "AC_000001", 1 + i * 37) for i in range(78)) + "".join(pair(f"f{i}", "AC_000002", 101 + i % 4) for i in range(60))
    (tmp_path / "v.sam").write_text(head + reads + more)
    events = detect.detect(spark, str(tmp_path / "v.sam"), str(files / "a.gtf"))
    fates = {(r.contig2, r.fate) for r in events.where("contig2 like 'AC%'").select("contig2", "fate").distinct().collect()}
    assert ("AC_000002", "low_coverage_viral_contigs") in fates and not any(k == "AC_000001" and "viral" in f for k, f in fates)
    assert detect.discarded(events).columns == sinks.COLUMNS and detect.discarded(events).count() == events.where("fate <> 'none'").count()


def test_options_are_checked():
    with pytest.raises(ValueError):
        detect.Options(quantile=2)
    with pytest.raises(ValueError):
        detect.Options(strandedness="maybe")
    assert not detect.Options(disabled=frozenset({"spliced"})).on("spliced")


def test_segments_of_overlapping_features(spark):
    df = spark.createDataFrame([("1", 10, 20, 1), ("1", 15, 30, 2), ("1", 40, 50, 3)], "contig string, start int, end int, id int")
    assert sorted((r.seg_start, r.seg_end, r.ids) for r in intervals.segments(df).collect()) == [(10, 14, [1]), (15, 20, [1, 2]), (21, 30, [2]), (40, 50, [3])]


def test_trimming_and_quantile(spark):
    df = spark.createDataFrame([(float(x),) for x in [*range(100), 10_000]], "v double")
    m, s, n = stats.iterative_trim(df, "v")
    assert n == 100 and m == 49.5
    n = spark.createDataFrame([(x,) for x in [5, 1, 3, 3, 9]], "reads int")
    assert stats.order_statistic(n, "reads", 0.998).first()[0] == 9 and stats.order_statistic(n, "reads", 0.5).first()[0] == 3


def test_trimming_takes_as_many_rounds_as_it_needs(spark):
    """Each power of three lies outside what the smaller ones leave, so a round drops one: more than 50 rounds."""
    kept = [3.0**i for i in range(64)]
    df, n = spark.range(0, 64, 1, 1).select(F.pow(F.lit(3.0), "id").alias("v")), 0
    while n != len(kept):
        n, m, s = len(kept), mean(kept), stdev(kept)
        kept = [x for x in kept if m - 2 * s <= x <= m + 2 * s]
    assert n < 14
    got = stats.iterative_trim(df, "v", 2.0)
    assert got[2] == n and abs(got[0] - mean(kept)) < 1e-9


def test_threshold(spark):
    h = lambda rows: spark.createDataFrame(rows, "reads int, n int")
    assert ef.recovery_threshold(h([(2, 500), (3, 150), (5, 60)])) == 4
    assert ef.recovery_threshold(h([(2, 20)])) == 1


@pytest.mark.parametrize("idle", [{"homologs": 0.5}, {"mismatch_p": 0.5}, {"mismappers": 0.5}, {"quantile": 0.9}])
def test_options_without_effect_are_refused(idle):
    with pytest.raises(ValueError, match="no effect"):
        detect.Options(**idle)


def test_read_filters_take_their_options(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(detect.rf, "read_filters", lambda *a: seen.setdefault("given", a) and [])
    monkeypatch.setattr(detect.rf, "duplicate_key", lambda d: d)
    monkeypatch.setattr(detect.rf, "mark_multimappers", lambda d: d)
    cols = "m1_contig string, m2_contig string, sp_contig string, fate string"
    detect.filtered_reads(spark.createDataFrame([], cols), detect.Options(read_through=5, homopolymer=4, disabled=frozenset({"duplicates", "low_entropy"})))
    assert seen["given"] == (5, 4)
