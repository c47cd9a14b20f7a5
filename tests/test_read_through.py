"""Gapped proper alignments become split reads: by kind, and through the whole chain."""

from fusewright.functions import cigar
from fusewright.operators import assemble
from fusewright.plans import detect
from fusewright.sources import text

from tests.test_detect import seq


def sam(*rows):
    return "".join("\t".join(map(str, r)) + "\n" for r in rows)


def rec(name, flag, pos, ops, n, contig="1", k=0):
    return (name, flag, contig, pos, 60, ops, "=" if flag & 1 else "*", 1, 0, seq(n, k), "*")


GENES = [("1", 1000, 1999, 1), ("1", 5000, 5999, 2), ("2", 0, 9999, 3)]


def extracted(spark, tmp_path, *rows):
    (tmp_path / "a.sam").write_text(sam(*rows))
    seg = assemble.segments(text.sam(spark, str(tmp_path / "a.sam")))
    d = assemble.read_through(seg, spark.createDataFrame(GENES, "contig string, start int, end int, id bigint"))
    assert set(d.columns) == set(assemble.reads(seg).columns)
    for p in ("m1", "m2", "sp"):
        d = d.withColumn(f"{p}_cigar", cigar.text(d[f"{p}_ops"]))
    return {r.read_group: r for r in d.collect()}


def test_kinds(spark, tmp_path):
    got = extracted(
        spark, tmp_path,
        rec("fwd", 99, 1951, "50M3000N30M", 80), rec("fwd", 147, 5101, "60M", 60),
        rec("rev", 99, 1851, "60M", 60), rec("rev", 147, 1981, "20M3000N5I35M", 60),
        rec("both", 99, 1941, "60M3000N20M", 80), rec("both", 147, 1986, "15M3000N65M", 80),
        rec("pair", 99, 1801, "50M", 50), rec("pair", 147, 5101, "50M", 50),
        rec("reach", 99, 1951, "50M", 50), rec("reach", 147, 1961, "60M", 60),  # merely reaches out of the gene
        rec("same", 99, 1101, "50M", 50), rec("same", 147, 1301, "20M300N30M", 50),
        rec("alone", 0, 1951, "4S50M3000N30M", 84), rec("nowhere", 99, 8001, "50M", 50), rec("nowhere", 147, 8101, "50M", 50),
        rec("split", 99, 1951, "50M3000N30M", 80), (*rec("split", 147, 5101, "60M", 60), "SA:Z:2,1"),
    )
    assert set(got) == {"fwd", "rev", "both", "pair", "alone"}
    r = got["fwd"]
    assert r.is_split and (r.m2_start, r.m2_end, r.m2_cigar, r.m2_strand) == (5000, 5029, "50S30M", True)
    assert (r.sp_start, r.sp_end, r.sp_cigar) == (1950, 1999, "50M30S") and (r.m1_start, r.m1_cigar, r.m1_strand) == (5100, "60M", False)
    r = got["rev"]
    assert (r.m2_start, r.m2_end, r.m2_cigar, r.m2_strand) == (1980, 1999, "20M40S", False)
    assert (r.sp_start, r.sp_cigar) == (5000, "20S5I35M") and (r.m1_start, r.m1_cigar) == (1850, "60M")
    r = got["both"]  # 60 bases before the skip forward, 65 behind it backward: the forward mate is split
    assert (r.m2_start, r.m2_cigar, r.sp_cigar) == (5000, "60S20M", "60M20S") and (r.m1_start, r.m1_cigar) == (5000, "15S65M")
    r = got["pair"]
    assert not r.is_split and (r.m1_start, r.m2_start, r.sp_start) == (1800, 5100, None)
    r = got["alone"]
    assert r.single_end and (r.m2_start, r.m2_cigar, r.sp_cigar) == (5000, "54S30M", "4S50M30S") and r.m1_start == 5000 and r.m1_strand != r.m2_strand


def test_the_chain_takes_read_through_events_from_proper_pairs(spark, tmp_path):
    gene = lambda n, a, b: [f'1\tx\t{k}\t{x}\t{y}\t.\t+\t.\tgene_id "ENSG{n}.1"; transcript_id "T{n}"; gene_name "G{n}";' for x, y in ((a, a + 999), (b, b + 999)) for k in ("exon", "CDS")]
    (tmp_path / "a.gtf").write_text("\n".join(gene(1, 1001, 5001) + gene(2, 20001, 25001)) + "\n")
    rows = []
    for k in range(10):  # from the end of G1's last exon to the start of G2's first
        rows += [rec(f"r{k}", 99, 5951 - k, f"{50 + k}M14000N{50 - k}M", 100, k=k), rec(f"r{k}", 147, 20101 + 3 * k, "80M", 80, k=k + 20)]
    (tmp_path / "a.sam").write_text(sam(*rows))
    events = detect.detect(spark, str(tmp_path / "a.sam"), str(tmp_path / "a.gtf")).collect()
    found = [e for e in events if (e.name1, e.name2, e.bp1, e.bp2) == ("G1", "G2", 5999, 20000)]
    assert len(found) == 1 and found[0].dir1 == "downstream" and found[0].dir2 == "upstream"
    assert found[0].listed_split == 10 and "read-through" in found[0].type
