import gzip

from fusewright.functions import cigar
from fusewright.functions import sequence as sq
from fusewright.operators import assemble, transcripts
from fusewright.plans import plots
from fusewright.sources import sinks, text
from pyspark.sql import functions as F

c = F.col


def write(path, content, zipped=False):
    with (gzip.open if zipped else open)(path, "wt") as f:
        f.write(content)
    return str(path)


def test_fasta(spark, tmp_path):
    p = write(tmp_path / "a.fa.gz", ">chr1 first\nacgtN\nACGT\n>chrM\nTTTT\n>other\nAA\n", True)
    rows = {(r.contig, r.chunk_no): r for r in text.fasta(spark, p, "1 MT", chunk=4, overlap=2).collect()}
    assert {k: v.seq for k, v in rows.items()} == {("1", 0): "ACGTNA", ("1", 1): "NACGT", ("1", 2): "T", ("MT", 0): "TTTT"}
    assert rows["1", 0].length == 9 and rows["1", 0].original_name == "chr1"


def test_gtf_and_domains(spark, tmp_path):
    rows = [
        "#comment",
        'chr1\tx\texon\t11\t20\t.\t+\t.\tgene_id "ENSG1.5"; transcript_id "T1"; gene_name "A";',
        'chr1\tx\tCDS\t12\t18\t.\t+\t.\tgene_id "ENSG1.5"; transcript_id "T1"; gene_name "A";',
        'chr1\tx\tgene\t1\t99\t.\t+\t.\tgene_id "ENSG1.5";',
        'chr1\tx\texon\tbad\t20\t.\t+\t.\tgene_id "G2"; transcript_id "T1";',
        'chr2\tx\texon\t5\t6\t.\t-\t.\tgene_id "G3"; transcript_id "T3";',
    ]
    got = sorted((r.feature, r.contig, r.start, r.end, r.strand, r.gene_name, r.gene_key) for r in text.gtf(spark, write(tmp_path / "a.gtf", "\r\n".join(rows))).collect())
    assert got == [("CDS", "1", 11, 17, True, "A", "ENSG1"), ("exon", "1", 10, 19, True, "A", "ENSG1"), ("exon", "2", 4, 5, False, "G3", "G3")]
    gff = "chr1\tp\td\t3\t9\t.\t-\t.\tName=a%20b%2Cc;gene_id=ENSG1.2;gene_name=A\nchr1\tp\td\t3\t9\t.\t-\t.\tName=bad%zz;gene_id=G;gene_name=B\n"
    assert sorted((r.name, r.start, r.gene_id) for r in text.protein_domains(spark, write(tmp_path / "d.gff3", gff)).collect()) == [("a_b_c", 2, "ENSG1"), ("bad%zz", 2, "G")]


def test_variants_in_both_forms(spark, tmp_path):
    four = "chr1:100\tchr2:200\t+\t-\n2:50\t1:10\tupstream\tdownstream\n1:x\t2:3\t+\t+\n"
    got = sorted(tuple(r) for r in text.structural_variants(spark, write(tmp_path / "a.tsv", four)).collect())
    assert got == [("1", 9, "downstream", "2", 49, "upstream"), ("1", 99, "downstream", "2", 199, "upstream")]
    head = "##fileformat=VCFv4.3\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n"
    vcf = "1\t100\t.\tN\tN[2:200[\t.\tPASS\tSVTYPE=BND\n1\t5\t.\tN\t<DEL>\t.\tPASS\tSVTYPE=DEL;END=9\n1\t5\t.\tN\t<INV>\t.\tPASS\tEND=9;SVTYPE=INV\n1\t5\t.\tN\t<DUP>\t.\tlow\tSVTYPE=DUP;END=9\n1\t7\t.\tN\tN.\t.\tPASS\tSVTYPE=BND\n"
    got = sorted(tuple(r) for r in text.structural_variants(spark, write(tmp_path / "a.vcf", head + vcf)).collect())
    assert got == [("1", 4, "downstream", "1", 8, "downstream"), ("1", 4, "downstream", "1", 8, "upstream"), ("1", 4, "upstream", "1", 8, "upstream"), ("1", 99, "downstream", "2", 199, "upstream")]


def test_rules(spark, tmp_path):
    rows = "#c\n+chr1:100-200\tread_through\nGENE\t-2:7\nshort\n"
    got = sorted((r.a_kind, r.a_contig, r.a_start, r.a_end, r.a_strand, r.a_gene, r.b_kind, r.b_start, r.b_strand) for r in text.rules(spark, write(tmp_path / "r.tsv", rows)).collect())
    assert got == [("gene", None, None, None, None, "GENE", "position", 6, False), ("range", "1", 99, 199, True, None, "read_through", None, None)]


def test_cigar(spark):
    df = spark.createDataFrame([("5S10M100N20M3I2D7M4H", 50), ("*", 0), (None, 0), ("12M832512N13M25S", 1), ("49M902241N14M", 1)], "g string, s int").withColumn("o", cigar.parse(c("g")))
    r = df.select(cigar.reference_length(c("o")).alias("r"), cigar.query_length(c("o")).alias("q"), cigar.preclip(c("o")).alias("a"), cigar.postclip(c("o")).alias("z"), cigar.blocks(c("s"), c("o")).alias("b"), cigar.has_long_gap(c("o"), F.lit(0)).alias("gap")).collect()
    assert (r[0].r, r[0].q, r[0].a, r[0].z) == (139, 45, 5, 4)
    assert [tuple(x) for x in r[0].b] == [(50, 60), (160, 180), (182, 189)]
    assert (r[1].r, r[1].a, r[2].z) == (0, 0, 0)
    assert [x.gap for x in r] == [False, False, False, True, False]


def test_identifiers(spark):
    df = spark.createDataFrame([("chrM", "ENSG1.2", "q,1,3", "AcgN[")], "a string, b string, k string, s string")
    r = df.select(sq.strip_chr(c("a")), sq.strip_version(c("b")), sq.read_group(c("k")), sq.reverse_complement(c("s"))).first()
    assert tuple(r) == ("MT", "ENSG1", "q,1", "]NcgT")
    import re

    assert re.match(sq.wildcard_regex("1 NC_* X"), "NC_12") and not re.match(sq.wildcard_regex("1 NC_* X"), "11")


def test_assembly_of_reads(spark, tmp_path):
    sam = "\n".join([
        "p\t65\t1\t101\t60\t20M\t2\t201\t0\t" + "A" * 20 + "\t*", "p\t129\t2\t201\t60\t20M\t1\t101\t0\t" + "C" * 20 + "\t*",
        "s\t97\t1\t301\t60\t30M\t1\t401\t0\t" + "A" * 30 + "\t*", "s\t147\t1\t401\t60\t20M20S\t1\t301\t0\t" + "C" * 40 + "\t*\tSA:Z:x",
        "s\t2195\t2\t501\t60\t20S20M\t1\t301\t0\t" + "C" * 40 + "\t*\tSA:Z:x", "u\t4\t*\t0\t0\t*\t*\t0\t0\tA\t*", "n\t99\t1\t1\t60\t5M\t=\t20\t0\tAAAAA\t*", "n\t147\t1\t20\t60\t5M\t=\t1\t0\tAAAAA\t*",
    ]) + "\n"
    seg = assemble.segments(text.sam(spark, write(tmp_path / "a.sam", sam)))
    got = {r.read_group: r for r in assemble.reads(seg).collect()}
    assert set(got) == {"p", "s"}
    assert not got["p"].is_split and got["p"].sp_contig is None
    s = got["s"]
    assert s.is_split and (s.m1_start, s.m2_start, s.sp_contig, s.sp_end) == (300, 400, "2", 519)


def test_peptides_and_frames():
    assert transcripts.peptide("ATGGCC|GCCTAAGCC", 0) == "MA|A*"
    assert transcripts.peptide("ATGGC|CGCCTAA", 0) == "M|aA*"
    assert transcripts.reading_frame("MA|A*") == "in-frame" and transcripts.reading_frame("M*A|AA") == "stop-codon" and transcripts.reading_frame("MA|") == "." and transcripts.reading_frame("MA|aa") == "out-of-frame"


def test_realignment():
    gene = "ACGTTGCAAGCTTACGGATCCATTGCAGGCTAACCGTTAGC"
    ix = transcripts.kmer_index(gene)
    assert transcripts.align(gene[5:30], gene, ix, 0.8) and not transcripts.align("TTTTTTTTTTTTTTTTTTTT", gene, ix, 0.8)
    assert transcripts.align(gene[:12] + gene[25:37], gene, ix, 0.8)


def test_realignment_past_many_seeds():
    gene = "ACGTTGCAAGCTTACGGATCCATTGCAGGCTAACCGTTAGC"
    read, seed = gene[:12] + gene[25:37], gene[25:33]
    for long in ((seed + "T") * 120 + gene, gene[:14] + (seed + "T") * 120 + gene[20:]):  # false places before the first part, and between the two
        assert transcripts.align(read, long, transcripts.kmer_index(long), 0.8)
    assert not transcripts.align(read, gene[25:37] + (seed + "T") * 120 + gene[:14], transcripts.kmer_index(gene[25:37] + (seed + "T") * 120 + gene[:14]), 0.8)


def test_mismatches(spark):
    df = spark.createDataFrame([("ACGTA", "5M", True, "ACGAA"), ("NNACG", "2S3M", False, "ACG"), ("NNACG", "2S3M", True, "ACG")], "s string, g string, f boolean, r string")
    assert [tuple(r.x) for r in df.select(transcripts.mismatches("s", "g", "f", "r").alias("x")).collect()] == [(1, 5), (0, 3), (1, 3)]


GOLDEN = dict.fromkeys(sinks.COLUMNS, ".") | {"#gene1": "BCR", "gene2": "ABL1", "breakpoint1": "22:23632600", "breakpoint2": "9:133729451", "direction1": "downstream", "direction2": "upstream", "split_reads1": "4", "split_reads2": "7", "discordant_mates": "0", "confidence": "high", "type": "translocation", "fusion_transcript": "AAAC|gg|TTT"}


def test_result_table_exports(spark, tmp_path):
    t = spark.createDataFrame([tuple(GOLDEN[k] for k in sinks.COLUMNS)], ", ".join(f"`{k}` string" for k in sinks.COLUMNS))
    v = sorted((r.CHROM, r.POS, r.ALT, r.QUAL, r.FILTER) for r in sinks.vcf_records(t).collect())
    assert v == [("22", 23632600, "NGG[9:133729451[", "5", "PASS"), ("9", 133729451, "]22:23632600]GGN", "5", "PASS")]
    sinks.write_tsv(t, str(tmp_path / "out"))
    r = text.fusion_table(spark, str(tmp_path / "out")).first()
    assert (r.gene1, r.contig1, r.bp2, r.split, r.type) == ("BCR", "22", 133729451, 11, "translocation")
    s = plots.junction_snippet(t).first()
    assert (s.left, s.right) == ("AAACg", "gTTT")


def test_plot_tables(spark):
    ex = spark.createDataFrame([("e", 1, 100, 199), ("e", 1, 1200, 1299), ("e", 2, 50, 99)], "event_id string, side int, start int, end int")
    lay = plots.exon_layout(ex)
    assert sorted((r.side, r.x0, r.x1) for r in lay.collect()) == [(1, 0, 99), (1, 300, 399), (2, 0, 49)]
    assert max(r.right for r in plots.scaled(lay).collect()) == 1.0
    assert [r.label for r in plots.scale_bar(spark.createDataFrame([(12345.0,), (40.0,)], "width double")).collect()] == ["2 kbp", "8 bp"]


def test_every_kmer_has_a_code(spark, tmp_path):
    from fusewright.plans.demo import QUERIES

    texts = {1: "acgtgcatgcaagtc tta", 2: "short", 3: "exactly8", 4: None}
    spark.createDataFrame(list(texts.items()), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(map(tuple, QUERIES["kmer_index_codes"](spark, str(tmp_path)).select("item_id", "pos").collect()))
    assert got == [(i, p) for i, t in texts.items() for p in range(sum(x.isalpha() for x in t or "") - 7)]
