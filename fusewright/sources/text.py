"""Text sources: annotation, sequence, alignments, variants, rules and tables. All go through Spark's readers, so any store and .gz work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sequence as sq

c = F.col
CHUNK, OVERLAP = 65_536, 1_024
#: The bindings of GTF features and attributes, alternatives separated by |.
GTF_FEATURES = {"gene_name": "gene_name|gene_id", "gene_id": "gene_id", "transcript_id": "transcript_id", "feature_exon": "exon", "feature_CDS": "CDS"}
#: Contigs of interest and viral contigs, with wildcards.
INTERESTING, VIRAL = "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20 21 22 X Y AC_* NC_*", "AC_* NC_*"


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("value"))


def tsv(spark: SparkSession, path: str, columns: str, comment: str = "#") -> DataFrame:
    """columns: names with types, as "contig string, start int"; a field that doesn't parse, or is missing, is null and the row's malformed is true."""
    d = lines(spark, path).where(~c("value").startswith(comment) & (c("value") != "")).withColumn("f", F.split("value", "\t", -1))
    fields = [x.split() for x in columns.split(",")]
    raw = [F.get("f", F.lit(i)) for i in range(len(fields))]
    out = [F.expr(f"try_cast(get(f, {i}) as {t})").alias(n) for i, (n, t) in enumerate(fields)]
    bad = F.lit(False)
    for r, (i, (_, t)) in zip(raw, enumerate(fields)):
        bad = bad | r.isNull() | F.expr(f"try_cast(get(f, {i}) as {t}) is null")
    return d.select(*out, bad.alias("malformed"))


def parse_bindings(text: str) -> dict[str, str]:
    """Bindings like "gene_name=gene_name|gene_id gene_id=gene_id ...": all five keys are needed."""
    out = dict(x.split("=", 1) for x in text.replace(",", " ").split())
    if missing := GTF_FEATURES.keys() - out.keys():
        raise ValueError(f"missing GTF features: {', '.join(sorted(missing))}")
    if unknown := out.keys() - GTF_FEATURES.keys():
        raise ValueError(f"unknown GTF features: {', '.join(sorted(unknown))}")
    return out


def fasta(spark: SparkSession, path: str, interesting: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """contig, original_name, length, chunk_no, start (0-based), seq: upper-case chunks that overlap, so no row of a join holds a whole contig."""
    d = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("value")).where(F.trim("value") != "")
    d = d.select(F.regexp_extract("value", r"^(\S+)", 1).alias("original_name"), F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")).alias("seq"))
    d = d.withColumn("contig", sq.strip_chr(c("original_name"))).withColumn("length", F.length("seq"))
    if interesting:
        d = d.where(c("contig").rlike(sq.wildcard_regex(interesting)))
    starts = F.sequence(F.lit(0), F.greatest(c("length") - 1, F.lit(0)), F.lit(chunk))
    out = d.select("*", F.posexplode(starts).alias("chunk_no", "start"))
    return out.select("contig", "original_name", "length", "chunk_no", "start", F.substring("seq", c("start") + 1, F.lit(chunk + overlap)).alias("seq"))


def bases(points: DataFrame, assembly: DataFrame, contig: str, start: str, length: int, name: str, chunk: int = CHUNK) -> DataFrame:
    """Adds the reference sequence of length from a 0-based start; an equi-join by chunk. length may not pass the chunks' overlap."""
    a = assembly.select(c("contig").alias("__c"), c("chunk_no").alias("__n"), c("start").alias("__s"), "seq")
    d = points.withColumn("__k", F.floor(c(start) / chunk).cast("int"))
    return d.join(a, (c(contig) == c("__c")) & (c("__k") == c("__n")), "left").withColumn(name, F.substring("seq", c(start) - c("__s") + 1, F.lit(length))).drop("__c", "__n", "__s", "__k", "seq")


def gtf(spark: SparkSession, path: str, bindings: dict[str, str] | None = None) -> DataFrame:
    """feature (exon or CDS), contig, start, end (0-based, inclusive), strand (true: forward), gene_name, gene_id, gene_key, transcript_id. Rows without an attribute are left out."""
    b = bindings or GTF_FEATURES
    d = tsv(spark, path, "contig string, source string, kind string, start int, end int, score string, strand string, frame string, attributes string")
    exon, cds = b["feature_exon"].split("|"), b["feature_CDS"].split("|")
    d = d.where(~c("malformed") & c("kind").isin(*exon, *cds))
    out = d.select(
        F.when(c("kind").isin(*exon), F.lit("exon")).otherwise(F.lit("CDS")).alias("feature"),
        sq.strip_chr(c("contig")).alias("contig"),
        (c("start") - 1).alias("start"),
        (c("end") - 1).alias("end"),
        (c("strand") == "+").alias("strand"),
        *[sq.gtf_attribute(c("attributes"), b[k]).alias(k) for k in ("gene_name", "gene_id", "transcript_id")],
    )
    return out.dropna(subset=["gene_name", "gene_id", "transcript_id"]).withColumn("gene_key", sq.strip_version(c("gene_id")))


def protein_domains(spark: SparkSession, path: str) -> DataFrame:
    """contig, start, end (0-based), strand, name, gene_id, gene_name of a GFF3 file."""
    d = tsv(spark, path, "contig string, source string, kind string, start int, end int, score string, strand string, frame string, attributes string")
    a = c("attributes")
    out = d.where(~c("malformed")).select(
        sq.strip_chr(c("contig")).alias("contig"), (c("start") - 1).alias("start"), (c("end") - 1).alias("end"), (c("strand") == "+").alias("strand"),
        sq.domain_name(sq.gff3_attribute(a, "Name")).alias("name"), sq.strip_version(sq.gff3_attribute(a, "gene_id")).alias("gene_id"), sq.gff3_attribute(a, "gene_name").alias("gene_name"),
    )
    return out.dropna(subset=["name", "gene_id", "gene_name"])


def sam(spark: SparkSession, path: str) -> DataFrame:
    """One row a record: qname, flag, contig (null for *), pos (0-based), cigar, mate_contig, mate_pos, seq, hi (hit index), has_sa."""
    d = lines(spark, path).where(~c("value").startswith("@")).withColumn("f", F.split("value", "\t", -1)).where(F.size("f") >= 11)
    g = lambda i: F.get("f", F.lit(i))
    name = lambda x: sq.strip_chr(F.nullif(x, F.lit("*")))
    return d.select(
        g(0).alias("qname"), g(1).cast("int").alias("flag"), name(g(2)).alias("contig"), (g(3).cast("int") - 1).alias("pos"), g(5).alias("cigar"),
        F.when(g(6) == "=", name(g(2))).otherwise(name(g(6))).alias("mate_contig"), (g(7).cast("int") - 1).alias("mate_pos"), F.upper(g(9)).alias("seq"),
        F.nullif(F.regexp_extract("value", r"\tHI:i:(\d+)", 1), F.lit("")).cast("int").alias("hi"), F.contains("value", F.lit("\tSA:Z:")).alias("has_sa"),
    )


def contig_lengths(spark: SparkSession, path: str) -> DataFrame:
    """contig, length of a SAM file's header; none without one."""
    d = lines(spark, path).where(c("value").startswith("@SQ\t"))
    tag = lambda x: F.regexp_extract("value", rf"\t{x}:([^\t]+)", 1)
    return d.select(sq.strip_chr(tag("SN")).alias("contig"), tag("LN").cast("bigint").alias("length"))


def breakpoint_contig(text: Column) -> Column:
    """The part before the last colon."""
    return sq.strip_chr(F.regexp_extract(text, r"^(.*):([^:]*)$", 1))


def breakpoint_position(text: Column) -> Column:
    """The 0-based position after the last colon; null if it is no number."""
    return F.try_to_number(F.regexp_extract(text, r":(\d+)$", 1), F.lit("9999999999")).cast("int") - 1


def direction(text: Column) -> Column:
    return F.when(text.isin("upstream", "-"), F.lit("upstream")).when(text.isin("downstream", "+"), F.lit("downstream"))


def info(text: Column, key: str) -> Column:
    return F.nullif(F.regexp_extract(text, rf"(?:^|;){key}=([^;]*)", 1), F.lit(""))


def structural_variants(spark: SparkSession, path: str) -> DataFrame:
    """contig1, pos1, dir1, contig2, pos2, dir2, the lesser side first. Lines of four columns, or VCF records that PASS: BND, DEL, DUP, INV (two rows)."""
    d = lines(spark, path).where(~c("value").startswith("#") & (c("value") != "")).withColumn("f", F.split("value", "\t", -1))
    g = lambda i: F.get("f", F.lit(i))
    four = d.where(F.size("f") == 4).select(
        F.struct(breakpoint_contig(g(0)).alias("contig"), breakpoint_position(g(0)).alias("pos"), direction(g(2)).alias("dir")).alias("a"),
        F.struct(breakpoint_contig(g(1)).alias("contig"), breakpoint_position(g(1)).alias("pos"), direction(g(3)).alias("dir")).alias("b"),
    )
    v = d.where((F.size("f") >= 8) & (g(6) == "PASS")).select(sq.strip_chr(g(0)).alias("contig"), (g(1).cast("int") - 1).alias("pos"), g(4).alias("alt"), info(g(7), "SVTYPE").alias("kind"), (info(g(7), "END").cast("int") - 1).alias("end"))
    mate = F.regexp_extract("alt", r"[\[\]](.*)[\[\]]", 1)
    side = lambda contig, pos, way: F.struct(contig.alias("contig"), pos.alias("pos"), way.alias("dir"))
    way = lambda x: F.when(x, F.lit("upstream")).otherwise(F.lit("downstream"))
    # a bracket before the bases: what lies after this position is joined; the bracket's kind says which side of the mate is
    bnd = v.where((c("kind") == "BND") & (mate != "")).select(
        side(c("contig"), c("pos"), way(c("alt").rlike(r"^[\[\]]"))).alias("a"), side(breakpoint_contig(mate), breakpoint_position(mate), way(F.contains("alt", F.lit("[")))).alias("b")
    )
    two = lambda x, y: F.struct(side(c("contig"), c("pos"), F.lit(x)).alias("a"), side(c("contig"), c("end"), F.lit(y)).alias("b"))
    down, up = "downstream", "upstream"
    kinds = F.when(c("kind") == "DEL", F.array(two(down, up))).when(c("kind") == "DUP", F.array(two(up, down))).when(c("kind") == "INV", F.array(two(down, down), two(up, up)))
    other = v.where(c("kind").isin("DEL", "DUP", "INV") & c("end").isNotNull()).select(F.explode(kinds).alias("s")).select("s.a", "s.b")
    both = four.unionByName(bnd).unionByName(other)
    ordered = both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    out = ordered.select(*[c(f"{s}.{k}").alias(f"{k}{i}") for i, s in ((1, "a"), (2, "b")) for k in ("contig", "pos", "dir")])
    return out.dropna()


#: Keywords that may stand for a region in a block list.
KEYWORDS = ("any", "split_read_donor", "split_read_acceptor", "split_read_any", "discordant_mates", "read_through", "low_support", "filter_spliced", "not_both_spliced")


def region(text: Column, prefix: str, keywords: bool) -> list[Column]:
    """Columns of a region: kind (a keyword, range, position or gene), contig (with a trailing * as a prefix), start, end, strand, gene."""
    m = lambda i: F.nullif(F.regexp_extract(text, r"^([+-]?)([^:]+):(\d+)(?:-(\d+))?$", i), F.lit(""))
    is_range = m(2).isNotNull()
    kind = F.when(is_range & m(4).isNotNull(), F.lit("range")).when(is_range, F.lit("position"))
    if keywords:
        kind = F.when(text.isin(*KEYWORDS), text).otherwise(kind)
    kind = F.coalesce(kind, F.lit("gene"))
    start = m(3).cast("int") - 1
    return [
        kind.alias(f"{prefix}_kind"), sq.strip_chr(m(2)).alias(f"{prefix}_contig"), start.alias(f"{prefix}_start"), F.coalesce(m(4).cast("int") - 1, start).alias(f"{prefix}_end"),
        F.when(m(1) == "+", True).when(m(1) == "-", False).alias(f"{prefix}_strand"), F.when(kind == "gene", text).alias(f"{prefix}_gene"),
    ]


def rules(spark: SparkSession, path: str, keywords: bool = True, tagged: bool = False) -> DataFrame:
    """rule_id and the two regions (a_, b_) of a rule file of two columns, or three with a tag."""
    d = lines(spark, path).where(~c("value").startswith("#") & (c("value") != "")).withColumn("f", F.split("value", "\t", -1)).where(F.size("f") >= (3 if tagged else 2))
    g = lambda i: F.get("f", F.lit(i))
    tag = [sq.tag_name(g(2)).alias("tag")] if tagged else []
    return d.select(F.xxhash64("value").alias("rule_id"), *region(g(0), "a", False), *region(g(1), "b", keywords), *tag)


def fusion_table(spark: SparkSession, path: str) -> DataFrame:
    """gene1, gene2, contig1, bp1, contig2, bp2 (1-based), dir1, dir2, split, disc, type of a result table of either dialect (told by its first header name)."""
    d = spark.read.option("sep", "\t").option("header", True).csv(path)
    place = lambda x, i: F.regexp_extract(x, r"^(?:chr)?([^:]+):(\d+)", i)
    if d.columns[0] == "#FusionName":
        strand = lambda x: F.regexp_extract(x, r":([+-])$", 1)
        left, right = c("LeftBreakpoint"), c("RightBreakpoint")
        dir1 = F.when(strand(left) == "+", F.lit("downstream")).otherwise(F.lit("upstream"))
        dir2 = F.when(strand(right) == "+", F.lit("upstream")).otherwise(F.lit("downstream"))
        name = lambda x: F.regexp_replace(x, r"\^.*", "")
        kind = F.when(place(left, 1) != place(right, 1), F.lit("translocation")).when(dir1 == dir2, F.lit("inversion")).when((dir1 == "downstream") == (place(left, 2).cast("int") < place(right, 2).cast("int")), F.lit("deletion")).otherwise(F.lit("duplication"))
        return d.select(
            name(c("LeftGene")).alias("gene1"), name(c("RightGene")).alias("gene2"), place(left, 1).alias("contig1"), place(left, 2).cast("int").alias("bp1"), place(right, 1).alias("contig2"), place(right, 2).cast("int").alias("bp2"),
            dir1.alias("dir1"), dir2.alias("dir2"), c("JunctionReadCount").cast("int").alias("split"), c("SpanningFragCount").cast("int").alias("disc"), kind.alias("type"),
        )
    kind = F.regexp_extract("type", "^(translocation|duplication|deletion|inversion)", 1)
    return d.select(
        c("`#gene1`").alias("gene1"), "gene2", place(c("breakpoint1"), 1).alias("contig1"), place(c("breakpoint1"), 2).cast("int").alias("bp1"), place(c("breakpoint2"), 1).alias("contig2"), place(c("breakpoint2"), 2).cast("int").alias("bp2"),
        c("direction1").alias("dir1"), c("direction2").alias("dir2"), (c("split_reads1").cast("int") + c("split_reads2").cast("int")).alias("split"), c("discordant_mates").cast("int").alias("disc"), kind.alias("type"),
    )


def cytobands(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.option("sep", "\t").option("header", True).csv(path)
    return d.select(sq.strip_chr(c("contig")).alias("contig"), c("start").cast("int").alias("start"), c("end").cast("int").alias("end"), "name", "giemsa")


def gene_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a genePred table as GTF-like exon and CDS rows: exon lists exploded, CDS clipped, repeated transcript ids numbered, exon_number in transcript order."""
    d = tsv(spark, path, "bin int, transcript string, contig string, strand string, tx_start int, tx_end int, cds_start int, cds_end int, exons int, starts string, ends string, score string, gene string")
    w = Window.partitionBy("transcript").orderBy("contig", "tx_start", "tx_end", "starts")
    d = d.where(~c("malformed")).withColumn("copy", F.row_number().over(w))
    d = d.withColumn("transcript_id", F.when(c("copy") > 1, F.concat("transcript", F.lit("_"), c("copy"))).otherwise(c("transcript")))
    numbers = lambda x: F.transform(F.filter(F.split(x, ","), lambda y: y != ""), lambda y: y.cast("int"))
    e = d.select("transcript_id", "gene", "contig", "strand", "cds_start", "cds_end", F.posexplode(F.arrays_zip(numbers("starts").alias("s"), numbers("ends").alias("e"))).alias("i", "x"), F.size(numbers("starts")).alias("n"))
    e = e.withColumn("exon_number", F.when(c("strand") == "+", c("i") + 1).otherwise(c("n") - c("i")))
    row = lambda kind, a, b: F.struct(F.lit(kind).alias("feature"), (a + 1).alias("start"), b.alias("end"))
    a, b = F.greatest(c("x.s"), c("cds_start")), F.least(c("x.e"), c("cds_end"))
    both = F.filter(F.array(row("exon", c("x.s"), c("x.e")), row("CDS", a, b)), lambda r: r["start"] <= r["end"])
    return e.select("contig", "strand", "gene", "transcript_id", "exon_number", F.explode(both).alias("r")).select("contig", "strand", "gene", "transcript_id", "exon_number", "r.*")


def needs_realignment(records: DataFrame, contigs: str = INTERESTING, clip: int = 10) -> DataFrame:
    """Adds realign: a fragment goes to the aligner if a mate is unmapped, clipped at the fragment's end, discordant or on an unknown contig; both mates follow."""
    flag = lambda bit: c("flag").bitwiseAND(bit) > 0
    first = F.regexp_extract("cigar", r"^(\d+)[SH]", 1)
    last = F.regexp_extract("cigar", r"(\d+)[SH]$", 1)
    end = F.when(flag(16), last).otherwise(first)
    own = flag(4) | flag(8) | (F.coalesce(F.nullif(end, F.lit("")).cast("int"), F.lit(0)) >= clip) | (flag(1) & ~flag(2)) | ~F.coalesce(c("contig").rlike(sq.wildcard_regex(contigs)), F.lit(False))
    return records.withColumn("realign", F.max(own).over(Window.partitionBy("qname")))
