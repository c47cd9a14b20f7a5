"""From alignment records to reads: one row a chimeric fragment with flat segment columns (m1_, m2_, sp_)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cigar

c = F.col
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, FIRST, SECONDARY, DUPLICATE, SUPPLEMENTARY = 1, 2, 4, 8, 16, 64, 256, 1024, 2048
FIELDS = ("contig", "start", "end", "strand", "ops", "seq", "first")


def has(bit: int) -> Column:
    return c("flag").bitwiseAND(bit) > 0


def segments(records: DataFrame) -> DataFrame:
    """Mapped records with read_key (name and hit index), read_group, parsed CIGAR, end, strand. Secondary records without a hit index are left out."""
    d = records.where(~has(UNMAPPED) & c("contig").isNotNull() & ~(has(PAIRED) & has(MATE_UNMAPPED)) & ~(has(SECONDARY) & c("hi").isNull()))
    d = d.withColumn("ops", cigar.parse(c("cigar")))
    return d.select(
        F.concat_ws(",", "qname", F.coalesce("hi", F.lit(1))).alias("read_key"), c("qname").alias("read_group"), "flag", "contig", c("pos").alias("start"), (c("pos") + cigar.reference_length(c("ops")) - 1).alias("end"),
        (~has(REVERSE)).alias("strand"), "ops", "seq", (has(FIRST) | ~has(PAIRED)).alias("first"), has(SUPPLEMENTARY).alias("supplementary"), has(PAIRED).alias("paired"), has(PROPER).alias("proper"), has(DUPLICATE).alias("dup_flag"), "has_sa",
    )


def clipped_at_end(ops: Column, strand: Column, least: int = 1) -> Column:
    """Whether a segment is clipped on the side where its fragment goes on."""
    return F.when(strand, cigar.preclip(ops)).otherwise(cigar.postclip(ops)) >= least


def route(seg: DataFrame) -> DataFrame:
    """Adds route: supplementary, discordant, split (has a supplementary), or proper."""
    kind = F.when(c("supplementary"), F.lit("supplementary")).when(c("has_sa"), F.lit("split")).when(c("paired") & ~c("proper"), F.lit("discordant")).otherwise(F.lit("proper"))
    return seg.withColumn("route", kind)


def reads(seg: DataFrame) -> DataFrame:
    """Well-formed chimeric fragments: discordant pairs of two segments, split reads of three, or of two if single-ended.

    The shuffle is by read key; a key has a few records, and those with more than three are malformed.
    Split reads: one supplementary; the split read is the segment of the same mate; the first mate
    lies on the other strand of its contig. Hard clips are allowed on the supplementary only.
    """
    keep = Window.partitionBy("read_key")
    d = route(seg).withColumns(
        {
            "__any": F.max(c("route") != "proper").over(keep),
            "__n": F.count("*").over(keep),
            "__sp": F.sum(c("supplementary").cast("int")).over(keep),
            "__paired": F.max("paired").over(keep),
            "__mate": F.max(F.when(c("supplementary"), c("first"))).over(keep),
        }
    ).where("__any and ((__paired and __n = 3 and __sp = 1) or (not __paired and __n = 2 and __sp = 1) or (__paired and __n = 2 and __sp = 0))")
    split = c("__sp") == 1
    role = (
        F.when(c("supplementary"), F.lit("sp"))
        .when(split & c("__paired"), F.when(c("first") == c("__mate"), F.lit("m2")).otherwise(F.lit("m1")))
        .when(split, F.lit("m2"))
        .otherwise(F.when(c("first"), F.lit("m1")).otherwise(F.lit("m2")))
    )
    row = F.struct(*[c(f) for f in FIELDS])
    one = lambda r: F.first(F.when(c("role") == r, row), ignorenulls=True).alias(r)
    g = d.withColumn("role", role).groupBy("read_key", "read_group").agg(
        F.first(split).alias("is_split"), F.first(split & ~c("__paired")).alias("single_end"), F.max(F.when(c("role") != "sp", c("dup_flag"))).alias("dup_flag"), one("m1"), one("m2"), one("sp")
    )
    g = g.withColumn("m1", F.when(c("single_end"), c("m2")).otherwise(c("m1"))).where("m1 is not null and m2 is not null")
    hard = lambda p: F.exists(c(f"{p}.ops"), lambda o: o["op"] == "H")
    mates = (c("m1.contig") == c("m2.contig")) & (c("m1.strand") != c("m2.strand"))
    sound = ~c("is_split") | c("single_end") | (clipped_at_end(c("sp.ops"), ~c("sp.strand")) & mates)
    g = g.where(sound & ~hard("m1") & ~hard("m2"))
    out = g.select("read_key", "read_group", "is_split", "single_end", "dup_flag", *[c(f"{p}.{f}").alias(f"{p}_{f}") for p in ("m1", "m2", "sp") for f in FIELDS])
    # a single-ended read's first mate is a copy that faces the split read
    return disjoint(out.withColumn("m1_strand", F.when(c("single_end"), ~c("m2_strand")).otherwise(c("m1_strand"))).withColumn("fate", F.lit("none")))


def disjoint(df: DataFrame, least: int = 10) -> DataFrame:
    """Split reads whose segments overlap in the read by so much that too little of the supplementary would be left are malformed."""
    n = F.length("m2_seq")
    kept = lambda p: n - cigar.preclip(c(f"{p}_ops")) - cigar.postclip(c(f"{p}_ops"))
    overlap = F.greatest(kept("m2") + kept("sp") - n, F.lit(0))
    return df.where(~c("is_split") | (kept("sp") - overlap >= least))


def read_through(seg: DataFrame, genes: DataFrame) -> DataFrame:
    """Fragments of proper alignments that begin and end in different genes, in the columns of reads(). genes: (contig, start, end, id).

    A mate with a skip that spans the end of the first gene or the start of the second becomes a split
    read and its supplementary, cut at the skip; if both mates have one, the mate whose anchor behind
    the skip is longer is split, and the other is clipped at its skip. Without a skip, mates that lie
    each within their genes are a discordant pair; mates that merely reach out of a gene are left out.
    Of a fragment only its ends are shuffled and looked up; its segments are joined once it has passed.
    """
    from .intervals import point_join

    own = route(seg)
    ends = own.groupBy("read_key").agg(
        F.max(c("route") != "proper").alias("__odd"), F.first("contig").alias("contig"), F.count(F.when(c("strand"), 1)).alias("__f"), F.count(F.when(~c("strand"), 1)).alias("__r"),
        F.min(F.when(c("strand"), c("start"))).alias("fs"), F.max(F.when(c("strand"), c("end"))).alias("fe"), F.min(F.when(~c("strand"), c("start"))).alias("rs"), F.max(F.when(~c("strand"), c("end"))).alias("re"),
        F.max("paired").alias("__paired"),
    )
    ends = ends.where("not __odd and ((__paired and __f = 1 and __r = 1) or (not __paired and __f + __r = 1))")
    points = ends.select("read_key", "contig", F.explode(F.array(F.struct(F.lit("f").alias("side"), F.coalesce("fs", "rs").alias("pos")), F.struct(F.lit("r").alias("side"), (F.coalesce("re", "fe") + 1).alias("pos")))).alias("p")).select("read_key", "contig", "p.*")
    of = lambda side, what: F.when(c("side") == side, what)
    g = point_join(points, genes.select("contig", c("start").alias("g_start"), c("end").alias("g_end"), "id"), start="g_start", end="g_end")
    g = g.groupBy("read_key").agg(
        F.collect_set(of("f", c("id"))).alias("__fg"), F.collect_set(of("r", c("id"))).alias("__rg"), F.max(of("f", c("g_end"))).alias("__e"), F.min(of("r", c("g_start"))).alias("__s"),
    ).where(~F.arrays_overlap("__fg", "__rg"))
    g = g.select("read_key", F.coalesce("__e", c("__s") - 1).cast("int").alias("end1"), F.coalesce("__s", c("__e") + 1).cast("int").alias("start2"))
    passed = ends.select("read_key", "__paired").join(g, "read_key")
    side = lambda p, forward: F.first(F.when(c("strand") == forward, F.struct(*(c(x) for x in FIELDS))), ignorenulls=True).alias(p)
    d = own.join(passed, "read_key").groupBy("read_key", "read_group", "__paired", "end1", "start2").agg(side("f", True), side("r", False), F.max("dup_flag").alias("dup_flag"))
    hit = lambda p: cigar.spanning_intron(c(f"{p}.start"), c(f"{p}.ops"), c("end1"), c("start2"))
    d = d.withColumns({"fh": hit("f"), "rh": hit("r")})
    forward = c("fh").isNotNull() & (c("rh").isNull() | (c("fh.q") < F.length("r.seq") - c("rh.q")))
    d = d.withColumn("kind", F.when(forward, F.lit("forward")).when(c("rh").isNotNull(), F.lit("reverse")).when((c("r.start") >= c("start2")) & (c("f.end") + 1 <= c("end1")), F.lit("pair"))).where("kind is not null")
    whole = lambda p: F.struct(*(c(f"{p}.{x}").alias(x) for x in FIELDS))
    after = lambda p: whole(p).withField("start", c(f"{p}h.after")).withField("ops", cigar.from_intron(c(f"{p}.ops"), c(f"{p}h")))
    before = lambda p: whole(p).withField("end", c(f"{p}h.at") - 1).withField("ops", cigar.to_intron(c(f"{p}.ops"), c(f"{p}h"), F.length(c(f"{p}.seq"))))
    kind, single = c("kind"), ~c("__paired")
    d = d.withColumns(
        {
            "m2": F.when(kind == "forward", after("f")).when(kind == "reverse", before("r")).otherwise(whole("r")),
            "sp": F.when(kind == "forward", before("f")).when(kind == "reverse", after("r")),
            "m1": F.when(kind == "pair", whole("f")).when(kind == "forward", F.when(c("rh").isNotNull(), after("r")).otherwise(whole("r"))).otherwise(F.when(c("fh").isNotNull(), before("f")).otherwise(whole("f"))),
        }
    )
    # a single-ended read's first mate is a copy that faces the split read
    d = d.withColumn("m1", F.when(single, c("m2").withField("strand", ~c("m2.strand"))).otherwise(c("m1")))
    return d.select("read_key", "read_group", (kind != "pair").alias("is_split"), (single & (kind != "pair")).alias("single_end"), "dup_flag", *[c(f"{p}.{f}").alias(f"{p}_{f}") for p in ("m1", "m2", "sp") for f in FIELDS], F.lit("none").alias("fate"))


def tandem_duplications(clips: DataFrame, longest: int = 100) -> DataFrame:
    """clips (read_key, clip, window, window_start) -> those whose clip aligns within the window: adds itd_start, itd_score.

    The first place with at most one mismatch after the first six bases that are equal, and at least 15 matches or all of
    a clip of 12 or more. Sequences are short, so the search is a higher-order expression.
    """
    n, w = F.length("clip"), F.length("window")
    places = F.when(w >= n, F.sequence(F.lit(1), w - n + 1)).otherwise(F.array().cast("array<int>"))
    score = lambda i: F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, k: a + (F.substring("clip", k, F.lit(1)) == F.substring("window", i + k - 1, F.lit(1))).cast("int"))
    hits = F.filter(places, lambda i: (F.substring("clip", F.lit(1), F.lit(6)) == F.substring("window", i, F.lit(6))) & (score(i) >= n - 1) & ((score(i) >= 15) | (score(i) == n)))
    d = clips.where((n >= 12) & (n <= longest)).withColumn("__i", F.get(hits, F.lit(0))).where(c("__i").isNotNull())
    return d.withColumn("itd_start", c("window_start") + c("__i") - 1).withColumn("itd_score", score(c("__i"))).drop("__i")


def is_pristine(ops: Column, seq: Column) -> Column:
    """No clip or indel, and no tandem of two or three bases eight times over."""
    return ~F.exists(ops, lambda o: o["op"].isin("S", "H", "I", "D")) & ~seq.rlike(r"(..)\1{7}|(...)\2{7}")


def assign_strands(df: DataFrame, strandedness: str) -> DataFrame:
    """Predicted strands from the library type (yes, reverse, no): the supplementary follows the split read; with no, they are null."""
    base = lambda p: c(f"{p}_strand") == c(f"{p}_first") if strandedness == "yes" else c(f"{p}_strand") != c(f"{p}_first")
    if strandedness == "no":
        return df.withColumns({f"{p}_predicted": F.lit(None).cast("boolean") for p in ("m1", "m2", "sp")})
    flips = c("m2_strand") != c("sp_strand")
    return df.withColumns({"m1_predicted": base("m1"), "m2_predicted": base("m2"), "sp_predicted": F.when(c("is_split"), base("m2") != flips)})


def mapped_reads(seg: DataFrame, interesting: str) -> DataFrame:
    return seg.where(~c("supplementary") & c("contig").rlike(interesting)).agg(F.count("*").alias("mapped_reads"))
