"""Genes, transcripts and exons from annotation rows, and their assignment to reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cigar
from ..functions import events as ev
from ..session import stored
from . import intervals

c = F.col
LONGEST = 3_000_000


def build(gtf: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """genes, transcripts and exons of sources.text.gtf() rows.

    A gene is one id without version on a contig and strand, from its first exon to its last; ids number genes by
    (contig, end, start, key). Genes and transcripts over 3 Mb are dropped. Exons carry their neighbours and coding part.
    """
    ex = gtf.where("feature = 'exon'")
    g = ex.groupBy("gene_key", "contig", "strand").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("gene_name").alias("name"), F.min("gene_id").alias("gene_id"))
    g = g.where(c("end") - c("start") <= LONGEST).withColumn("id", (F.row_number().over(Window.orderBy("contig", "end", "start", "gene_key")) - 1).cast("bigint"))
    cds = gtf.where("feature = 'CDS'").select(c("transcript_id").alias("t"), c("contig").alias("cc"), c("strand").alias("cs"), c("start").alias("c0"), c("end").alias("c1"))
    hit = (c("transcript_id") == c("t")) & (c("contig") == c("cc")) & (c("strand") == c("cs")) & (c("start") <= c("c1")) & (c("end") >= c("c0"))
    key = ["gene_key", "contig", "strand", "transcript_id", "start", "end"]
    coded = ex.select(*key).distinct().join(cds, hit, "left").groupBy(*key).agg(F.max(F.when(c("c0").isNotNull(), F.struct(F.greatest("start", "c0").alias("a"), F.least("end", "c1").alias("b")))).alias("cds"))
    # of several coding parts of one exon the last one counts, whole
    coded = coded.select(*key, c("cds.a").alias("coding_start"), c("cds.b").alias("coding_end"))
    w = Window.partitionBy("transcript_id", "contig", "strand").orderBy("end", "start")
    e = coded.join(g.select("gene_key", "contig", "strand", c("id").alias("gene")), ["gene_key", "contig", "strand"])
    e = e.withColumns({"exon_rank": F.row_number().over(w), "n_exons": F.count("*").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "prev_end": F.lag("end").over(w), "next_start": F.lead("start").over(w)})
    t = e.groupBy("transcript_id", "contig", "strand", "gene").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum(F.coalesce(c("coding_end") - c("coding_start") + 1, F.lit(0))).alias("coding_length"))
    t = t.where(c("end") - c("start") <= LONGEST)
    e = e.join(t.select("transcript_id", "contig", "strand"), ["transcript_id", "contig", "strand"], "left_semi")
    coding = e.where("coding_start is not null").select(c("gene").alias("id")).distinct().withColumn("is_coding", F.lit(True))
    length = intervals.covered_length(e.select("gene", "start", "end"), ["gene"]).select(c("gene").alias("id"), c("length").alias("exonic_length"))
    g = g.join(coding, "id", "left").join(length, "id", "left").withColumn("is_coding", F.coalesce("is_coding", F.lit(False))).withColumn("is_dummy", F.lit(False)).withColumn("exonic_length", F.coalesce("exonic_length", c("end") - c("start")))
    return g, t, e


def genes_at(points: DataFrame, features: DataFrame, key: str, name: str, gene: str = "gene") -> DataFrame:
    """points (key, contig, pos) -> key, the sorted set of genes of the features that hold the position."""
    return intervals.point_join(points, features).groupBy(key).agg(F.array_sort(F.collect_set(gene)).alias(name))


def genes_of_ranges(df: DataFrame, features: DataFrame, key: str = "key", gene: str = "gene") -> DataFrame:
    """df (key, contig, start, end): adds genes: those at both ends, or at either if there is none at both; and exonic: whether any was hit."""
    a = genes_at(df.select(key, "contig", c("start").alias("pos")), features.select("contig", "start", "end", gene), key, "__a", gene)
    b = genes_at(df.select(key, "contig", c("end").alias("pos")), features.select("contig", "start", "end", gene), key, "__b", gene)
    none = F.array().cast("array<bigint>")
    d = df.join(a, key, "left").join(b, key, "left").withColumn("__a", F.coalesce("__a", none)).withColumn("__b", F.coalesce("__b", none))
    return d.withColumn("genes", intervals.combine(c("__a"), c("__b"))).withColumn("exonic", F.size("genes") > 0).drop("__a", "__b")


def dummy_genes(points: DataFrame, gap: int = 10_000, genes: DataFrame | None = None) -> DataFrame:
    """contig, start, end, island of positions without a gene: runs with steps of at most gap, none across a bound of a known gene."""
    d = points.select("contig", "pos").distinct()
    if genes is not None:
        edges = genes.select("contig", F.explode(F.array("start", "end")).alias("pos")).withColumn("__edge", F.lit(1))
        order = Window.partitionBy("contig").orderBy("pos", F.col("__edge").desc()).rowsBetween(Window.unboundedPreceding, 0)
        both = d.withColumn("__edge", F.lit(0)).unionByName(edges).withColumn("__before", F.sum("__edge").over(order))
        d = both.where("__edge = 0").select("contig", "pos", "__before")
        return intervals.islands(d, ["contig", "__before"], "pos", gap).groupBy("contig", "__before", "island").agg(F.min("pos").alias("start"), F.max("pos").alias("end")).drop("__before")
    d = intervals.islands(d, ["contig"], "pos", gap)
    return d.groupBy("contig", "island").agg(F.min("pos").alias("start"), F.max("pos").alias("end"))


PARTS = ("m1", "m2", "sp")
_NO_GENES = "array<bigint>"
#: So many splice sites at most are broadcast; of more, the junctions that ask for them are dealt out.
FEW_SITES = 200_000


def _parts(reads: DataFrame, where: str = "{p}_contig is not null") -> DataFrame:
    """One row a segment that passes: key (read key and segment), contig, start, end, strand."""
    fields = ("contig", "start", "end", "strand")
    each = [F.when(F.expr(where.format(p=p)), F.struct(F.lit(p).alias("p"), *(c(f"{p}_{f}").alias(f) for f in fields))) for p in PARTS]
    d = reads.select("read_key", F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("s"))
    return d.select(F.concat_ws("/", "read_key", c("s.p")).alias("key"), *(c(f"s.{f}").alias(f) for f in fields))


def _wide(parts: DataFrame, *values: str) -> DataFrame:
    """key and values, a row a segment -> read_key and m1_..., m2_..., sp_... with a leading __, a row a read."""
    d = parts.withColumns({"read_key": F.regexp_replace("key", "/[^/]*$", ""), "__p": F.substring("key", -2, 2)})
    return d.groupBy("read_key").agg(*(F.first(F.when(c("__p") == p, c(v)), ignorenulls=True).alias(f"__{p}_{v}") for p in PARTS for v in values))


def exon_genes(reads: DataFrame, exons: DataFrame) -> DataFrame:
    """reads with _genes of each segment, those whose exons hold both its ends (either, if none holds both), and _exonic: whether there are any."""
    hit = _wide(genes_of_ranges(_parts(reads), exons).where("exonic"), "genes")
    out = reads.join(hit, "read_key", "left")
    for p in PARTS:
        out = out.withColumns({f"{p}_genes": F.coalesce(f"__{p}_genes", F.array().cast(_NO_GENES)), f"{p}_exonic": c(f"__{p}_genes").isNotNull()}).drop(f"__{p}_genes")
    return out


def by_splice_sites(reads: DataFrame, genes: DataFrame, sites: DataFrame) -> DataFrame:
    """Genes and predicted strands of segments by the splice sites that their clips and skips meet, then by their mates.

    The first junction of a segment that is a site of some of its genes leaves these only; if they
    have one strand and the library tells none, that strand is the segment's. An equi-join on gene,
    direction and position, for segments of several genes or of unknown strand; sites are stored and
    counted, and only few are broadcast. Then mates infer from
    each other what one of them knows, and what they contradict each other in is unknown; a split read
    and its first mate share their genes.
    """
    asks = []
    for p in PARTS:
        asks_it = (F.size(f"{p}_ops") > 1) & (F.size(f"{p}_genes") > 0) & ((F.size(f"{p}_genes") > 1) | c(f"{p}_predicted").isNull())
        asks.append(F.when(asks_it, F.struct(F.lit(p).alias("p"), c(f"{p}_genes").cast(_NO_GENES).alias("own"), cigar.junctions(c(f"{p}_start"), c(f"{p}_ops")).alias("js"))))
    asked = reads.select("read_key", F.explode(F.filter(F.array(*asks), lambda x: x.isNotNull())).alias("s")).select("read_key", "s.p", "s.own", F.explode("s.js").alias("j"))
    asked = asked.select("read_key", "p", F.explode("own").alias("gene"), "j.*")
    site = stored(sites.select("gene", "direction", "pos").join(genes.select(c("id").alias("gene"), c("strand").alias("g_strand")), "gene"))
    site = F.broadcast(site) if site.count() <= FEW_SITES else site.hint("merge")
    # dealt by read once: the groups below are parts of it, and so is the join with the reads
    met = asked.join(site, ["gene", "direction", "pos"]).select("read_key", "p", "i", "gene", "g_strand").repartition("read_key")
    met = met.groupBy("read_key", "p", "i").agg(F.array_sort(F.collect_set("gene")).alias("met"), F.min("g_strand").alias("lo"), F.max("g_strand").alias("hi"))
    hit = [F.min_by(F.when(c("p") == p, F.struct("met", "lo", "hi")), F.when(c("p") == p, c("i"))).alias(f"__{p}_hit") for p in PARTS]
    met = met.groupBy("read_key").agg(*hit)
    d = reads.join(met, "read_key", "left")
    for p in PARTS:
        h = c(f"__{p}_hit")
        d = d.withColumn(f"{p}_genes", F.when(F.size(h["met"]) < F.size(f"{p}_genes"), h["met"]).otherwise(c(f"{p}_genes")))
        d = d.withColumn(f"{p}_predicted", F.when(c(f"{p}_predicted").isNull() & (h["lo"] == h["hi"]), h["lo"]).otherwise(c(f"{p}_predicted"))).drop(f"__{p}_hit")
    return shared_genes(mate_strands(d))


def mate_strands(reads: DataFrame) -> DataFrame:
    """Predicted strands (null: unknown) of first mate and second mate (or split read), then of split read and supplementary, each from the other."""
    unknown = F.lit(None).cast("boolean")
    a, b, s = c("m1_predicted"), c("m2_predicted"), c("sp_predicted")
    same = c("m1_strand") == c("m2_strand")
    odd = F.coalesce((a != b) != same, F.lit(False))
    d = reads.withColumns({"m1_predicted": F.when(odd, unknown).otherwise(F.coalesce(a, b != same)), "m2_predicted": F.when(odd, unknown).otherwise(F.coalesce(b, a != same))})
    flips = c("m2_strand") != c("sp_strand")
    odd = F.coalesce((b != s) != flips, F.lit(False))
    from_sp = c("is_split") & b.isNull() & s.isNotNull()
    return d.withColumns(
        {
            "m1_predicted": F.when(c("is_split") & odd, unknown).when(from_sp, s != flips).otherwise(a),
            "m2_predicted": F.when(c("is_split") & odd, unknown).when(from_sp, s != flips).otherwise(b),
            "sp_predicted": F.when(c("is_split") & ~odd, F.coalesce(s, b != flips)),
        }
    )


def shared_genes(reads: DataFrame) -> DataFrame:
    """A split read and its first mate keep the genes they share (all of both, if none); one without genes takes the other's."""
    both = intervals.combine(c("m2_genes"), c("m1_genes"))
    pick = lambda p: F.when(c("is_split") & ((F.size(f"{p}_genes") == 0) | (F.size("__both") < F.size(f"{p}_genes"))), F.array_sort("__both")).otherwise(c(f"{p}_genes"))
    return reads.withColumn("__both", both).withColumns({f"{p}_genes": pick(p) for p in ("m1", "m2")}).drop("__both")


def remaining_genes(reads: DataFrame, genes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments without an exon take the genes that hold them, and those without a gene a dummy gene; returns reads, and genes with the dummy ones.

    A dummy gene is a run of such breakpoints with steps of at most 10,000 between known genes.
    """
    bare = "{p}_contig is not null and size({p}_genes) = 0"

    def filled(d: DataFrame, found: DataFrame) -> DataFrame:
        d = d.join(_wide(found.select("key", "genes"), "genes"), "read_key", "left")
        for p in PARTS:
            d = d.withColumn(f"{p}_genes", F.when(F.size(f"{p}_genes") == 0, F.coalesce(f"__{p}_genes", f"{p}_genes")).otherwise(c(f"{p}_genes"))).drop(f"__{p}_genes")
        return shared_genes(d)

    held = genes_of_ranges(_parts(reads, bare), genes.withColumnRenamed("id", "gene")).where(F.size("genes") > 0)
    reads = filled(reads, held).checkpoint()
    # breakpoints: a split read's on the side of its clip, all others' where the fragment goes on
    at = F.when(c("strand") != (c("key").endswith("/m2") & c("__split")), c("end")).otherwise(c("start"))
    lost = _parts(reads, bare + " and not ('{p}' = 'm1' and is_split)").withColumn("read_key", F.regexp_replace("key", "/[^/]*$", ""))
    lost = lost.join(reads.select("read_key", c("is_split").alias("__split")), "read_key").withColumn("pos", at).select("key", "contig", "pos")
    islands = dummy_genes(lost, genes=genes)
    most = F.coalesce(F.lit(genes.agg(F.max("id")).first()[0]), F.lit(-1))
    extra = islands.withColumn("id", (most + F.row_number().over(Window.orderBy("contig", "start"))).cast("bigint"))
    dummies = extra.select("id", "contig", "start", "end", F.lit(True).alias("strand"), F.concat(F.lit("dummy_"), "id").alias("name"), F.lit(True).alias("is_dummy"), F.lit(False).alias("is_coding"), F.lit(10_000).cast("bigint").alias("exonic_length"))
    placed = intervals.point_join(lost, dummies.select("contig", "start", "end", c("id").alias("gene"))).groupBy("key").agg(F.array_sort(F.collect_set("gene")).alias("genes"))
    return filled(reads, placed), genes.unionByName(dummies, allowMissingColumns=True)


def site_label(df: DataFrame) -> DataFrame:
    """Adds site from dummy, inside, exonic, spliced, coding_gene, n_exons_here, n_coding_here, votes5, votes3."""
    site = (
        F.when(c("dummy") | ~c("inside"), F.lit("intergenic"))
        .when(~c("exonic") | (c("n_exons_here") == 0), F.lit("intron"))
        .when(~c("coding_gene"), F.lit("exon"))
        .when(c("n_coding_here") > 0, F.lit("CDS"))
        .when(c("votes3") > c("votes5"), F.lit("3'UTR"))
        .when(c("votes5") > c("votes3"), F.lit("5'UTR"))
        .when(c("votes3") + c("votes5") == 0, F.lit("exon"))
        .otherwise(F.lit("UTR"))
    )
    return df.withColumn("site", F.when(c("spliced") & ~site.isin("intron", "intergenic"), F.concat(site, F.lit("/splice-site"))).otherwise(site))


def exon_numbers(events: DataFrame, exons: DataFrame, transcript: str, pos: str, name: str, slack: int = 2) -> DataFrame:
    """Adds the number of the transcript's exon that holds a position within slack; the last match wins."""
    e = exons.select(c("transcript_id").alias("__t"), c("start").alias("__s"), c("end").alias("__e"), "exon_rank", "n_exons", c("strand").alias("__f"))
    number = F.when(c("__f"), c("exon_rank")).otherwise(c("n_exons") - c("exon_rank") + 1)
    hit = events.select("event_id", transcript, pos).join(e, (c(transcript) == c("__t")) & c(pos).between(c("__s") - slack, c("__e") + slack))
    n = hit.groupBy("event_id").agg(F.max_by(number, F.struct("__s", "__e")).alias(name))
    return events.join(n, "event_id", "left")


def retained_domains(events: DataFrame, domains: DataFrame, gene: str, pos: str, direction: str, name: str) -> DataFrame:
    """Adds the domains of the retained part of a gene as name(share%), by name; a dot if there are none."""
    d = domains.select(c("gene").alias("__g"), c("start").alias("__s"), c("end").alias("__e"), c("name").alias("__n"))
    j = events.select("event_id", gene, pos, direction).join(d, c(gene) == c("__g"))
    kept = F.when(c(direction) == "downstream", F.least("__e", pos) - c("__s") + 1).otherwise(c("__e") - F.greatest("__s", pos) + 1)
    s = j.groupBy("event_id", "__n").agg(F.sum(F.greatest(kept, F.lit(0))).alias("k"), F.sum(c("__e") - c("__s") + 1).alias("l")).where("k > 0")
    text = F.concat("__n", F.lit("("), F.floor(c("k") * 100 / c("l")).cast("string"), F.lit("%)"))
    out = s.groupBy("event_id").agg(F.array_join(F.array_sort(F.collect_list(text)), ",").alias(name))
    return events.join(out, "event_id", "left").withColumn(name, F.coalesce(name, F.lit(".")))


def assigned_domains(domains: DataFrame, genes: DataFrame) -> DataFrame:
    """Domains with their gene's id: by id without version, else by name; unknown genes are left out."""
    by_id = genes.select(c("gene_key").alias("gene_id"), c("id").alias("__i"))
    by_name = genes.groupBy(c("name").alias("gene_name")).agg(F.max("id").alias("__n"))
    return domains.join(by_id, "gene_id", "left").join(by_name, "gene_name", "left").withColumn("gene", F.coalesce("__i", "__n")).where(c("gene").isNotNull()).drop("__i", "__n")


def spliced_distance(exons: DataFrame, events: DataFrame, salts: int = 16) -> DataFrame:
    """event_id, spliced_distance of events within one gene or near each other's genes: the shortest walk from bp1 to bp2 over gene1's introns, greedily.

    A walk depends on its own earlier steps, so it is a grouped pandas function: one group is a part of a
    gene's breakpoint pairs and the gene's exons, which go to as many parts as there are.
    """
    import pandas as pd

    inside = ev.same_gene() | ev.overlaps_both_genes() | ev.is_intragenic()
    asks = events.where(inside).select("event_id", c("gene1").alias("gene"), F.least("bp1", "bp2").cast("bigint").alias("p"), F.greatest("bp1", "bp2").cast("bigint").alias("q"))
    pairs = asks.select("gene", "p", "q").distinct().withColumn("salt", F.pmod(F.xxhash64("p", "q"), F.lit(salts)))
    parts = pairs.select(c("gene").alias("of"), c("salt").alias("part")).distinct()
    e = exons.select(c("gene").alias("of"), "start", "end", "next_start").join(parts, "of")

    def walk(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        edges = sorted({*right["end"], *(right["start"] - 1)})
        rows = right.sort_values("start").to_dict("records")
        firsts = [x["start"] for x in rows]
        return left[["gene", "p", "q"]].assign(spliced_distance=[greedy_distance(a, b, edges, rows, firsts) for a, b in zip(left["p"], left["q"])])

    got = pairs.groupBy("gene", "salt").cogroup(e.groupBy("of", "part")).applyInPandas(walk, "gene bigint, p bigint, q bigint, spliced_distance bigint")
    return asks.join(got, ["gene", "p", "q"]).select("event_id", "spliced_distance")


def greedy_distance(p: int, q: int, edges: list[int], exons: list[dict], firsts: list[int] | None = None) -> int:
    """From one exon boundary to the next, take the intron that spares most and ends before q. firsts: the starts of exons, if these are sorted by them."""
    from bisect import bisect_left, bisect_right

    i, total = bisect_left(edges, p), 0
    if i < len(edges) and edges[i] < q:
        total, p = edges[i] - p, edges[i]
    while i < len(edges) and edges[i] < q:
        at = edges[i]
        if at >= p:
            best = None
            for x in exons if firsts is None else exons[: bisect_right(firsts, at)]:
                nxt = x["next_start"]
                if x["start"] <= at <= x["end"] and nxt == nxt and nxt is not None and nxt <= q:
                    s, e = max(p, x["start"]), min(q, x["end"])
                    skip = nxt - s + 1
                    if best is None or (e - s) / skip < (best[1] - best[0]) / best[2]:
                        best = (s, e, skip)
            if best:
                total += best[1] - best[0] + 1
                p = best[0] + best[2] - 1
        i += 1
    return int(total + q - p)


def intronic_fraction(genes: DataFrame) -> Column:
    return 1 - c("exonic_length") / (c("end") - c("start") + 1)
