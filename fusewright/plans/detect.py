"""The whole chain: alignments and annotation in, ranked events out. Stages are declared; the plan is cut at the pivot and before the sinks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cigar
from ..functions import events as ev
from ..functions import sequence as sq
from ..operators import annotate, assemble, fate, intervals, pivot, stats
from ..operators import event_filters as ef
from ..operators import read_filters as rf
from ..operators import rules as rule_steps
from ..session import shared_dir
from ..sources import bam, sinks, text

c = F.col


#: Fates of split reads that tandem duplications get back.
SPARED = ("hairpin", "inconsistently_clipped", "mismatches")
#: Options of steps that detect() doesn't call yet; other values than the defaults are refused.
IDLE = ("mismappers", "homologs", "mismatch_p", "quantile")


@dataclass(frozen=True)
class Options:
    """Thresholds and switches; out-of-range values are errors."""

    interesting: str = text.INTERESTING
    viral: str = text.VIRAL
    disabled: frozenset[str] = field(default_factory=frozenset)
    evalue: float = 0.3
    support: int = 2
    mismappers: float = 0.8
    homologs: float = 0.3
    anchor: int = 23
    homopolymer: int = 6
    sv_distance: int = 100_000
    read_through: int = 10_000
    kmer_content: float = 0.6
    fragment_length: int = 200
    strandedness: str = "auto"
    spliced_events: int = 4
    mismatch_p: float = 0.01
    cap: int = 300
    quantile: float = 0.998
    exonic_fraction: float = 0.33
    top_viruses: int = 5
    covered_fraction: float = 0.05
    itd_length: int = 100
    itd_fraction: float = 0.07
    itd_support: int = 10

    def __post_init__(self) -> None:
        for name in ("evalue", "mismatch_p"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")
        for name in ("mismappers", "homologs", "kmer_content", "quantile", "exonic_fraction", "covered_fraction", "itd_fraction"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must lie between 0 and 1")
        for name in ("support", "anchor", "homopolymer", "sv_distance", "read_through", "fragment_length", "cap", "itd_length", "itd_support"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")
        if self.strandedness not in ("auto", "yes", "no", "reverse"):
            raise ValueError("strandedness is auto, yes, no or reverse")
        if self.homopolymer < 1:
            raise ValueError("homopolymer must be positive")
        for name in IDLE:
            if getattr(self, name) != getattr(Options, name):
                raise ValueError(f"{name} has no effect yet: the chain doesn't call its step")

    def on(self, step: str) -> bool:
        return step not in self.disabled


def filtered_reads(reads: DataFrame, opt: Options, viral: Sequence[tuple[str, DataFrame]] = ()) -> DataFrame:
    """The read-level steps in order. Predicates that follow each other are one projection. viral: names of steps and the contigs whose reads they discard."""
    d = rf.duplicate_key(reads)
    if opt.on("duplicates"):
        d = rf.mark_duplicates(d, ["contig1", "contig2", "pos1", "pos2"])
    d = rf.mark_multimappers(d.drop("contig1", "contig2", "pos1", "pos2"))
    known, pattern = sq.wildcard_regex(opt.interesting), sq.wildcard_regex(opt.viral)
    odd = ~c("m1_contig").rlike(known) | ~c("m2_contig").rlike(known) | F.coalesce(~c("sp_contig").rlike(known), F.lit(False))
    d = fate.discard_all(d, [(n, p) for n, p in (("uninteresting_contigs", odd), ("viral_contigs", rf.viral_only(pattern))) if opt.on(n)])
    for name, contigs in viral:
        if opt.on(name):
            d = rf.discard_contigs(d, name, contigs)
    d = fate.discard_all(d, [(n, p) for n, p in rf.read_filters(opt.read_through, opt.homopolymer) if opt.on(n)])
    return rf.filter_low_entropy(d, opt.kmer_content) if opt.on("low_entropy") else d


def with_gene_bounds(reads: DataFrame, genes: DataFrame, sites: DataFrame) -> DataFrame:
    """Adds fw_gene_end and rv_gene_start of the segments' largest genes (-1 without any), and at_splice_site: whether a split read begins at a site of a gene of its own."""
    g = genes.select(c("id").alias("__id"), c("start").alias("__s"), c("end").alias("__e"))
    first = F.when(c("is_split"), F.when(~c("m2_strand"), c("m2_genes")).otherwise(c("sp_genes"))).otherwise(F.when(c("m1_strand"), c("m1_genes")).otherwise(c("m2_genes")))
    other = F.when(c("is_split"), F.when(~c("m2_strand"), c("sp_genes")).otherwise(c("m2_genes"))).otherwise(F.when(c("m1_strand"), c("m2_genes")).otherwise(c("m1_genes")))
    fw = reads.select("read_key", F.explode(first).alias("__id")).join(g, "__id").groupBy("read_key").agg(F.max("__e").alias("fw_gene_end"))
    rv = reads.select("read_key", F.explode(other).alias("__id")).join(g, "__id").groupBy("read_key").agg(F.min("__s").alias("rv_gene_start"))
    return reads.join(fw, "read_key", "left").join(rv, "read_key", "left").fillna(-1, ["fw_gene_end", "rv_gene_start"]).transform(lambda d: _at_splice_site(d, sites))


def _at_splice_site(reads: DataFrame, sites: DataFrame) -> DataFrame:
    way, pos = F.when(c("m2_strand"), F.lit(ev.UP)).otherwise(F.lit(ev.DOWN)), F.when(c("m2_strand"), c("m2_start")).otherwise(c("m2_end"))
    asks = reads.where("is_split").select("read_key", F.explode("m2_genes").alias("gene"), way.alias("direction"), pos.alias("pos"))
    hit = asks.join(sites, ["gene", "direction", "pos"], "left_semi").select("read_key").distinct().withColumn("at_splice_site", F.lit(True))
    return reads.join(hit, "read_key", "left").withColumn("at_splice_site", F.coalesce("at_splice_site", F.lit(False)))


def stranded(reads: DataFrame, genes: DataFrame, sites: DataFrame, kind: str) -> DataFrame:
    """Adds the predicted strands of the segments; auto asks the spliced split reads for the library's kind."""
    if kind == "auto":
        g = genes.select(c("id").alias("__id"), c("strand").alias("gene_strand"))
        kind = stats.strandedness(reads.where("is_split").withColumn("__id", F.get("m2_genes", F.lit(0))).join(g, "__id"), sites)
    return assemble.assign_strands(reads, kind)


def viral_steps(reads: DataFrame, seg: DataFrame, genes: DataFrame, lengths: DataFrame, cov: DataFrame, opt: Options) -> list[tuple[str, DataFrame]]:
    """The viral contigs whose reads go: weakly expressed ones, and those covered in few places. lengths (contig, length) of all contigs; none, no steps."""
    viral, known = sq.wildcard_regex(opt.viral), sq.wildcard_regex(opt.interesting)
    own = lengths.where(c("contig").rlike(viral))
    if own.isEmpty():
        return []
    expression = stats.viral_expression(seg.where(~c("supplementary") & c("contig").rlike(viral)).select("contig"), lengths).checkpoint()
    other = lambda f: F.when(c("is_split"), c(f"sp_{f}")).otherwise(c(f"m2_{f}"))
    ends = reads.select(*(F.struct(contig.alias("contig"), genes_.alias("genes")).alias(k) for k, contig, genes_ in (("a", c("m1_contig"), c("m1_genes")), ("b", other("contig"), other("genes")))))
    on = lambda k, p: c(f"{k}.contig").rlike(p)
    virus = F.when(on("b", viral), c("b.contig")).when(on("a", viral), c("a.contig"))
    host = F.when(on("b", known) & ~on("b", viral), c("b.genes")).when(on("a", known) & ~on("a", viral), c("a.genes"))
    sites = ends.select(virus.alias("contig"), F.explode(host).alias("gene")).where("contig is not null").join(genes.select(c("id").alias("gene"), F.coalesce("is_dummy", F.lit(False)).alias("is_dummy")), "gene")
    threshold = stats.viral_threshold(expression, opt.top_viruses).first()[0] or 0.0
    weak = stats.weak_viruses(expression, threshold, sites.select("contig", "gene", "is_dummy")).where(c("contig").rlike(viral))
    focal = stats.low_coverage_contigs(cov, own, opt.covered_fraction).select("contig")
    bare = own.join(cov.select("contig").distinct(), "contig", "left_anti").select("contig")
    return [("top_expressed_viral_contigs", weak.checkpoint()), ("low_coverage_viral_contigs", focal.union(bare).checkpoint())]


def same_coding_exon(events: DataFrame, exons: DataFrame, longest: int, slack: int = 7) -> DataFrame:
    """Adds whether both breakpoints of a short event in one gene lie in the coding part of one exon, give or take slack."""
    asks = events.where(ev.is_tandem_duplication(longest) & c("exonic1") & c("exonic2") & c("g1_coding")).select("event_id", c("gene1").alias("gene"), "bp1", "bp2")
    x = exons.where("coding_start is not null").select("gene", "coding_start", "coding_end")
    holds = lambda b: (c("coding_start") <= c(b) + slack) & (c("coding_end") + slack >= c(b))
    hit = asks.join(x, "gene").where(holds("bp1") & holds("bp2")).select("event_id").distinct().withColumn("same_coding_exon", F.lit(True))
    return events.join(hit, "event_id", "left").withColumn("same_coding_exon", F.coalesce("same_coding_exon", F.lit(False)))


def sides(reads: DataFrame) -> DataFrame:
    """One row for each pair of genes of a read: the columns that the pivot groups by, the lesser side first."""
    s2 = F.when(c("m2_strand"), c("m2_start")).otherwise(c("m2_end"))
    outer = lambda p: F.when(c(f"{p}_strand"), c(f"{p}_end")).otherwise(c(f"{p}_start"))
    inner = lambda p: F.when(c(f"{p}_strand"), c(f"{p}_start")).otherwise(c(f"{p}_end"))
    way = lambda p: F.when(c(f"{p}_strand"), F.lit(ev.DOWN)).otherwise(F.lit(ev.UP))
    back = F.when(c("m2_strand"), F.lit(ev.UP)).otherwise(F.lit(ev.DOWN))

    def side(contig: F.Column, pos: F.Column, d: F.Column, genes: F.Column, exonic: F.Column, start: F.Column, kind: str, p: str) -> F.Column:
        return F.struct(contig.alias("contig"), pos.alias("pos"), d.alias("dir"), genes.alias("genes"), exonic.alias("exonic"), start.alias("start"), F.lit(kind).alias("kind"), c(f"{p}_predicted").alias("forward"))

    a = F.when(c("is_split"), side(c("m2_contig"), s2, back, c("m2_genes"), c("m2_exonic"), inner("m1"), "a", "m2")).otherwise(side(c("m1_contig"), outer("m1"), way("m1"), c("m1_genes"), c("m1_exonic"), inner("m1"), "a", "m1"))
    b = F.when(c("is_split"), side(c("sp_contig"), outer("sp"), way("sp"), c("sp_genes"), c("sp_exonic"), inner("sp"), "b", "sp")).otherwise(side(c("m2_contig"), outer("m2"), way("m2"), c("m2_genes"), c("m2_exonic"), inner("m2"), "b", "m2"))
    d = reads.select("read_key", "read_group", "multimapper", "is_split", "fate", a.alias("x"), b.alias("y"))
    key = lambda s: F.struct(c(f"{s}.contig"), c(f"{s}.pos"))
    swapped = key("y") < key("x")
    d = d.withColumn("swapped", swapped).withColumn("lo", F.when(swapped, c("y")).otherwise(c("x"))).withColumn("hi", F.when(swapped, c("x")).otherwise(c("y")))
    d = d.withColumn("gene1", F.explode("lo.genes")).withColumn("gene2", F.explode("hi.genes"))
    role = F.when(~c("is_split"), F.lit("discordant")).when(c("swapped"), F.lit("split2")).otherwise(F.lit("split1"))
    return d.select(
        "read_key", "read_group", "multimapper", "fate", role.alias("role"), "gene1", "gene2",
        *[c(f"{s}.{f}").alias(f"{n}{i}") for i, s in ((1, "lo"), (2, "hi")) for f, n in (("contig", "contig"), ("pos", "bp"), ("dir", "dir"), ("exonic", "exonic"), ("start", "start"))], c("lo.forward").alias("forward"),
    )


def event_id() -> F.Column:
    return F.concat_ws(":", *pivot.EVENT)


def with_genes(events: DataFrame, genes: DataFrame) -> DataFrame:
    for i in (1, 2):
        g = genes.select(
            c("id").alias(f"gene{i}"), c("start").alias(f"g{i}_start"), c("end").alias(f"g{i}_end"), c("strand").alias(f"g{i}_strand"), c("is_dummy").alias(f"g{i}_dummy"), c("is_coding").alias(f"g{i}_coding"),
            c("name").alias(f"name{i}"), c("gene_id").alias(f"gene_id{i}"), c("exonic_length").cast("double").alias(f"l{i}"), annotate.intronic_fraction(genes).alias(f"g{i}_intronic_fraction"),
        )
        events = events.join(g, f"gene{i}")
    return events


def detect(spark: SparkSession, alignments: str, annotation: str, opt: Options = Options(), rules: DataFrame | None = None, variants: DataFrame | None = None, tags: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """Events with fate, confidence and labels; sinks.result_table() makes the 30 columns of those whose fate is none.

    rules, known and tags are rows of sources.text.rules(): the block list, the known pairs (5', 3') and the tagged ones.

    Dimensions, segments, reads and events are checkpointed in the shared folder: later steps read them several times, and their plans stay small.
    """
    shared_dir(spark)
    records = bam.bam(spark, alignments) if alignments.endswith(".bam") else text.sam(spark, alignments)
    genes, _, exons = annotate.build(text.gtf(spark, annotation))
    genes, exons, seg = genes.checkpoint(), exons.checkpoint(), assemble.segments(records).checkpoint()
    through = assemble.read_through(seg, genes).checkpoint()
    chimeric = assemble.reads(seg).unionByName(through).checkpoint()
    sites = intervals.splice_sites(exons).checkpoint()
    reads = stranded(annotate.exon_genes(chimeric, exons).checkpoint(), genes, sites, opt.strandedness)
    reads, genes = annotate.remaining_genes(annotate.by_splice_sites(reads, genes, sites), genes)
    genes, reads = genes.checkpoint(), reads.checkpoint()
    blocks = seg.where(~c("supplementary")).select(c("read_key").alias("fragment"), "contig", F.explode(cigar.blocks(c("start"), c("ops"))).alias("b"))
    cov = stats.coverage(blocks.select("fragment", "contig", c("b.s").alias("s"), (c("b.e") - 1).alias("e"))).checkpoint()
    lengths = (bam if alignments.endswith(".bam") else text).contig_lengths(spark, alignments)
    viral_fates = viral_steps(reads, seg, genes, lengths, cov, opt)
    reads = filtered_reads(with_gene_bounds(reads, genes, sites), opt, viral_fates)
    contigs = seg.select("contig").distinct()
    at_home = lambda r: None if r is None else rule_steps.located(r, genes.where(~F.coalesce("is_dummy", F.lit(False))), contigs).checkpoint()
    rules, tags, known = at_home(rules), at_home(tags), at_home(known)
    s = sides(reads).checkpoint()
    e = pivot.pivot_events(s, opt.cap).withColumn("event_id", event_id())
    own = s.withColumn("event_id", event_id())
    per = own.groupBy("event_id").agg(
        F.sum(F.when((c("fate") == fate.NONE) & ~c("multimapper"), 1).otherwise(0)).alias("unique_reads"),
        F.sum(F.when((c("fate") == fate.NONE) & (c("exonic1") | c("exonic2")), 1).otherwise(0)).alias("exonic_reads"),
        F.sum(F.when((c("role") != "discordant") & c("fate").isin(fate.NONE, *SPARED), 1).otherwise(0)).alias("all_split"),
        *(F.sum(F.when((c("role") == f"split{i}") & c("fate").isin(*SPARED), 1).otherwise(0)).alias(f"spared_split{i}") for i in (1, 2)),
        F.array_join(F.array_sort(F.collect_set("read_group")), ",").alias("read_identifiers"),
    )
    votes = stats.strand_vote(own.select("event_id", "role", "forward", c("fate").alias("read_fate")))
    pairs = s.where("role = 'discordant'").select("gene1", "gene2", "dir1", "dir2", c("bp1").alias("pos1"), c("bp2").alias("pos2"), "read_key")
    e = pivot.discordant_support(e, pairs, opt.fragment_length).withColumn("disc", F.greatest("disc", "near_pairs")).drop("near_pairs")
    e = with_genes(e.join(per, "event_id"), genes).join(votes, "event_id", "left").checkpoint()
    e = intervals.spliced(e, sites, "gene1", "dir1", "bp1", "spliced1")
    e = intervals.spliced(e, sites, "gene2", "dir2", "bp2", "spliced2")
    for i in (1, 2):  # depth on the retained side
        e = e.withColumn("__back", F.when(c(f"dir{i}") == ev.UP, F.lit(ev.DOWN)).otherwise(F.lit(ev.UP)))
        e = stats.depth_at(e, cov, f"contig{i}", f"bp{i}", "__back", f"cov{i}").drop("__back")
    viral = sq.wildcard_regex(opt.viral)
    e = e.withColumns({"viral1": c("contig1").rlike(viral), "viral2": c("contig2").rlike(viral), "ambiguous": F.coalesce("ambiguous", F.lit(True)), "strand1": F.coalesce("strand", F.lit(True))}).drop("strand")
    e = e.withColumn("strand2", c("strand1") != (c("dir1") == c("dir2"))).withColumn("five", stats.transcript_start())
    if variants is None:
        e = e.withColumn("gbp1", F.lit(None).cast("int")).withColumn("gbp2", F.lit(None).cast("int"))
    else:
        v = variants.select(*[f"{x}{i}" for x in ("contig", "pos", "dir") for i in (1, 2)])
        e = pivot.nearest_variant(e, v, opt.sv_distance, longest=opt.itd_length)
    if opt.on("merge_adjacent"):
        e = ef.merge_adjacent(e, longest=opt.itd_length).checkpoint()
    partners = stats.partner_counts(e)
    for i in (1, 2):
        e = e.join(partners.select(c("gene").alias(f"gene{i}"), c("partners").alias(f"p{i}")), f"gene{i}", "left").fillna(1, [f"p{i}"])
    e = e.join(annotate.spliced_distance(exons, e), "event_id", "left").withColumn("spliced_distance", F.coalesce("spliced_distance", ev.distance().cast("bigint"))).checkpoint()
    mapped = assemble.mapped_reads(seg, sq.wildcard_regex(opt.interesting)).first()[0]
    e = e.withColumn("evalue", stats.evalue(e, mapped, stats.event_shares(e)))
    early = [("non_coding_neighbors", ef.non_coding_neighbors()), ("intragenic_exonic", ef.intragenic_exonic(opt.exonic_fraction)), ("min_support", ef.min_support(opt.support)), ("relative_support", ef.relative_support(opt.evalue))]
    e = fate.discard_all(e, [(n, p) for n, p in early if opt.on(n)])
    if opt.on("internal_tandem_duplication"):
        rate = reads.agg(F.coalesce(F.avg((c("fate") == "duplicates").cast("double")), F.lit(0.0))).first()[0]
        e = same_coding_exon(e, exons, opt.itd_length).withColumn("duplicate_rate", F.lit(rate))
        e = ef.tandem_duplications(e, opt.itd_length, opt.itd_support, opt.itd_fraction, opt.cap).drop("duplicate_rate")
    if opt.on("intronic"):
        e = fate.discard(e, "intronic", ef.intronic())
    if known is not None and opt.on("known_fusions"):
        e = rule_steps.recover_known(e.checkpoint(), known, opt.fragment_length, opt.evalue)
    if opt.on("spliced"):
        e = ef.recover_spliced(e)
    if opt.on("select_best"):
        e = ef.select_best(e)
    if opt.on("marginal_read_through"):
        e = fate.discard(e, "marginal_read_through", ef.marginal_read_through())
    if opt.on("many_spliced"):
        e = ef.many_spliced(e, opt.spliced_events)
    e = e.checkpoint()
    if variants is not None and opt.on("no_genomic_support"):
        e = fate.discard(ef.assign_confidence(e), "no_genomic_support", ef.no_genomic_support()).drop("confidence").checkpoint()
    if rules is not None and opt.on("blacklist"):
        hit = rule_steps.rule_hits(e, rules, opt.fragment_length, opt.evalue).select("event_id").distinct().withColumn("__hit", F.lit(True))
        e = fate.discard(e.join(hit, "event_id", "left"), "blacklist", c("__hit")).drop("__hit")
    late = [("short_anchor", ef.short_anchor(opt.anchor)), ("end_to_end", ef.end_to_end())]
    e = fate.discard_all(e, [(n, p) for n, p in late if opt.on(n)])
    if opt.on("no_coverage"):
        e = ef.filter_no_coverage(e.checkpoint(), stats.fragment_edges(seg, through).checkpoint(), exons)
    if variants is not None and opt.on("genomic_support"):
        e = ef.recover_genomic(e)
    if opt.on("select_best") and (opt.on("many_spliced") or (variants is not None and opt.on("genomic_support"))):
        e = ef.select_best(e)
    if opt.on("isoforms"):
        e = ef.isoforms(e)
    e = ef.assign_confidence(e.checkpoint())
    e = e.withColumns({"type": ev.event_type(opt.itd_length), "confidence_label": ev.confidence_label(c("confidence"))})
    for i in (1, 2):
        e = e.withColumn(f"strand_label{i}", ev.strand_label(c(f"g{i}_strand"), c(f"g{i}_dummy"), c(f"strand{i}"), c("ambiguous")))
    return rule_steps.tags(e, tags) if tags is not None else e


def ranked(events: DataFrame) -> DataFrame:
    """The result table of the passing events in output order, the 5' gene first."""
    best = ef.output_order(events.where(c("fate") == fate.NONE)).orderBy("place")
    return sinks.result_table(sinks.five_prime_first(best, c("five") == 2))


def discarded(events: DataFrame) -> DataFrame:
    """The same columns of the events that a step discarded, in no order; the step's name stands in filters, and reads aren't listed."""
    rest = events.where(c("fate") != fate.NONE).withColumn("filters", c("fate")).drop("read_identifiers")
    return sinks.result_table(sinks.five_prime_first(rest, c("five") == 2))


def remaining(events: DataFrame) -> DataFrame:
    """How many events each step discarded."""
    return events.groupBy("fate").agg(F.count("*").alias("events")).orderBy(c("events").desc(), "fate")
