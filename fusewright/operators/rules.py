"""Rule files over events: block lists, known fusions and tags.

Rules are rows of sources.text.rules(): two regions, prefixed a_ and b_, of the kinds range,
position and gene; the second may be a keyword. located() gives gene regions their coordinates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import events as ev
from .fate import recover

c = F.col
BIN = 100_000


def located(rules: DataFrame, genes: DataFrame, contigs: DataFrame | None = None) -> DataFrame:
    """Rules with a_gene_id, b_gene_id and the coordinates of named genes (genes: id, name, contig, start, end); those of unknown genes go.

    contigs (contig): a contig that ends in a star stands for the first one, in order, that begins so; rules of none go.
    """
    named = genes.groupBy("name").agg(F.min(F.struct("id", "contig", "start", "end")).alias("g"))
    for p in ("a", "b"):
        g = named.select(c("name").alias(f"{p}_gene"), c("g").alias("__g"))
        rules = rules.join(g, f"{p}_gene", "left").where((c(f"{p}_kind") != "gene") | c("__g").isNotNull())
        rules = rules.withColumns({f"{p}_gene_id": c("__g.id"), f"{p}_contig": F.coalesce("__g.contig", f"{p}_contig"), f"{p}_start": F.coalesce("__g.start", f"{p}_start"), f"{p}_end": F.coalesce("__g.end", f"{p}_end")}).drop("__g")
        if contigs is not None:
            begins = contigs.select("contig", F.explode(F.sequence(F.lit(1), F.length("contig"))).alias("n")).groupBy(F.substring("contig", F.lit(1), c("n")).alias("__begin")).agg(F.min("contig").alias("__first"))
            star = F.when(c(f"{p}_contig").endswith("*"), F.substring(f"{p}_contig", F.lit(1), F.length(f"{p}_contig") - 1))
            rules = rules.join(begins, star == c("__begin"), "left").where(~F.coalesce(c(f"{p}_contig").endswith("*"), F.lit(False)) | c("__first").isNotNull())
            rules = rules.withColumn(f"{p}_contig", F.coalesce("__first", f"{p}_contig")).drop("__begin", "__first")
    return rules


def overlapping_share(start: Column, end: Column, start2: Column, end2: Column) -> Column:
    """How much of the first interval the second covers: the span between the inner ends over the first's length; 1 within the second."""
    inner = F.least(end, end2) - F.greatest(start, start2)
    return F.when((start >= start2) & (end <= end2), 1.0).when((end >= start2) & (start <= end2), inner / (end - start + 1)).otherwise(0.0)


def matches(p: str, i: int, reach: int, evalue: float) -> Column:
    """Whether side i of an event fits a rule's region p. reach: how far from a position pairs without split reads may point at it."""
    kind, bp, start, end = c(f"{p}_kind"), c(f"bp{i}"), c(f"{p}_start"), c(f"{p}_end")
    own, others = c(f"split{i}"), c(f"split{3 - i}")
    there = (c(f"contig{i}") == c(f"{p}_contig")) & (c(f"{p}_strand").isNull() | c("ambiguous") | (c(f"strand{i}") == c(f"{p}_strand")))
    toward = (ev.split_reads() == 0) & F.when(c(f"dir{i}") == ev.DOWN, bp.between(start - reach, start)).otherwise(bp.between(start, start + reach))
    weak = c("evalue") > evalue
    return F.coalesce(
        F.when(kind == "range", there & (overlapping_share(c(f"g{i}_start"), c(f"g{i}_end"), start, end) > 0.5))
        .when(kind == "position", there & ((bp == start) | toward))
        .when(kind == "gene", c(f"gene{i}") == c(f"{p}_gene_id"))
        .when(kind == "any", True)
        .when(kind == "split_read_donor", c("disc") + own == 0)
        .when(kind == "split_read_acceptor", c("disc") + others == 0)
        .when(kind == "split_read_any", c("disc") == 0)
        .when(kind == "discordant_mates", ev.split_reads() == 0)
        .when(kind == "read_through", ev.is_read_through())
        .when(kind == "low_support", weak)
        .when(kind == "filter_spliced", weak & c("spliced1") & c("spliced2"))
        .when(kind == "not_both_spliced", ~c("spliced1") | ~c("spliced2")),
        F.lit(False),
    )


def rule_hits(events: DataFrame, rules: DataFrame, reach: int = 0, evalue: float = 0.3, ordered: bool = False, width: int = BIN) -> DataFrame:
    """(event_id, rule_id), distinct, of located rules whose regions fit an event's sides, in either order.

    ordered: the first region must fit the 5' side (five: 1, 2, or 0 if unknown; then either order
    will do unless the breakpoints are proximal). Events and rules meet in bins of the first region,
    so neither a busy contig nor a long list is one task; a rule spreads over the bins of its region.
    """
    r = rules.withColumn("__bin", F.explode(F.sequence(F.floor((c("a_start") - reach) / width), F.floor((c("a_end") + reach) / width)))).withColumnRenamed("a_contig", "__contig").withColumn("a_contig", c("__contig"))

    def one(i: int) -> DataFrame:
        g, at = (F.floor(c(x) / width) for x in (f"g{i}_start", f"bp{i}"))
        bins = F.array_union(F.sequence(g, F.floor(c(f"g{i}_end") / width)), F.array(at))
        allowed = F.lit(True)
        if ordered:
            distal = ~(ev.same_contig() & (F.abs(ev.distance()) < 1_000_000))
            allowed = ((c("five") == 0) & distal) | (F.when(c("five") == 2, 2).otherwise(1) == i)
        e = events.where(allowed).withColumn("__contig", c(f"contig{i}")).withColumn("__bin", F.explode(bins))
        return e.join(r, ["__contig", "__bin"]).where(matches("a", i, reach, evalue) & matches("b", 3 - i, reach, evalue)).select("event_id", "rule_id")

    return one(1).union(one(2)).distinct()


def recover_known(df: DataFrame, rules: DataFrame, reach: int = 0, evalue: float = 0.3) -> DataFrame:
    """Recovers events between genes that were discarded for low support and fit a known pair (5' region, 3' region).

    Two positions always do; else two reads, or splice sites on both sides with little coverage and no proximity.
    """
    weak = ("relative_support", "min_support")
    asks = df.where(c("fate").isin(*weak) & ~ev.same_gene())
    exact = rules.select("rule_id", ((c("a_kind") == "position") & (c("b_kind") == "position")).alias("exact"))
    hit = rule_hits(asks, rules, reach, evalue, ordered=True).join(exact, "rule_id").groupBy("event_id").agg(F.max("exact").alias("__exact"))
    d = df.join(hit, "event_id", "left")
    far = ~ev.same_contig() | (F.abs(ev.distance()) > 1_000_000)
    ok = c("__exact").isNotNull() & (c("__exact") | (ev.support() >= 2) | (ev.both_spliced() & (c("cov1") + c("cov2") < 200) & far))
    return recover(d, weak, ~ev.same_gene() & ok).drop("__exact")


def tags(events: DataFrame, rules: DataFrame, reach: int = 0) -> DataFrame:
    """Adds tags: the sorted distinct tags of fitting rules (located, with tag), joined by commas, or a dot."""
    hit = rule_hits(events, rules, reach, ordered=True).join(rules.select("rule_id", "tag").distinct(), "rule_id")
    t = hit.groupBy("event_id").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))
    return events.join(t, "event_id", "left").withColumn("tags", F.coalesce("tags", F.lit(".")))
