"""Read-level steps. Reads are rows with flat columns of their segments.

Prefixes: m1 (first mate), m2 (second mate, or the split read), sp (supplementary; null for
discordant pairs): _contig, _start, _end, _strand (true: forward), _ops (parsed CIGAR), _seq, _genes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cache
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cigar
from .fate import NONE, discard

c = F.col


def is_split() -> Column:
    return c("is_split")


def other(field: str) -> Column:
    """A field of the segment that lies on the other side: the supplementary of a split read, else the first mate."""
    return F.when(is_split(), c(f"sp_{field}")).otherwise(c(f"m1_{field}"))


def mark_duplicates(reads: DataFrame, key: Sequence[str], order: str = "read_key", external: str | None = None) -> DataFrame:
    """All live rows of a key but the first by name get the fate duplicates; rows that have a fate are neither counted nor changed.

    external: the name of a boolean column by which another program marked duplicates; then the key has no say.
    """
    if external is not None:
        return discard(reads, "duplicates", c(external))
    rank = F.row_number().over(Window.partitionBy(*key, c("fate") == NONE).orderBy(order))
    return reads.withColumn("__rank", rank).transform(lambda d: discard(d, "duplicates", c("__rank") > 1)).drop("__rank")


def ordered_ends(df: DataFrame, contig1: Column, contig2: Column, pos1: Column, pos2: Column) -> DataFrame:
    """Adds contig1, contig2, pos1, pos2: the end of the lesser position first, with its contig; equal positions keep their order."""
    ends = F.array(F.struct(contig1.alias("contig"), pos1.alias("pos")), F.struct(contig2.alias("contig"), pos2.alias("pos")))
    d = df.withColumn("__ends", F.when(pos1 > pos2, F.reverse(ends)).otherwise(ends))
    return d.withColumns({f"{k}{i + 1}": c("__ends")[i][k] for k in ("contig", "pos") for i in (0, 1)}).drop("__ends")


def duplicate_key(reads: DataFrame) -> DataFrame:
    """Adds contig1, contig2, pos1, pos2: unclipped 5' positions of the first mate and of the other end, in order."""

    def five(p: str) -> Column:
        return F.when(c(f"{p}_strand"), c(f"{p}_start") - cigar.preclip(c(f"{p}_ops"))).otherwise(c(f"{p}_end") + cigar.postclip(c(f"{p}_ops")))

    other_end = F.when(is_split(), five("sp")).otherwise(five("m2"))
    return ordered_ends(reads, c("m1_contig"), F.when(is_split(), c("sp_contig")).otherwise(c("m2_contig")), five("m1"), other_end)


def mark_multimappers(reads: DataFrame, group: str = "read_group") -> DataFrame:
    """Adds multimapper: whether a fragment has several alignments."""
    return reads.withColumn("multimapper", F.count("*").over(Window.partitionBy(group)) > 1)


def uninteresting_contigs(contigs: Sequence[str], pattern: str) -> Column:
    return F.array_contains(F.transform(F.array(*[c(x) for x in contigs]), lambda x: ~x.rlike(pattern)), True)


def viral_only(pattern: str) -> Column:
    """All segments lie on viral contigs."""
    return c("m1_contig").rlike(pattern) & c("m2_contig").rlike(pattern) & F.coalesce(c("sp_contig").rlike(pattern), F.lit(True))


def discard_contigs(reads: DataFrame, name: str, contigs: DataFrame, columns: Sequence[str] = ("m1_contig", "m2_contig", "sp_contig")) -> DataFrame:
    """Live reads with a segment on one of contigs (contig, distinct) get the fate name."""
    for x in columns:
        reads = reads.join(contigs.select(c("contig").alias(x), F.lit(True).alias(f"__{x}")), x, "left")
    hit = F.coalesce(*(c(f"__{x}") for x in columns), F.lit(False))
    return discard(reads, name, hit).drop(*(f"__{x}" for x in columns))


def read_through(distance: int = 10_000) -> Column:
    """A co-linear pair near the other side's gene. Gene bounds: fw_gene_end and rv_gene_start are the largest gene's (-1 if none)."""
    a_first = F.when(is_split(), ~c("m2_strand")).otherwise(c("m1_strand"))
    fe = F.when(is_split(), F.when(a_first, c("m2_end")).otherwise(c("sp_end"))).otherwise(F.when(a_first, c("m1_end")).otherwise(c("m2_end")))
    rs = F.when(is_split(), F.when(a_first, c("sp_start")).otherwise(c("m2_start"))).otherwise(F.when(a_first, c("m2_start")).otherwise(c("m1_start")))
    contig = F.when(is_split(), c("m2_contig") == c("sp_contig")).otherwise(c("m1_contig") == c("m2_contig"))
    strands = F.when(is_split(), c("m2_strand") == c("sp_strand")).otherwise(c("m1_strand") != c("m2_strand"))
    return contig & strands & (fe < rs) & ((fe >= c("rv_gene_start") - distance) | (rs <= c("fw_gene_end") + distance))


def inconsistently_clipped(slack: int = 3) -> Column:
    forward = c("m1_strand") & (c("m1_end") > c("m2_end") + slack)
    reverse = ~c("m1_strand") & (c("m1_start") < c("m2_start") - slack)
    return is_split() & (forward | reverse)


def homopolymer(length: int = 6) -> Column:
    """A run of one base on either flank of a split read's breakpoint; spliced reads (at_splice_site) are spared."""
    n, pre, post = F.length("m2_seq"), cigar.preclip(c("m2_ops")), cigar.postclip(c("m2_ops"))
    at = F.when(c("m2_strand"), pre).otherwise(n - post)
    left = F.when(at >= length, F.substring(c("m2_seq"), at - length + 1, F.lit(length)))
    right = F.when(n - at >= length, F.substring(c("m2_seq"), at + 1, F.lit(length)))
    return is_split() & F.concat_ws(" ", left, right).rlike(rf"(.)\1{{{length - 1}}}") & ~c("at_splice_site")


def small_insert_size(overhang: int = 5) -> Column:
    near = (F.abs(c("m1_start") - c("m2_start")) <= overhang) | (F.abs(c("m1_end") - c("m2_end")) <= overhang)
    return ~is_split() & (c("m1_contig") == c("m2_contig")) & (c("m1_strand") != c("m2_strand")) & near


def long_gap() -> Column:
    both_reverse, both_forward = ~c("m2_strand") & ~c("sp_strand"), c("m2_strand") & c("sp_strand")
    size = F.when(both_reverse, c("sp_start") - c("m2_end")).when(both_forward, c("m2_start") - c("sp_end"))
    deletion = F.coalesce(F.when(is_split() & (c("m2_contig") == c("sp_contig")), size), F.lit(0))
    return cigar.has_long_gap(c("m1_ops"), deletion) | cigar.has_long_gap(c("m2_ops"), deletion) | (is_split() & cigar.has_long_gap(c("sp_ops"), deletion))


def same_gene() -> Column:
    """The sides share a gene and lie as normal splicing would put them."""
    common = F.arrays_overlap(c("m2_genes"), other("genes"))
    pair = (c("m1_strand") & ~c("m2_strand") & (c("m1_start") <= c("m2_end"))) | (~c("m1_strand") & c("m2_strand") & (c("m1_end") >= c("m2_start")))
    split = (c("m2_strand") & c("sp_strand") & (c("m2_start") >= c("sp_end"))) | (~c("m2_strand") & ~c("sp_strand") & (c("m2_end") <= c("sp_start")))
    return common & F.when(is_split(), split).otherwise(pair)


def hairpin() -> Column:
    """A breakpoint lies within what the other segment aligns to."""
    near = F.arrays_overlap(c("m2_genes"), other("genes")) | (c("m2_contig") == other("contig"))
    inside = lambda p, s: cigar.within_blocks(p, c(f"{s}_start"), c(f"{s}_ops"))
    outer = lambda s: F.when(c(f"{s}_strand"), c(f"{s}_end")).otherwise(c(f"{s}_start"))
    inner = F.when(c("m2_strand"), c("m2_start")).otherwise(c("m2_end"))
    split = inside(inner, "sp") | inside(outer("sp"), "m2") | inside(outer("sp"), "m1")
    pair = inside(outer("m1"), "m2") | inside(outer("m2"), "m1")
    return near & F.when(is_split(), split).otherwise(pair)


def binomial_point(k: Column, n: Column, p: float) -> Column:
    """Probability of exactly k mismatches among n bases."""
    coefficient = F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), F.lit(1.0), lambda a, i: F.when(k >= i, a * (n - k + i) / i).otherwise(a))
    return coefficient * F.pow(F.lit(p), k) * F.pow(F.lit(1 - p), n - k)


def too_many_mismatches(k: Column, n: Column, p: float = 0.01, cutoff: float = 0.01, genome_size: float = 3e9) -> Column:
    """Improbable as sequencing errors, or likely to be a random sequence that fits somewhere."""
    coefficient = F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), F.lit(1.0), lambda a, i: F.when(k >= i, a * (n - k + i) / i).otherwise(a))
    places = F.pow(F.lit(4.0), n - k)
    chance = 1 - F.pow(1 - F.lit(genome_size) / places, coefficient)
    return (binomial_point(k, n, p) < cutoff) | ((k > 0) & ((places <= genome_size) | (chance > 0.01)))


@cache
def _most_frequent(k: int) -> Callable[[Column], Column]:
    """low_entropy_counts() of one k, a function of its own so that equal calls in a projection are one."""
    bases = bytes(x if x in b"TGC" else ord("A") for x in range(256))
    every = [bytes(w) for w in product(b"ATGC", repeat=k)] if k <= 4 else None

    def most(seq: str | None) -> int:
        looked = (seq or "").encode("ascii", "replace").translate(bases)[:-1]
        return max(map(looked.count, every or {looked[i : i + k] for i in range(len(looked) - k + 1)}), default=0)

    @F.pandas_udf("int")
    def counted(seqs: pd.Series) -> pd.Series:
        return pd.Series([most(s) for s in seqs], dtype="int32")

    return counted


def low_entropy_counts(seq: Column, k: int = 3) -> Column:
    """The largest number of non-overlapping occurrences of one k-mer, found from the left; the last k-mer isn't looked at. Linear in the sequence."""
    return _most_frequent(k)(seq)


def low_entropy(seq: Column, content: float = 0.6, k: int = 3) -> Column:
    """One k-mer makes up more than a share of the sequence."""
    return (F.length(seq) >= k) & (low_entropy_counts(seq, k) >= F.floor(F.length(seq) * content / k + 0.5))


def looks_like_tandem_duplication(longest: int = 100) -> Column:
    same = (c("m2_strand") == c("sp_strand")) & (c("m2_contig") == c("sp_contig"))
    forward = c("m2_strand") & (c("m2_start") < c("sp_end")) & (c("m2_start") + longest >= c("sp_end"))
    reverse = ~c("m2_strand") & (c("m2_end") > c("sp_start")) & (c("m2_end") <= c("sp_start") + longest)
    return is_split() & same & (forward | reverse)


def filter_low_entropy(reads: DataFrame, content: float = 0.6, k: int = 3) -> DataFrame:
    """Overrides other fates but duplicates for reads that look like tandem duplications. Whole reads and their aligned parts are tested."""

    def part(p: str) -> Column:
        n, a, b = F.length(f"{p}_seq"), cigar.preclip(c(f"{p}_ops")), cigar.postclip(c(f"{p}_ops"))
        return F.substring(c(f"{p}_seq"), a + 1, n - a - b)

    low = F.lit(False)
    for p in ("m1", "m2"):
        low = low | low_entropy(c(f"{p}_seq"), content, k) | low_entropy(part(p), content, k)
    open_ = (c("fate") == NONE) | (F.coalesce(looks_like_tandem_duplication(), F.lit(False)) & (c("fate") != "duplicates"))
    return reads.withColumn("fate", F.when(open_ & F.coalesce(low, F.lit(False)), F.lit("low_entropy")).otherwise(c("fate")))


def read_filters(distance: int = 10_000, length: int = 6) -> list[tuple[str, Column]]:
    """Stateless read steps in their order, for discard_all(); distance is that of read_through, length that of homopolymer."""
    return [
        ("read_through", read_through(distance)),
        ("inconsistently_clipped", inconsistently_clipped()),
        ("homopolymer", homopolymer(length)),
        ("small_insert_size", small_insert_size()),
        ("long_gap", long_gap()),
        ("same_gene", same_gene()),
        ("hairpin", hairpin()),
    ]
