"""Derived predicates of events, over flat columns.

Columns: gene1, gene2, contig1, contig2, bp1, bp2, dir1, dir2 ("upstream" or "downstream"), split1,
split2, disc, exonic1, exonic2, spliced1, spliced2; of the genes g1_start, g1_end, g1_strand (true:
forward), g1_dummy, g1_coding and the same with g2_. Breakpoint 1 is the lesser by (contig, position).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UP, DOWN = "upstream", "downstream"
NEAR_READ_THROUGH, AROUND_GENE = 400_000, 10_000
c = F.col


def split_reads() -> Column:
    return c("split1") + c("split2")


def support() -> Column:
    return split_reads() + c("disc")


def same_contig() -> Column:
    return c("contig1") == c("contig2")


def same_gene() -> Column:
    return c("gene1") == c("gene2")


def distance() -> Column:
    return c("bp2") - c("bp1")


def deletion_like() -> Column:
    return (c("dir1") == DOWN) & (c("dir2") == UP)


def is_read_through() -> Column:
    return same_contig() & (distance() < NEAR_READ_THROUGH) & deletion_like()


def is_tandem_duplication(most: int = 100) -> Column:
    return same_gene() & (distance() >= 0) & (distance() < most) & (c("dir1") == UP) & (c("dir2") == DOWN)


def overlaps_both_genes() -> Column:
    return c("bp1").between(c("g2_start"), c("g2_end")) | c("bp2").between(c("g1_start"), c("g1_end"))


def is_intragenic(around: int = AROUND_GENE) -> Column:
    return same_gene() | (c("bp1").between(c("g2_start") - around, c("g2_end") + around) & c("bp2").between(c("g1_start") - around, c("g1_end") + around))


def both_spliced() -> Column:
    same = c("g1_strand") == c("g2_strand")
    return c("spliced1") & c("spliced2") & ((same & (c("dir1") != c("dir2"))) | (~same & (c("dir1") == c("dir2"))))


def five_prime(side: int) -> Column:
    """Whether the retained part of this side's gene is its 5' end."""
    return (c(f"g{side}_strand") & (c(f"dir{side}") == DOWN)) | (~c(f"g{side}_strand") & (c(f"dir{side}") == UP))


def event_type(longest_itd: int = 100) -> Column:
    """The 17 names of event types."""
    dummy = c("g1_dummy") | c("g2_dummy")
    same_strand, same_dir = c("g1_strand") == c("g2_strand"), c("dir1") == c("dir2")
    rt = F.when(is_read_through(), F.lit("deletion/read-through")).otherwise(F.lit("deletion"))
    between = F.when(dummy | (same_dir & ~same_strand) | (~same_dir & same_strand), F.lit("translocation")).when(
        ~five_prime(1) & ~five_prime(2), F.lit("translocation/3'-3'")
    ).otherwise(F.lit("translocation/5'-5'"))
    deletion = F.when(dummy | same_strand, rt).when(c("g1_strand"), F.concat(rt, F.lit("/5'-5'"))).otherwise(F.concat(rt, F.lit("/3'-3'")))
    inversion = F.when(dummy | ~same_strand, F.lit("inversion")).when((c("dir1") == UP) & ~c("g1_strand"), F.lit("inversion/5'-5'")).otherwise(F.lit("inversion/3'-3'"))
    duplication = (
        F.when((dummy | same_strand) & same_gene() & c("spliced1") & c("spliced2"), F.lit("duplication/non-canonical_splicing"))
        .when((dummy | same_strand) & is_tandem_duplication(longest_itd), F.lit("duplication/ITD"))
        .when(dummy | same_strand, F.lit("duplication"))
        .when(~c("g1_strand"), F.lit("duplication/5'-5'"))
        .otherwise(F.lit("duplication/3'-3'"))
    )
    return F.when(~same_contig(), between).when(deletion_like(), deletion).when(same_dir, inversion).otherwise(duplication)


def strand_label(gene_strand: Column, dummy: Column, strand: Column, ambiguous: Column) -> Column:
    sign = lambda s: F.when(s, F.lit("+")).otherwise(F.lit("-"))
    return F.concat(F.when(dummy, F.lit(".")).otherwise(sign(gene_strand)), F.lit("/"), F.when(ambiguous, F.lit(".")).otherwise(sign(strand)))


def confidence_label(level: Column) -> Column:
    return F.when(level == 2, F.lit("high")).when(level == 1, F.lit("medium")).otherwise(F.lit("low"))


def evidence_rank() -> Column:
    """3: split reads on both sides; 2: on one side, and discordant pairs; 1: on one side only; 0: pairs only."""
    one = (c("split1") > 0) | (c("split2") > 0)
    return F.when((c("split1") > 0) & (c("split2") > 0), 3).when(one & (c("disc") > 0), 2).when(one, 1).otherwise(0)
