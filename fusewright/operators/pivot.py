"""From reads to events, and rules over events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import events as ev
from .fate import NONE

c = F.col
EVENT = ("gene1", "gene2", "contig1", "contig2", "bp1", "bp2", "dir1", "dir2")
CAP = 300


def event_fate(fate: Column, read_key: Column) -> Column:
    """An aggregate: none if a read is live; else the fate of the first read by name that is no duplicate; else duplicates."""
    live = F.max(F.when(fate == NONE, F.lit(NONE)))
    first = F.min(F.when(fate != "duplicates", F.struct(read_key.alias("k"), fate.alias("f"))))["f"]
    return F.coalesce(live, first, F.lit("duplicates"))


def pivot_events(reads: DataFrame, cap: int = CAP) -> DataFrame:
    """reads (EVENT columns, role: split1, split2 or discordant, fate, read_key, exonic1, exonic2, start1, start2) -> events.

    Counters are of live reads, at most cap a role; listed counts all reads. Anchors are the
    outermost starts on the retained side. One shuffle by the event's key; counts combine before it.
    """
    count = lambda role: F.least(F.sum(F.when((c("role") == role) & (c("fate") == NONE), 1).otherwise(0)), F.lit(cap)).alias
    anchor = lambda i: F.when(c(f"dir{i}") == ev.DOWN, F.min(f"start{i}")).otherwise(F.max(f"start{i}")).alias(f"anchor{i}")
    return reads.groupBy(*EVENT).agg(
        count("split1")("split1"),
        count("split2")("split2"),
        count("discordant")("disc"),
        F.count("*").alias("listed"),
        F.count(F.when(c("role") != "discordant", 1)).alias("listed_split"),
        F.max("exonic1").alias("exonic1"),
        F.max("exonic2").alias("exonic2"),
        anchor(1),
        anchor(2),
        event_fate(c("fate"), c("read_key")).alias("fate"),
    )


def discordant_support(events: DataFrame, pairs: DataFrame, gap: int, cap: int = CAP) -> DataFrame:
    """Live events with the number of discordant pairs (gene1, gene2, dir1, dir2, pos1, pos2, read_key) that point at both breakpoints.

    Within 2 of an exact breakpoint, else within gap. An equi-join on genes, directions and bins of the
    first position as wide as the band, so a hot gene pair isn't all its events by all its pairs. The
    count of one event is capped.
    """
    reach = F.when(ev.split_reads() > 0, F.lit(2)).otherwise(F.lit(gap))

    def points(i: int) -> Column:
        b, p = c(f"bp{i}"), c(f"pos{i}")
        return F.when(c(f"dir{i}") == ev.DOWN, (p <= b + reach) & (p >= b - gap)).otherwise((p >= b - reach) & (p <= b + gap))

    key, width = ["gene1", "gene2", "dir1", "dir2", "__bin"], max(gap, 2)
    at = F.floor(c("bp1") / width)
    asks = events.where(c("fate") == NONE).select("event_id", *key[:4], "bp1", "bp2", "split1", "split2", F.explode(F.array(at - 1, at, at + 1)).alias("__bin"))
    hits = asks.join(pairs.withColumn("__bin", F.floor(c("pos1") / width)), key).where(points(1) & points(2))
    n = hits.groupBy("event_id").agg(F.least(F.countDistinct("read_key"), F.lit(cap)).alias("near_pairs"))
    return events.join(n, "event_id", "left").withColumn("near_pairs", F.coalesce("near_pairs", F.lit(0)))


def nearest_variant(events: DataFrame, variants: DataFrame, reach: int = 100_000, slack: int = 5, longest: int = 100) -> DataFrame:
    """Adds gbp1, gbp2, gdist: of the variants (contig1, contig2, dir1, dir2, pos1, pos2) that can explain the event, the one of least summed distance.

    A position counts on the retained side up to reach beyond the gene's bound (beyond the breakpoint
    for dummy genes), or up to slack on the other side. Upstream all first positions count (those
    under bp1 + slack), downstream the nearest only, whatever its partners. On one contig a deletion's
    positions lie between the breakpoints, one of an inversion's does, and those of a tandem
    duplication under longest bases are nearer than that. Ties go to the first position nearest to
    the event, then to the least pos2.

    Events and variants meet in bins by both positions, so one contig pair isn't one task, and a
    variant meets its surroundings only.
    """
    keys, up1 = ["contig1", "contig2", "dir1", "dir2"], c("dir1") == ev.UP
    v = variants.select(*keys, "pos1", "pos2").distinct()
    low = lambda i: F.when(c(f"dir{i}") == ev.UP, F.when(c(f"g{i}_dummy"), c(f"bp{i}")).otherwise(c(f"g{i}_start")) - reach).otherwise(c(f"bp{i}") - slack)
    high = lambda i: F.when(c(f"dir{i}") == ev.UP, c(f"bp{i}") + (slack - (i == 1))).otherwise(F.when(c(f"g{i}_dummy"), c(f"bp{i}")).otherwise(c(f"g{i}_end")) + reach)
    e = events.select("event_id", *keys, "bp1", "bp2", ev.is_tandem_duplication(longest).alias("__itd"), *(f(i).alias(f"__{n}{i}") for i in (1, 2) for n, f in (("low", low), ("high", high))))
    e = e.where("__low1 <= __high1 and __low2 <= __high2")
    wide = {1: max(reach, 1), 2: max(reach, 1)}
    bins = lambda d, i: d.withColumn(f"__bin{i}", F.explode(F.sequence(F.floor(c(f"__low{i}") / wide[i]), F.floor(c(f"__high{i}") / wide[i]))))
    v = v.withColumns({f"__bin{i}": F.floor(c(f"pos{i}") / wide[i]) for i in (1, 2)})
    ahead = bins(e.where(~up1), 1).join(v.select(*keys, "__bin1", "pos1").distinct(), [*keys, "__bin1"]).where(c("pos1").between(c("__low1"), c("__high1")))
    only = ahead.groupBy("event_id").agg(F.min("pos1").alias("__low1"))
    e = e.where(up1).unionByName(e.where(~up1).drop("__low1", "__high1").join(only, "event_id").withColumn("__high1", c("__low1")))
    between = (
        F.when(c("contig1") != c("contig2"), True)
        .when(up1 & (c("dir2") == ev.DOWN), ~c("__itd") | ((c("bp1") - c("pos1") < longest) & (c("pos2") - c("bp2") < longest)))
        .when(~up1 & (c("dir2") == ev.UP), (c("pos1") < c("bp2")) & (c("pos2") > c("bp1")))
        .when(up1, c("pos2") > c("bp1"))
        .otherwise(c("pos1") < c("bp2"))
    )
    hits = bins(bins(e, 1), 2).join(v, [*keys, "__bin1", "__bin2"]).where(c("pos1").between(c("__low1"), c("__high1")) & c("pos2").between(c("__low2"), c("__high2")) & between)
    d = F.abs(c("pos1") - c("bp1")) + F.abs(c("pos2") - c("bp2"))
    best = hits.groupBy("event_id").agg(F.min(F.struct(d.alias("d"), F.when(up1, -c("pos1")).otherwise(c("pos1")).alias("near"), "pos2", "pos1")).alias("b"))
    found = best.select("event_id", c("b.pos1").alias("gbp1"), c("b.pos2").alias("gbp2"), c("b.d").alias("gdist"))
    return events.join(found, "event_id", "left")


def capped(evidence: DataFrame, by: tuple[str, ...], order: str, cap: int = CAP) -> DataFrame:
    """The first cap rows of each key by name: the feature that bounds work on events with very many reads."""
    return evidence.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(c("__n") <= cap).drop("__n")
