"""Interval operators: binned joins, segments, merges, islands, neighbours. Coordinates are inclusive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BIN = 100_000


def bins(start: str, end: str, width: int) -> F.Column:
    return F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))


def point_join(points: DataFrame, features: DataFrame, on: str = "contig", pos: str = "pos", start: str = "start", end: str = "end", width: int = BIN, how: str = "inner") -> DataFrame:
    """Features that hold a point. A point has one bin, so no pair comes twice; the shuffle key is (contig, bin), which splits busy contigs."""
    p = points.withColumn("__bin", F.floor(F.col(pos) / width))
    f = features.withColumn("__bin", F.explode(bins(start, end, width)))
    f = f.withColumnsRenamed({on: "__on"})
    cond = (p[on] == f["__on"]) & (p["__bin"] == f["__bin"]) & p[pos].between(f[start], f[end])
    return p.join(f, cond, how).drop("__bin", "__on")


def range_join(left: DataFrame, right: DataFrame, on: str = "contig", width: int = BIN) -> DataFrame:
    """Overlapping pairs of left (start, end) and right (r_start, r_end, r_contig); each comes in the first bin that both have."""
    a = left.withColumn("__bin", F.explode(bins("start", "end", width)))
    b = right.withColumn("__rbin", F.explode(bins("r_start", "r_end", width)))
    first = F.greatest(F.floor(F.col("start") / width), F.floor(F.col("r_start") / width))
    cond = (a[on] == b[f"r_{on}"]) & (a["__bin"] == b["__rbin"]) & (F.col("start") <= F.col("r_end")) & (F.col("r_start") <= F.col("end")) & (F.col("__bin") == first)
    return a.join(b, cond).drop("__bin", "__rbin")


def merge_intervals(df: DataFrame, by: Sequence[str], gap: int = 0) -> DataFrame:
    """by..., start, end of the unions of intervals that overlap or touch within gap; many rows of one key are one task's sort."""
    w = Window.partitionBy(*by).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("__new", F.when(reach.isNull() | (F.col("start") > reach + 1 + gap), 1).otherwise(0))
    marked = marked.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "__island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__island")


def covered_length(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """by..., length: positions that at least one interval covers."""
    return merge_intervals(df, by).groupBy(*by).agg(F.sum(F.col("end") - F.col("start") + 1).cast("bigint").alias("length"))


def segments(df: DataFrame, on: str = "contig", key: str = "id") -> DataFrame:
    """contig, seg_start, seg_end, ids: stretches with one and the same non-empty set of features."""
    edges = df.select(on, F.explode(F.array("start", F.col("end") + 1)).alias("seg_start")).distinct()
    nxt = F.lead("seg_start").over(Window.partitionBy(on).orderBy("seg_start"))
    cut = edges.withColumn("seg_end", nxt - 1).where("seg_end is not null")
    held = point_join(cut, df.select(F.col(on), "start", "end", key), on=on, pos="seg_start")
    return held.groupBy(on, "seg_start", "seg_end").agg(F.array_sort(F.collect_set(key)).alias("ids"))


def islands(df: DataFrame, by: Sequence[str], pos: str, gap: int) -> DataFrame:
    """Numbers runs of positions whose steps are at most gap: adds island, from 1."""
    w = Window.partitionBy(*by).orderBy(pos)
    new = F.when(F.col(pos) - F.lag(pos).over(w) <= gap, 0).otherwise(1)
    # equal positions get one number: the frame is by value
    return df.withColumn("__new", new).withColumn("island", F.sum("__new").over(w).cast("bigint")).drop("__new")


def flanking(points: DataFrame, features: DataFrame, on: str = "contig", pos: str = "pos", width: int = BIN) -> DataFrame:
    """points with the nearest feature that ends before (left_id, left_distance) and that starts after (right_id, right_distance).

    Distinct positions and features' edges are sorted together in bins of (contig, bin); last and first
    non-null values carry the neighbours, so no pairs are formed, and a bin holds three rows a base at
    most. What lies beyond a bin comes from a running value over bins. Points then look their position
    up by an equi-join. Ties go to the least id.
    """
    bin_ = F.floor(F.col("__at") / width)
    edge = lambda kind, at: F.struct(F.lit(kind).alias("kind"), F.col(at).cast("bigint").alias("at"))
    edges = features.select(F.col(on).alias("__on"), "id", F.explode(F.array(edge(2, "end"), edge(0, "start"))).alias("__e")).select("__on", F.col("__e.at").alias("__at"), F.col("__e.kind").alias("__kind"), "id")
    edges = edges.where("__at is not null").repartition("__on", "__at").groupBy("__on", "__at", "__kind").agg(F.min("id").alias("__id"))
    asks = points.select(F.col(on).alias("__on"), F.col(pos).cast("bigint").alias("__at"), F.lit(1).alias("__kind")).where("__at is not null").distinct()
    marks = edges.unionByName(asks, allowMissingColumns=True).withColumn("__bin", bin_)
    near = F.struct(F.col("__at").alias("at"), F.col("__id").alias("id"))
    known = lambda kind: F.when(F.col("__kind") == kind, near)
    bins_ = marks.groupBy("__on", "__bin").agg(F.max(known(2)).alias("__l"), F.min(known(0)).alias("__r"))
    before = Window.partitionBy("__on").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("__on").orderBy(F.col("__bin").desc()).rowsBetween(Window.unboundedPreceding, -1)
    beyond = bins_.select("__on", "__bin", F.last("__l", ignorenulls=True).over(before).alias("__far_l"), F.last("__r", ignorenulls=True).over(after).alias("__far_r"))
    back = Window.partitionBy("__on", "__bin").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("__on", "__bin").orderBy(F.col("__at").desc(), F.col("__kind").desc()).rowsBetween(Window.unboundedPreceding, 0)
    found = marks.withColumn("__l", F.last(known(2), ignorenulls=True).over(back)).withColumn("__r", F.last(known(0), ignorenulls=True).over(ahead)).where("__kind = 1")
    found = found.join(beyond, ["__on", "__bin"]).select("__on", "__at", F.coalesce("__l", "__far_l").alias("__l"), F.coalesce("__r", "__far_r").alias("__r"))
    out = points.join(found.hint("merge"), (F.col(on) == F.col("__on")) & (F.col(pos) == F.col("__at")), "left")
    return out.select(
        *points.columns,
        F.col("__l.id").alias("left_id"),
        (F.col(pos) - F.col("__l.at")).alias("left_distance"),
        F.col("__r.id").alias("right_id"),
        (F.col("__r.at") - F.col(pos)).alias("right_distance"),
    )


def _around(at: DataFrame, slack: int) -> DataFrame:
    """gene, direction, at -> gene, direction, pos. Boundaries are dealt out before they grow: a table of exons may be one split of one file."""
    at = at.repartition("gene", "direction", "at").distinct()
    return at.select("gene", "direction", F.explode(F.sequence(F.col("at") - slack, F.col("at") + slack)).alias("pos")).distinct()


def boundary_sites(exons: DataFrame, slack: int = 2) -> DataFrame:
    """gene, direction, pos: positions within slack of an exon's boundary: starts for upstream, ends for downstream."""
    sides = F.array(F.struct(F.lit("upstream").alias("direction"), F.col("start").alias("at")), F.struct(F.lit("downstream").alias("direction"), F.col("end").alias("at")))
    return _around(exons.select("gene", F.explode(sides).alias("s")).select("gene", "s.*"), slack)


def splice_sites(exons: DataFrame, slack: int = 2) -> DataFrame:
    """boundary_sites() without the outer ends of transcripts (exons: gene, start, end, prev_end, next_start, coding_start, coding_end).

    An outer end counts if the transcript has one exon only, a coding one, or if the coding part
    begins or stops right there, so that the annotation misses what lies beyond.
    """
    prev, nxt, coded = F.col("prev_end").isNotNull(), F.col("next_start").isNotNull(), F.col("coding_start").isNotNull()
    single = ~prev & ~nxt & coded
    keep = {
        "upstream": prev | single | F.coalesce(F.col("start") == F.col("coding_start"), F.lit(False)),
        "downstream": nxt | single | F.coalesce(F.col("end") == F.col("coding_end"), F.lit(False)),
    }
    sides = F.array(*(F.when(keep[d], F.struct(F.lit(d).alias("direction"), F.col(e).alias("at"))) for d, e in (("upstream", "start"), ("downstream", "end"))))
    at = exons.select("gene", F.explode(F.filter(sides, lambda x: x.isNotNull())).alias("s"))
    return _around(at.select("gene", "s.*"), slack)


def spliced(events: DataFrame, sites: DataFrame, gene: str, direction: str, pos: str, name: str) -> DataFrame:
    """Adds a boolean: whether the breakpoint lies at a splice site of its gene; an equi-join, not a range join.

    Sites are exploded, which estimated sizes don't show, so a broadcast could outgrow the driver: both sides are sorted and merged.
    """
    s = sites.select(F.col("gene").alias(gene), F.col("direction").alias(direction), F.col("pos").alias(pos), F.lit(True).alias(name))
    return events.join(s.hint("merge"), [gene, direction, pos], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def combine(a: F.Column, b: F.Column, union: bool = True) -> F.Column:
    """The intersection of two sets; if it is empty, the union (or nothing)."""
    both = F.array_intersect(a, b)
    return F.when(F.size(both) > 0, both).otherwise(F.array_union(a, b)) if union else both
