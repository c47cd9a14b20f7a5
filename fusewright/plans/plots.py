"""Tables behind the plots: layouts, tracks, links and bars. Drawing itself is out of scope."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

c = F.col
SIDE = ("event_id", "side")


def exon_layout(exons: DataFrame, squished: int = 200) -> DataFrame:
    """exons (event_id, side, start, end) -> x0, x1: introns become squished wide; positions start at 0."""
    w = Window.partitionBy(*SIDE).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    saved = F.greatest(c("start") - F.coalesce(reach, c("start")) - 1 - squished, F.lit(0))
    d = exons.withColumn("__saved", F.sum(saved).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min("start").over(Window.partitionBy(*SIDE))
    return d.withColumn("x0", c("start") - c("__saved") - first).withColumn("x1", c("end") - c("__saved") - first).drop("__saved")


def scaled(layout: DataFrame, scale: float | None = None) -> DataFrame:
    """Divides by the event's total width (or a fixed one) and puts the second gene to the right of the first."""
    width = layout.groupBy(*SIDE).agg((F.max("x1") + 1).alias("w"))
    both = width.groupBy("event_id").agg(F.sum("w").alias("total"), F.coalesce(F.max(F.when(c("side") == 1, c("w"))), F.lit(0)).alias("w1"))
    d = layout.join(both, "event_id")
    by = F.lit(float(scale)) if scale else c("total").cast("double")
    shift = F.when(c("side") == 2, c("w1")).otherwise(0)
    return d.withColumn("left", (c("x0") + shift) / by).withColumn("right", (c("x1") + 1 + shift) / by).drop("total", "w1")


def retained_exons(exons: DataFrame) -> DataFrame:
    """Exons (with bp, dir, strand) on the retained side, cut at the breakpoint; mirrored when the transcript runs the other way."""
    down = c("dir") == "downstream"
    d = exons.where(F.when(down, c("start") <= c("bp")).otherwise(c("end") >= c("bp")))
    d = d.withColumn("start", F.when(down, c("start")).otherwise(F.greatest("start", "bp"))).withColumn("end", F.when(down, F.least("end", "bp")).otherwise(c("end")))
    flip = F.when(c("side") == 1, ~down).otherwise(down)
    return d.withColumn("mirrored", flip).withColumn("from_break", F.when(down, c("bp") - c("end")).otherwise(c("start") - c("bp"))).withColumn("strand", F.when(flip, ~c("strand")).otherwise(c("strand")))


def coverage_track(depth: DataFrame, points: int = 5_000) -> DataFrame:
    """depth (event_id, side, pos, depth) -> mean depth in at most so many buckets a side."""
    ends = depth.groupBy(*SIDE).agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    d = depth.join(ends, list(SIDE)).withColumn("bucket", F.floor((c("pos") - c("lo")) * F.least(F.lit(points), c("hi") - c("lo") + 1) / (c("hi") - c("lo") + 1)))
    return d.groupBy(*SIDE, "bucket").agg(F.avg("depth").alias("depth"))


def normalised(track: DataFrame, quantile: float = 0.9999) -> DataFrame:
    """Depth over the sides' common ceiling, an upper quantile, at most 1."""
    top = track.groupBy("event_id").agg(F.greatest(F.percentile("depth", F.lit(quantile)), F.lit(1.0)).alias("top"))
    return track.join(top, "event_id").withColumn("height", F.least(c("depth") / c("top"), F.lit(1.0))).drop("top")


def junction_snippet(table: DataFrame) -> DataFrame:
    """left and right: the last 31 and first 30 letters around the junction; untemplated letters are split in halves."""
    parts = F.split(F.regexp_replace("fusion_transcript", r"[\[\]().^$_-]", ""), r"\|")
    a, b, n = F.get(parts, F.lit(0)), F.try_element_at(parts, F.lit(-1)), F.size(parts)
    mid = F.when(n == 3, F.get(parts, F.lit(1))).otherwise(F.lit(""))
    half = F.floor(F.length(mid) / 2).cast("int")
    left, right = F.concat(a, F.substring(mid, F.lit(1), half)), F.concat(F.substring(mid, half + 1, F.length(mid)), b)
    return table.select("*", F.substring(left, F.greatest(F.length(left) - 30, F.lit(1)), F.lit(31)).alias("left"), F.substring(right, F.lit(1), F.lit(30)).alias("right"))


def circos_links(table: DataFrame, bands: DataFrame, least: str = "medium") -> DataFrame:
    """Events at or above a confidence whose contigs have bands."""
    rank = F.when(c("confidence") == "high", 2).when(c("confidence") == "medium", 1).otherwise(0)
    contig = lambda i: F.regexp_extract(f"breakpoint{i}", "^(.*):", 1)
    known = bands.select(c("contig").alias("k")).distinct()
    d = table.where(rank >= {"high": 2, "medium": 1, "low": 0}[least]).withColumn("__1", contig(1)).withColumn("__2", contig(2))
    return d.join(known, c("__1") == c("k"), "left_semi").join(known, c("__2") == c("k"), "left_semi").drop("__1", "__2")


def domain_boxes(domains: DataFrame, share: float = 0.9) -> DataFrame:
    """domains (event_id, side, name, start, end): same names that overlap by share of the shorter are one box; level: how many boxes of the side hold it."""
    w = Window.partitionBy(*SIDE, "name").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    overlap = (F.least(before, c("end")) - c("start") + 1) / (c("end") - c("start") + 1)
    d = domains.withColumn("__n", F.sum(F.when(F.coalesce(overlap, F.lit(0.0)) >= share, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    boxes = d.groupBy(*SIDE, "name", "__n").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__n")
    outer = boxes.select(*[c(k).alias(f"o_{k}") for k in (*SIDE, "name", "start", "end")])
    inside = (c("event_id") == c("o_event_id")) & (c("side") == c("o_side")) & (c("o_start") <= c("start")) & (c("o_end") >= c("end")) & ((c("o_start") != c("start")) | (c("o_end") != c("end")) | (c("o_name") < c("name")))
    return boxes.join(outer, inside, "left").groupBy(*SIDE, "name", "start", "end").agg(F.count("o_name").alias("level"))


def band_of(points: DataFrame, bands: DataFrame) -> DataFrame:
    """points (contig, pos) with the name of the band that holds the position."""
    from ..operators.intervals import point_join

    return point_join(points, bands.select("contig", "start", "end", c("name").alias("band")), width=1_000_000, how="left").drop("start", "end")


def scale_bar(widths: DataFrame, width: str = "width") -> DataFrame:
    """A bar of a fifth of the width, to one significant digit, with its unit."""
    x = c(width) / 5
    n = F.pow(F.lit(10.0), F.floor(F.log10(F.greatest(x, F.lit(1.0)))))
    bar = F.round(x / n) * n
    unit = F.when(bar >= 1e9, F.struct(F.lit(1e9).alias("d"), F.lit("Gbp").alias("u"))).when(bar >= 1e6, F.struct(F.lit(1e6).alias("d"), F.lit("Mbp").alias("u"))).when(bar >= 1e3, F.struct(F.lit(1e3).alias("d"), F.lit("kbp").alias("u"))).otherwise(F.struct(F.lit(1.0).alias("d"), F.lit("bp").alias("u")))
    return widths.withColumn("bar", bar).withColumn("label", F.concat((bar / unit["d"]).cast("int").cast("string"), F.lit(" "), unit["u"]))


def chosen_transcripts(candidates: DataFrame) -> DataFrame:
    """One transcript an event and side: given, then at the splice site, best covered, holding the breakpoint, principal, longest coding, longest, first by name."""
    order = [c("given").desc(), c("at_splice_site").desc(), c("coverage").desc(), c("holds").desc(), c("principal").asc_nulls_last(), c("coding_length").desc(), c("length").desc(), c("transcript_id")]
    return candidates.withColumn("__n", F.row_number().over(Window.partitionBy(*SIDE).orderBy(*order))).where("__n = 1").drop("__n")
