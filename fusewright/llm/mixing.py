"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key. A source is cut into key ranges, the ranges are sorted,
and prefix sums of sizes come from two levels: sums by range, then sums within a range. So no
task holds a whole source, however large. A source's budget is cut at its exact number of words;
a budget above the source's size goes round again (another epoch).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, settled


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """sizes (known, source, source_size), one row a source -> the same with weight, target.

    Sources by code point, null last, take the weights in turn; together they share
    share * all sizes; none gets more than cap * its size, and what it can't take goes to the
    others by weight. That is a water level L with target = least(cap * size, L * weight), found
    from running sums over the sources in the order in which they fill up.
    """
    ranked = Window.orderBy(F.col("known").desc(), "source")
    every = Window.partitionBy(F.lit(0))
    filling = Window.partitionBy(F.lit(0)).orderBy("ratio", "rank")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    onward = filling.rowsBetween(0, Window.unboundedFollowing)
    w = F.array(*[F.lit(float(x)) for x in weights])
    return (
        sizes.withColumn("rank", F.row_number().over(ranked))
        .withColumn("weight", F.element_at(w, ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
        .withColumn("most", F.col("source_size").cast("double") * cap)
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(every).cast("double") * share)
        .withColumn("full", F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(onward))
        .withColumn("level", F.when(F.col("full") + F.col("ratio") * F.col("open") >= F.col("budget"), (F.col("budget") - F.col("full")) / F.col("open")))
        .withColumn("level", F.first("level", ignorenulls=True).over(filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("target", F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least("most", F.col("level") * F.col("weight"))))
        .select("known", "source", "source_size", "weight", "target")
    )


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, carry: Sequence[Column] = ()) -> DataFrame:
    """Per row of docs: doc_id, source, size, source_size, target, taken, epochs, and what carry names (columns _0, _1, ...).

    taken: words of this document in the mix: size for each full epoch, and in the last epoch what
    of it lies before the source's cut (one document of a source may be taken in part). epochs: how
    many times it appears, a partial one included. Reruns agree: the key is a digest of doc_id.

    Null source: a source of its own, the last. Null or blank text: size 0, nothing taken. Null
    doc_id: an id like any other. Very long texts count whole. Repeated rows: each counts by itself;
    ties of the key go by doc_id, then size. Empty table: empty result. Other columns of docs are
    ignored, whatever their names.
    """
    base = docs.select(
        F.col("doc_id"),
        F.col("source").isNotNull().alias("known"),
        F.coalesce("source", F.lit("")).alias("source"),
        word_count(F.col("text")).alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("key"),
        *(c.alias(f"_{i}") for i, c in enumerate(carry)),
    ).withColumn("part", F.substring("key", 1, 3))
    base = settled(base)  # so that texts are read and counted once
    parts = base.groupBy("known", "source", "part").agg(F.sum("size").alias("part_size"))
    earlier = Window.partitionBy("known", "source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("known", "source", "part", F.coalesce(F.sum("part_size").over(earlier), F.lit(0)).alias("offset"))
    goals = targets(parts.groupBy("known", "source").agg(F.sum("part_size").alias("source_size")), weights, share, cap)
    within = Window.partitionBy("known", "source", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    words, size, whole = F.floor("target").cast("long"), F.col("size"), F.col("whole")
    return (
        base.withColumn("run", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(offsets, ["known", "source", "part"])
        .join(goals, ["known", "source"])
        .withColumn("whole", F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0)))
        .withColumn("rest", words - whole * F.col("source_size") - F.col("offset") - F.col("run"))
        .withColumn("part_taken", F.greatest(F.lit(0), F.least(size, F.col("rest"))))
        .select(
            "doc_id",
            F.when(F.col("known"), F.col("source")).alias("source"),
            "size",
            "source_size",
            "target",
            (whole * size + F.col("part_taken")).cast("long").alias("taken"),
            (whole + (F.col("part_taken") > 0).cast("long")).alias("epochs"),
            "part_taken",
            *(f"_{i}" for i in range(len(carry))),
        )
    )


#: The same as mix() with its defaults over the table documents, for DuckDB.
ORACLE = r"""
WITH base AS (
  SELECT doc_id, source IS NOT NULL AS known, coalesce(source, '') AS source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
sizes AS (SELECT known, source, sum(size)::BIGINT AS source_size FROM base GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (ORDER BY known DESC, source) AS rank FROM sizes),
weighed AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((rank - 1) % 3 + 1)::INT] AS weight,
         source_size::DOUBLE * 2.0::DOUBLE AS most FROM ranked),
filled AS (
  SELECT *, most / weight AS ratio, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget FROM weighed),
summed AS (
  SELECT *,
         coalesce(sum(most) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled_before,
         sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS still_open
  FROM filled),
level AS (
  SELECT arg_min((budget - filled_before) / still_open, (ratio, rank)) AS lv
  FROM summed WHERE filled_before + ratio * still_open >= budget),
goals AS (
  SELECT known, source, source_size, CASE WHEN lv IS NULL THEN most ELSE least(most, lv * weight) END AS target
  FROM summed LEFT JOIN level ON true),
cut AS (
  SELECT b.doc_id, b.size, g.source_size, g.target,
         CASE WHEN g.source_size > 0 THEN floor(g.target)::BIGINT // g.source_size ELSE 0 END AS whole,
         floor(g.target)::BIGINT AS words,
         coalesce(sum(b.size) OVER (PARTITION BY b.known, b.source ORDER BY b.key, b.doc_id, b.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS run
  FROM base b JOIN goals g ON b.known = g.known AND b.source = g.source)
SELECT doc_id, size, source_size, target,
       (whole * size + greatest(0, least(size, words - whole * source_size - run)))::BIGINT AS taken
FROM cut
"""
