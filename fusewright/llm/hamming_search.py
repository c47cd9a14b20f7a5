"""Exact top-k search over binary codes by incremental multi-index hashing.

A 64-bit code is cut into segments, and an index files each distinct code under each of its
segments. Two codes at distance d differ by at most d / segments in one segment at least. So
after all segments have been looked up within radius r, every code up to distance
segments * (r + 1) - 1 has been seen; a query is done once its kth distance is no more than that,
and only the others go on to radius r + 1.
"""

from __future__ import annotations

from itertools import combinations
from math import log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settled

BITS = 64


def code_of(vector: Column) -> Column:
    """The signs of the first 64 numbers, as a long (bit i: number i is over 0; missing ones and nulls: 0); null for null."""
    at = F.transform(F.slice(vector, 1, BITS), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
    return F.aggregate(at, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))


def segments(count: int) -> list[tuple[int, int]]:
    """(shift, width) of segments two bits narrower than the logarithm of the number of codes.

    A looked-up value and a code found cost a row each; with segments as wide as the logarithm most
    of the rows would be values that no code has.
    """
    m = min(16, max(2, round(BITS / max(4.0, log2(max(2, count)) - 2))))
    edges = [BITS * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _part(code: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(code, shift).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))


def search(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """rows and queries (vec_id, embedding) -> query_id, rank, vec_id, distance: the k nearest of other ids, ties by id.

    Equal codes are one entry of the index, with their k + 1 least ids, so copies cost nothing and
    lose nothing. Null embedding: in no result, and no query. Null vec_id: not indexed, no query.
    Repeated rows: an id appears once. Fewer than k other ids: all of them. Empty tables: empty.
    """
    items = rows.where("vec_id is not null and embedding is not null").select("vec_id", code_of(F.col("embedding")).alias("code"))
    ask = queries.where("vec_id is not null and embedding is not null").select(F.col("vec_id").alias("query_id"), code_of(F.col("embedding")).alias("q")).distinct()
    ranked = items.distinct().withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    codes = settled(ranked.groupBy("code").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    total = codes.count()
    parts = segments(total)
    m = len(parts)
    entry = lambda c: F.explode(F.array(*[F.struct(F.lit(i).alias("seg"), _part(c, *p).alias("val")) for i, p in enumerate(parts)]))
    index = settled(codes.select("code", F.element_at("ids", 1).alias("least"), entry(F.col("code")).alias("at")).select("code", "least", "at.seg", "at.val"))
    active = settled(ask.select("q").distinct())
    best, done = None, None
    order = Window.partitionBy("q").orderBy("dist", "least", "code")
    for r in range(max(w for _, w in parts) + 1):
        masks = F.array(*[F.array(*[F.lit(sum(1 << i for i in c)).cast("bigint") for c in combinations(range(w), r)]) if w >= r else F.array().cast("array<bigint>") for _, w in parts])
        probes = active.select("q", entry(F.col("q")).alias("at")).select("q", "at.seg", "at.val", F.explode(masks[F.col("at.seg")]).alias("mask"))
        hits = probes.select("q", "seg", F.col("val").bitwiseXOR(F.col("mask")).alias("val")).join(index, ["seg", "val"]).select("q", "code", "least").distinct()
        found = hits.withColumn("dist", F.bit_count(F.col("q").bitwiseXOR(F.col("code"))))
        if best is not None:
            found = found.unionByName(best.join(active, "q", "left_semi")).distinct()
        best = settled(found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).drop("n"))
        # k + 1 codes hold at least k other ids, whatever the query's own is
        covered = best.groupBy("q").agg(F.count("*").alias("n"), F.max("dist").alias("far")).where(
            (F.col("n") >= min(k + 1, total)) & ((F.col("far") <= m * (r + 1) - 1) | (F.lit(total) <= k + 1))
        )
        ready = best.join(covered.select("q"), "q", "left_semi")
        done = ready if done is None else done.unionByName(ready)
        active = settled(active.join(covered.select("q"), "q", "left_anti"))
        if active.isEmpty():
            break
    every = done.join(codes, "code").select("q", "dist", F.explode("ids").alias("vec_id"))
    named = ask.join(every, "q").where("query_id <> vec_id")
    return (
        named.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "vec_id")))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("bigint").alias("rank"), "vec_id", F.col("dist").cast("bigint").alias("distance"))
    )


#: search() for the rows whose id is divisible by 50 against all rows of embeddings, k = 10, for DuckDB.
ORACLE = """
WITH signs AS (SELECT DISTINCT vec_id, list_transform(embedding[1:64], lambda x: coalesce(x > 0, false)) AS s FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
pairs AS (
  SELECT q.vec_id AS query_id, r.vec_id, list_sum(list_transform(list_zip(q.s, r.s), lambda x: (coalesce(x[1], false) <> coalesce(x[2], false))::BIGINT))::BIGINT AS distance
  FROM signs q JOIN signs r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank, vec_id, distance
FROM pairs QUALIFY rank <= 10
"""
