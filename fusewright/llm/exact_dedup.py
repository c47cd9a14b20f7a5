"""Exact deduplication by progressive refinement, with DataFrame functions only.

Texts are grouped by length, what shares a length by a hash of its first characters, and what
shares that too by a hash of the full text. Between the rounds a sieve, a bitmap of fixed size,
tells each row whether its group may have another member; rows it lets go are alone for certain
and their content isn't read further. Only narrow rows are shuffled, never texts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settled, unused, with_groups

#: Characters of the prefix that is hashed.
PREFIX = 256
#: Bits of a sieve: 16 MB in all, whatever the input.
SIEVE_BITS = 1 << 27


def sieve(groups: DataFrame, keys: Sequence[str], bits: int = SIEVE_BITS) -> DataFrame:
    """One bit for each of the given groups, at the place that its keys' hash names: rows (_bucket, _bits), at most bits / 8 bytes."""
    place = F.pmod(F.xxhash64(*keys), F.lit(bits))
    return groups.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("_bits"))


def may_repeat(rows: DataFrame, keys: Sequence[str], holes: DataFrame, flag: str, bits: int = SIEVE_BITS) -> DataFrame:
    """rows with flag: false where no group of the sieve can be the row's."""
    place = F.pmod(F.xxhash64(*keys), F.lit(bits))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    joined = rows.withColumn("_bucket", F.bitmap_bucket_number(place)).join(F.broadcast(holes), "_bucket", "left")
    return joined.withColumn(flag, F.coalesce(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1, F.lit(False))).drop("_bucket", "_bits")


def exact_dedup(docs: DataFrame, carry: Sequence[Column] = (), prefix: int = PREFIX, bits: int = SIEVE_BITS) -> DataFrame:
    """Per row of docs: doc_id, keep_id, group_size, kept, and what carry names (columns _0, _1, ...).

    Texts are equal when identical (null counts as empty). Of equal texts the row with the largest
    doc_id stays (null: the least of all); of rows alike in text and doc_id, ties, one stays. A text
    without an equal stays with group_size 1. Very long texts are hashed whole. Repeated rows are
    members like others. Empty table: empty result. Other columns are ignored, whatever their names.
    Groups of any size: counts are combined before the shuffle, and a large group's rows stay where
    they are.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    # first reading: lengths and prefix hashes, no ids and no texts
    sketch = settled(docs.select(F.octet_length(text).alias("length"), F.xxhash64(F.substring(text, 1, prefix)).alias("head")))
    lengths = sketch.groupBy("length").agg(F.count("*").alias("n")).where("n > 1")
    alike = may_repeat(sketch, ["length"], sieve(lengths, ["length"], bits), "may", bits).where("may").drop("may")
    heads = alike.groupBy("length", "head").agg(F.count("*").alias("n")).where("n > 1")
    # second reading: full content is hashed for rows whose length and prefix another row may share
    read = docs.select(
        "doc_id",
        text.alias("text"),
        F.octet_length(text).alias("length"),
        F.xxhash64(F.substring(text, 1, prefix)).alias("head"),
        *(c.alias(f"_{i}") for i, c in enumerate(carry)),
    )
    carried = [f"_{i}" for i in range(len(carry))]
    hashed = may_repeat(read, ["length", "head"], sieve(heads, ["length", "head"], bits), "may", bits)
    rows = settled(hashed.select("doc_id", "length", F.when(F.col("may"), F.unhex(F.sha2("text", 256))).alias("full"), F.monotonically_increasing_id().alias("row"), *carried))
    best = F.max(F.struct(F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row")))  # a null id is less than any
    read_on = rows.where("full is not null")
    groups = settled(read_on.groupBy("full").agg(F.count("*").alias("group_size"), best.alias("best")).where("group_size > 1").select("full", "group_size", "best.*"))
    alone = [F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")]
    met = with_groups(read_on, groups, ["full"], "group_size")
    single = F.col("group_size").isNull()
    several = met.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("row") == F.col("keep_row"))).alias("kept"),
        *carried,
    )
    return rows.where("full is null").select("doc_id", *alone, *carried).unionByName(several)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with their columns, whatever their names; see exact_dedup for nulls, ties and empty tables."""
    held = unused(docs, "row_of_docs")
    columns = [f"`{c.replace('`', '``')}`" for c in docs.columns]
    whole = exact_dedup(docs.withColumn(held, F.struct(*columns)), carry=(F.col(held),)).where("kept")
    return whole.select("_0.*")


#: exact_dedup() with the text's digest over the table documents, for DuckDB.
ORACLE = r"""
WITH base AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
groups AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM base GROUP BY text_sha256)
SELECT b.doc_id, g.keep_id, g.group_size, b.doc_id = g.keep_id AS kept, b.text_sha256
FROM base b JOIN groups g ON b.text_sha256 = g.text_sha256
"""
