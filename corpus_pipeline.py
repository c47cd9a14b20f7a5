"""The corpus pipeline: toxicity, near duplicates, secrets, mixing, packing, each stage's table written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fusewright.llm import mixing, ngram_join, packing, secrets, toxicity
from fusewright.llm.common import Scratch, columns_of, settled, table, unused

#: SQL can't express learnt scores, formats and token ids.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is 0.5 or more go; all others stay as they are, null and empty texts too.

    Very long texts are scored whole. Repeated rows share their score. Empty table: empty result.
    Columns of any names stay.
    """
    score = unused(docs, "toxic_score")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_column(docs, model, keep=score).where(F.col(score) < 0.5).select(*columns_of(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component one document stays, that of the least doc_id; see ngram_join.one_of_each for nulls, ties and names.

    Documents without words stay. Very long texts are compared whole. Empty table: empty result.
    """
    return ngram_join.one_of_each(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each secret's span is replaced by its kind in brackets; every document stays.

    Null texts stay null; very long ones are scanned whole. Repeated rows stay alike. n_chars, if
    there is one, follows the text. Empty table: empty result. Columns of any names stay.
    """
    return secrets.redact(docs)


def _unhashable(t: T.DataType) -> bool:
    """Whether a type is or holds a map or a variant, which have no hash."""
    if isinstance(t, T.ArrayType):
        return _unhashable(t.elementType)
    if isinstance(t, T.StructType):
        return any(_unhashable(f.dataType) for f in t)
    return isinstance(t, (T.MapType, T.VariantType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, the last time perhaps only its first words; those not taken go.

    Each row is taken by itself, whatever its doc_id: null and repeated ids, and rows alike in all
    columns. Documents without words have nothing to take, so they go. n_chars, if there is one,
    follows the text. Very long texts are cut at a word like others. Empty table: empty result.
    Columns of any names stay.
    """
    a, b, size, taken, copy = (unused(docs, x) for x in ("row_a", "row_b", "row_size", "row_taken", "row_copy"))
    hashed = [F.to_json(F.struct(c.alias("v"))) if _unhashable(f.dataType) else c for c, f in zip(columns_of(docs), docs.schema)]
    keyed = docs.withColumns({a: F.xxhash64(F.lit(1), *hashed), b: F.xxhash64(F.lit(2), *hashed)})
    mixed = mixing.mix(keyed, carry=(F.col(a), F.col(b))).where("taken > 0")
    mixed = mixed.select(F.col("_0").alias(a), F.col("_1").alias(b), F.col("size").alias(size), F.col("taken").alias(taken))
    rows = keyed.dropDuplicates([a, b]).join(mixed, [a, b]).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col(taken) / F.col(size)))))
    words = F.least(F.col(size), F.col(taken) - (F.col(copy) - 1) * F.col(size))
    pieces = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    cut = F.when(words >= F.col(size), F.col("text")).otherwise(F.array_join(F.slice(pieces, F.lit(1), words.cast("int")), ""))
    rows = rows.withColumn("text", cut)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*columns_of(docs))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens; packing.pack says what nulls, ties and names mean."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; what each keeps is written to the shared folder and read as the next one's docs."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    out = settled(docs)
    scratch.drop()
    return out
