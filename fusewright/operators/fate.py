"""Fates: the name of the step that discarded a row, or none. Steps return a new fate column; the first one wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE = "none"


def _true(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def discard(df: DataFrame, name: str, condition: Column) -> DataFrame:
    return df.withColumn("fate", F.when((F.col("fate") == NONE) & _true(condition), F.lit(name)).otherwise(F.col("fate")))


def discard_all(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """Several stateless steps in one projection: the first rule that holds names the fate."""
    fate = F.coalesce(*[F.when(_true(p), F.lit(n)) for n, p in rules], F.lit(NONE))
    return df.withColumn("fate", F.when(F.col("fate") == NONE, fate).otherwise(F.col("fate")))


def recover(df: DataFrame, fates: Sequence[str], condition: Column) -> DataFrame:
    return df.withColumn("fate", F.when(F.col("fate").isin(*fates) & _true(condition), F.lit(NONE)).otherwise(F.col("fate")))
