"""Rows given more than once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import first_per_key


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in ``order``; null keys are a key."""
    return first_per_key(df, keys, order)


def conflicting(df: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Keys whose rows disagree in any of ``values``; a null differs from any value."""
    unlike = [(F.min(F.struct(F.col(v).isNull(), F.col(v))) < F.max(F.struct(F.col(v).isNull(), F.col(v)))) for v in values]
    any_unlike = unlike[0]
    for u in unlike[1:]:
        any_unlike = any_unlike | u
    return df.groupBy(key).agg(any_unlike.alias("__differ"), F.count(F.lit(1)).alias("rows")).where("__differ").select(key, "rows")


def exact_copies(df: DataFrame, id_col: str, content: str) -> DataFrame:
    """``content_hash, rows, first_id`` of contents that occur more than once; nulls aren't copies."""
    return (
        df.where(F.col(content).isNotNull())
        .groupBy(F.sha2(F.col(content).cast("string"), 256).alias("content_hash"))
        .agg(F.count(F.lit(1)).alias("rows"), F.min(id_col).alias("first_id"))
        .where(F.col("rows") > 1)
    )
