"""Joins that hold when one key has a large share of the rows, and joins that check what they assume."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], rows_per_task: int = 200_000) -> DataFrame:
    """Inner equi-join in which no key of ``left`` sends more than ``rows_per_task`` rows to a task.

    Keys above that bound are counted first (the count is combined before its
    shuffle); their left rows are salted by content and their right rows sent
    to each salt.  All other keys are joined once, as usual.  Null keys match
    nothing; columns other than ``keys`` must differ between the sides.
    """
    keys = list(keys)
    hot = (
        left.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("__n"))
        .where(F.col("__n") > rows_per_task)
        .select(*keys, F.ceil(F.col("__n") / rows_per_task).cast("int").alias("__salts"))
    )
    one = F.coalesce(F.col("__salts"), F.lit(1))
    rest = [c for c in left.columns if c not in keys]
    spread = F.xxhash64(*rest) if rest else F.monotonically_increasing_id()
    a = left.join(hot, keys, "left").withColumn("__salt", F.pmod(spread, one.cast("bigint")).cast("int")).drop("__salts")
    b = right.join(hot, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), one - 1))).drop("__salts")
    return a.join(b, [*keys, "__salt"]).drop("__salt")
