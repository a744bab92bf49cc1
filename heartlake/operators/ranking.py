"""Ranks within groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .joins import salted_join
from .quantiles import order_bucket


def rank_min(group: Sequence[str], value: Column, descending: bool = True) -> Column:
    """Ranks from 1 within a group; equals share the smallest."""
    order = value.desc_nulls_last() if descending else value.asc_nulls_last()
    return F.rank().over(Window.partitionBy(*group).orderBy(order))


def rank_average(group: Sequence[str], value: str, descending: bool = True) -> Column:
    """Ranks from 1 within a group; equals share the average."""
    same = F.count(F.lit(1)).over(Window.partitionBy(*group, value))
    return rank_min(group, F.col(value), descending) + (same - 1) / F.lit(2.0)


def against_baseline(group: Sequence[str], value: str, is_baseline: Column) -> Column:
    """``value`` less the baseline row's value of the same group; null if there is no baseline."""
    base = F.max(F.when(is_baseline, F.col(value))).over(Window.partitionBy(*group))
    return F.col(value) - base


def share_of_total(group: Sequence[str], value: str) -> Column:
    """``value`` as a share of its group's sum; null if the sum is zero."""
    return F.try_divide(F.col(value), F.sum(value).over(Window.partitionBy(*group)))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    return top_per_group(df, keys, order, 1)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; each partition drops the others before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__no", F.row_number().over(w)).where(F.col("__no") <= n).drop("__no")


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` random but repeatable rows: those of smallest digest; each partition keeps only its own ``n`` best."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}_"), F.col(key).cast("string"))), key).limit(n)


def place_by_hash(df: DataFrame, group: Sequence[str], key: str, seed: int = 42, place: str = "place", bits: int = 10) -> DataFrame:
    """Random but repeatable places from 1 within each group.

    Rows are ordered by a hash of ``key``, which must be unique in a group.
    They are ranked within buckets of the leading hash bits, and a small table
    of bucket sizes adds what lies before, so no group is sorted in one task.
    """
    hashed = df.withColumn("__h", F.xxhash64(F.lit(seed), key)).withColumn("__b", F.shiftrightunsigned("__h", 64 - bits))
    sizes = hashed.groupBy(*group, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    sizes = sizes.withColumn("__before", F.sum("__n").over(before) - F.col("__n")).drop("__n")
    inside = Window.partitionBy(*group, "__b").orderBy("__h", key)
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*group, "__b"]]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    placed = hashed.withColumn("__r", F.row_number().over(inside)).alias("a").join(sizes.alias("b"), cond)
    return placed.select(*[F.col(f"a.{c}").alias(c) for c in df.columns], (F.col("a.__r") + F.col("b.__before")).alias(place))


def running_total(df: DataFrame, order: Sequence[Column], value: str, out: str) -> DataFrame:
    """``df`` with ``out``, the sum of ``value`` in all rows before in a total order.

    Sums run within range partitions; the partitions' own sums are the only
    small table, so no task sorts all rows.
    """
    placed = cut(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    own = Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    parts = placed.groupBy("__p").agg(F.sum(value).alias("__s"))
    parts = parts.select("__p", (F.sum("__s").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__s")).alias("__before"))
    return placed.withColumn(out, F.sum(value).over(own) - F.col(value)).join(F.broadcast(parts), "__p").withColumn(out, F.col(out) + F.col("__before")).drop("__p", "__before")


def ranked(df: DataFrame, group: Sequence[str], value: str, out: str = "rank", average: bool = False, descending: bool = True) -> DataFrame:
    """``df`` with the rank of ``value``, a number, from 1 within its group; equals share the smallest, or the ``average``.

    As ``rank_min`` and ``rank_average``, for groups too large to be sorted in
    one task: equal values are counted before the shuffle, ranked within buckets
    of their size, and the buckets' sums add what lies before.  Nulls rank last;
    rows are matched to the ranks of their values with hot values salted.
    """
    key = F.to_json(F.struct(*[F.col(g) for g in group], F.col(value).cast("double").alias(f"__{value}")), {"ignoreNullFields": "false"})
    v = F.col(value).cast("double")
    per = df.groupBy(*group, v.alias("__v"), key.alias("__k")).agg(F.count(F.lit(1)).alias("__n")).withColumn("__b", F.when(F.isnan("__v"), F.lit(1 << 40)).when(F.col("__v").isNotNull(), order_bucket(F.col("__v"), 128)))
    down = (lambda c: F.col(c).desc_nulls_last()) if descending else (lambda c: F.col(c).asc_nulls_last())
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    sizes = per.groupBy(*group, "__b").agg(F.sum("__n").alias("__m"))
    sizes = sizes.withColumn("__before", F.sum("__m").over(before(Window.partitionBy(*group).orderBy(down("__b")))) - F.col("__m")).drop("__m")
    inside = F.sum("__n").over(before(Window.partitionBy(*group, "__b").orderBy(down("__v")))) - F.col("__n")
    same = F.lit(True)
    for c in [*group, "__b"]:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"s.{c}"))
    rank = F.col("__before") + F.col("__inside") + 1
    rank = rank + (F.col("__n") - 1) / F.lit(2.0) if average else rank
    ranks = per.withColumn("__inside", inside).alias("a").join(sizes.alias("s"), same).select("__k", rank.alias(out))
    return salted_join(df.withColumn("__k", key), ranks, ["__k"]).drop("__k")
