"""Exact quantiles per group without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_bucket(value: Column, per_octave: int) -> Column:
    """A bucket number that never decreases as ``value`` grows."""
    size = F.floor(F.log2(F.least(F.abs(value), F.lit(1.7e308))) * F.lit(float(per_octave))).cast("long") + F.lit(2000 * per_octave)
    return F.when(value == 0, F.lit(0)).when(value > 0, size + 1).otherwise(-size - 1)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], per_octave: int = 512) -> DataFrame:
    """Linear-interpolated quantiles (``numpy.quantile``'s default) of each group.

    Equal values are counted together before the first shuffle.  A histogram
    over ordered buckets then tells in which bucket each wanted rank lies, and
    only those buckets are ranked value by value, so a group that holds a third
    of all rows is spread over its buckets.  Null and NaN values are left out;
    a group without other values gives no row.

    Returns ``keys``, one column per entry of ``probs`` and ``n_values``.
    """
    keys = list(keys)
    v, n, b, r = "__v", "__n", "__b", "__r"
    counted = (
        df.where(F.col(value).isNotNull() & ~F.isnan(value))
        .groupBy(*keys, F.col(value).cast("double").alias(v))
        .agg(F.count(F.lit(1)).alias(n))
        .withColumn(b, order_bucket(F.col(v), per_octave))
    )
    w = Window.partitionBy(*keys).orderBy(b)
    histogram = (
        counted.groupBy(*keys, b)
        .agg(F.sum(n).alias(n))
        .withColumn("__to", F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("__total", F.sum(n).over(Window.partitionBy(*keys)))
        .withColumn("__from", F.col("__to") - F.col(n))
    )
    wanted = []
    for name, p in probs.items():
        at = (F.col("__total") - 1).cast("double") * F.lit(float(p))
        wanted += [F.struct(F.lit(name).alias("q"), F.lit(k).alias("end"), f(at).cast("long").alias("rank"), (at - F.floor(at)).alias("part")) for k, f in (("lo", F.floor), ("hi", F.ceil))]
    ranks = (
        histogram.withColumn(r, F.explode(F.array(*wanted)))
        .where((F.col(f"{r}.rank") >= F.col("__from")) & (F.col(f"{r}.rank") < F.col("__to")))
        .select(*keys, b, "__from", "__total", r)
    )
    inside = Window.partitionBy(*keys, b).orderBy(v).rowsBetween(Window.unboundedPreceding, 0)
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"k.{k}")) for k in [*keys, b]]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    needed = ranks.select(*keys, b).distinct()
    ranked = (
        counted.alias("c")
        .join(needed.alias("k"), cond, "left_semi")
        .withColumn("__up", F.sum(n).over(inside))
    )
    hit = (
        ranked.alias("c")
        .join(ranks.alias("k"), cond)
        .where((F.col(f"k.{r}.rank") - F.col("k.__from") < F.col("c.__up")) & (F.col(f"k.{r}.rank") - F.col("k.__from") >= F.col("c.__up") - F.col(f"c.{n}")))
        .select(*[F.col(f"c.{k}").alias(k) for k in keys], F.col(f"c.{v}").alias(v), F.col("k.__total").alias("__total"), F.col(f"k.{r}").alias(r))
    )

    def end(name: str, side: str) -> Column:
        return F.max(F.when((F.col(f"{r}.q") == name) & (F.col(f"{r}.end") == side), F.col(v)))

    def part(name: str) -> Column:
        return F.max(F.when(F.col(f"{r}.q") == name, F.col(f"{r}.part")))

    out = [(end(q, "lo") + (end(q, "hi") - end(q, "lo")) * part(q)).alias(q) for q in probs]
    return hit.groupBy(*keys).agg(*out, F.max("__total").alias("n_values"))
