"""Scores of predictions and of matrices of scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coerce import finite, ratio
from .quantiles import order_bucket


def auroc(df: DataFrame, group: Sequence[str], truth: str, score: str, weight: str | None = None) -> DataFrame:
    """Area under the ROC curve per group: ``group, auroc, positives, negatives``.

    Equal scores count half.  The area is null where only one class is present.
    Rows with a null truth or a score that isn't finite are left out.
    ``weight`` counts a row that many times, as in a bootstrap draw.

    Rows are counted per (group, score) before the shuffle.  Scores are ranked
    within buckets of the score's size, and what lies below a bucket comes from
    the buckets' sums, so a group that holds most rows is spread over many tasks.
    """
    group = list(group)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    y = F.col(truth).cast("double")
    value = F.col(score).cast("double")
    per = (
        df.where(F.col(truth).isNotNull() & finite(F.col(score)))
        .groupBy(*group, order_bucket(value, 128).alias("__b"), value.alias("__s"))
        .agg(F.sum(y * w).alias("__p"), F.sum((F.lit(1.0) - y) * w).alias("__n"))
    )
    whole, upto = Window.partitionBy(*group), Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    buckets = per.groupBy(*group, "__b").agg(F.sum("__p").alias("__bp"), F.sum("__n").alias("__bn"))
    buckets = buckets.select(*group, "__b", (F.sum("__bn").over(upto) - F.col("__bn")).alias("__below"), F.sum("__bp").over(whole).alias("__all_p"), F.sum("__bn").over(whole).alias("__all_n"))
    inside = Window.partitionBy(*group, "__b").orderBy("__s").rowsBetween(Window.unboundedPreceding, 0)
    won = per.withColumn("__inside", F.sum("__n").over(inside) - F.col("__n") / F.lit(2.0)).alias("a")
    same = F.lit(True)
    for c in [*group, "__b"]:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    out = won.join(buckets.alias("b"), same).select(*[F.col(f"a.{c}").alias(c) for c in group], (F.col("__p") * (F.col("__below") + F.col("__inside"))).alias("__won"), "__all_p", "__all_n")
    return (
        out.groupBy(*group)
        .agg(F.sum("__won").alias("__won"), F.max("__all_p").alias("__all_p"), F.max("__all_n").alias("__all_n"))
        .select(*group, F.try_divide(F.col("__won"), F.col("__all_p") * F.col("__all_n")).alias("auroc"), F.col("__all_p").cast("bigint").alias("positives"), F.col("__all_n").cast("bigint").alias("negatives"))
    )


def macro_auroc(per_class: DataFrame, group: Sequence[str]) -> DataFrame:
    """Mean over the classes whose area is defined; null if none is."""
    return per_class.groupBy(*group).agg(F.avg("auroc").alias("macro_auroc"), F.count("auroc").alias("defined_classes"))


def prevalence(df: DataFrame, group: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """Positives and their share per group and label, in long form; null labels are left out."""
    long = df.select(*group, F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).cast("int").alias("y")) for c in labels])).alias("x")).select(*group, "x.*").where(F.col("y").isNotNull())
    return long.groupBy(*group, "label").agg(F.sum("y").cast("bigint").alias("positives"), F.count(F.lit(1)).alias("rows"), F.avg(F.col("y").cast("double")).alias("prevalence"))


def positive_weights(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Negatives per positive of each label; a label without positives raises."""
    p = prevalence(df, [], labels)
    none = F.raise_error(F.concat(F.lit("no positive of "), F.col("label"))).cast("double")
    return p.select("label", F.when(F.col("positives") == 0, none).otherwise((F.col("rows") - F.col("positives")) / F.col("positives")).alias("weight"))


def sem(value: str) -> Column:
    """Standard error of the mean; null for fewer than two values."""
    return F.when(F.count(value) > 1, F.stddev_samp(value) / F.sqrt(F.count(value).cast("double")))


def generalization_gap(cells: DataFrame, group: Sequence[str], metric: str, source: str = "source_dataset", target: str = "target_dataset") -> DataFrame:
    """Mean on the diagonal, mean off it and their difference, over complete cells with a finite metric."""
    own = F.col(source) == F.col(target)
    ok = cells.where(finite(F.col(metric)))
    if "status" in cells.columns:
        ok = ok.where(F.col("status") == "COMPLETE")
    return (
        ok.groupBy(*group)
        .agg(
            F.avg(F.when(own, F.col(metric))).alias("in_distribution_mean"),
            F.avg(F.when(~own, F.col(metric))).alias("cross_dataset_mean"),
            F.count_if(own).alias("in_distribution_cells"),
            F.count_if(~own).alias("cross_dataset_cells"),
        )
        .withColumn("generalization_gap", F.col("in_distribution_mean") - F.col("cross_dataset_mean"))
    )


def compare_gaps(five: Column, binary: Column) -> list[Column]:
    """Absolute and relative disappearance of a gap; the latter is null for a gap of zero."""
    return [(five - binary).alias("gap_reduction"), (ratio(five - binary, five) * F.lit(100.0)).alias("gap_reduction_percent")]


def kendall_tau(pairs: DataFrame, group: Sequence[str], item: str, x: str, y: str) -> DataFrame:
    """Kendall's tau-b of two rankings of a group's items; null if either has only ties.

    Compares the items of a group pairwise; the groups are rankings of models,
    a handful of items each.
    """
    a, b = pairs.alias("a"), pairs.alias("b")
    cond = F.col(f"a.{item}") < F.col(f"b.{item}")
    for g in group:
        cond = cond & (F.col(f"a.{g}") == F.col(f"b.{g}"))
    dx, dy = F.signum(F.col(f"a.{x}") - F.col(f"b.{x}")), F.signum(F.col(f"a.{y}") - F.col(f"b.{y}"))
    return (
        a.join(b, cond)
        .select(*[F.col(f"a.{g}").alias(g) for g in group], dx.alias("dx"), dy.alias("dy"))
        .groupBy(*group)
        .agg(F.try_divide(F.sum(F.col("dx") * F.col("dy")), F.sqrt(F.sum(F.abs("dx")) * F.sum(F.abs("dy")))).alias("kendall_tau"))
    )


def sign_flip_p(df: DataFrame, group: Sequence[str], item: str, difference: str, slack: float = 1e-15) -> DataFrame:
    """Exact paired sign-flip test: ``group, n_pairs, mean_difference, p_value``.

    Every sign pattern of the group's ``n`` differences is tried, so ``n`` is
    held to 20; larger groups raise.
    """
    w = Window.partitionBy(*group).orderBy(item)
    n = F.count(F.lit(1)).over(Window.partitionBy(*group))
    rows = df.where(finite(F.col(difference))).select(*group, F.col(difference).cast("double").alias("d"), (F.row_number().over(w) - 1).alias("bit"), n.alias("n"))
    limit = F.when(F.col("n") > 20, F.raise_error(F.lit("more than 20 pairs in an exact test")).cast("bigint")).otherwise(F.pow(F.lit(2), F.col("n")).cast("bigint"))
    flips = rows.withColumn("pattern", F.explode(F.sequence(F.lit(0).cast("bigint"), limit - 1)))
    signed = F.when(F.expr("(shiftright(pattern, bit) & 1) = 1"), -F.col("d")).otherwise(F.col("d"))
    means = flips.groupBy(*group, "pattern").agg((F.sum(signed) / F.max("n")).alias("m"), F.max("n").alias("n"))
    observed = F.max(F.when(F.col("pattern") == 0, F.col("m"))).over(Window.partitionBy(*group))
    return (
        means.withColumn("observed", observed)
        .groupBy(*group)
        .agg(
            F.max("n").alias("n_pairs"),
            F.max("observed").alias("mean_difference"),
            (F.count_if(F.abs("m") >= F.abs(F.col("observed")) - slack) / F.count(F.lit(1))).alias("p_value"),
        )
    )
