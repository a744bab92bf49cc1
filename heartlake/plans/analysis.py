"""What a set of matrices says: gaps, composite scores, attribution, sensitivity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.coerce import clip, ratio
from ..functions.names import CLASS_NAMES
from ..operators.checks import join_checked, require_columns, require_rows, require_unique
from ..operators.metrics import auroc, compare_gaps, generalization_gap, kendall_tau, sem, sign_flip_p
from ..operators.ranking import against_baseline, rank_average, rank_min, share_of_total
from ..session import cut
from .labels import collapse_probability, mapping_pieces, of_variants
from .matrix import CELL

SHIFTS = ("PS", "DS", "LS")
WEIGHTS = (1.0, 2.0, 3.0)


def gaps_and_shifts(cells: DataFrame, shifts: DataFrame, metric: str = "macro_auroc") -> DataFrame:
    """Off-diagonal cells with their source's own score, the gap to it, and the pair's shift vector.

    The own score is a window over the cells of an architecture and source, so
    no table is joined to itself.  A cell without it or without a shift vector
    raises, as does a repeated cell or pair or a flag that is neither 0 nor 1.
    """
    require_columns(cells, ["architecture", *CELL, metric], "cells")
    require_columns(shifts, [*CELL, *SHIFTS], "shifts")
    # both are small results of large scans; the checks must not run those again
    cells, shifts = cut(cells), cut(shifts)
    require_unique(cells, ["architecture", *CELL], "cells")
    require_rows(shifts, {s: F.col(s).isin(0, 1) for s in SHIFTS}, "shifts")
    w = Window.partitionBy("architecture", "source_dataset")
    own = F.max(F.when(F.col("source_dataset") == F.col("target_dataset"), F.col(metric))).over(w)
    off = cells.withColumn("in_distribution_auroc", own).where(F.col("source_dataset") != F.col("target_dataset"))
    both = join_checked(off, shifts.select(*CELL, *SHIFTS), list(CELL), "left", "many_to_one", complete=["in_distribution_auroc", *SHIFTS])
    return both.withColumn("delta_ij", F.col("in_distribution_auroc") - F.col(metric)).withColumn("w_ij", _weight(*WEIGHTS)).withColumn("shift_vector", F.struct(*SHIFTS))


def _weight(ps: float | Column, ds: float | Column, ls: float | Column) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return lit(ps) * F.col("PS") + lit(ds) * F.col("DS") + lit(ls) * F.col("LS")


def _composite(metric: str, weight: Column) -> Column:
    penalty = F.avg(F.col("delta_ij") / (weight + F.lit(1.0)))
    return clip(F.avg(metric) * (F.lit(1.0) - penalty), 0, 1)


def composite_scores(off: DataFrame, weights: tuple[float, float, float] = WEIGHTS, metric: str = "macro_auroc") -> DataFrame:
    """Per architecture: mean score and gap off the diagonal, and the score less its weighted gaps, in [0, 1]."""
    if min(weights) < 0:
        raise ValueError("weights must not be negative")
    return off.groupBy("architecture").agg(F.avg(metric).alias("mean_cross_dataset_auroc"), F.avg("delta_ij").alias("mean_cross_dataset_gap"), _composite(metric, _weight(*weights)).alias("composite_score"))


def weight_sweep(off: DataFrame, grid: Sequence[float] = (0.5, 1.0, 2.0, 3.0), metric: str = "macro_auroc") -> DataFrame:
    """Composite scores and ranks for every triple of weights, and how the ranking agrees with 1/2/3.

    All triples are one aggregate over cells times triples: cells are a few
    hundred rows, whatever the predictions behind them.
    """
    spark: SparkSession = off.sparkSession
    values = sorted({float(v) for v in grid})
    if not values or values[0] < 0:
        raise ValueError("weights must not be negative")
    triples = [(i + 1, a, b, c) for i, (a, b, c) in enumerate((a, b, c) for a in values for b in values for c in values)]
    sweep = spark.createDataFrame([*triples, (0, *WEIGHTS)], "sweep_id int, lambda_ps double, lambda_ds double, lambda_ls double")
    each = off.select("architecture", metric, "delta_ij", *SHIFTS, F.explode(F.array(*[F.lit(t[0]) for t in [*triples, (0,)]])).alias("sweep_id")).join(F.broadcast(sweep), "sweep_id")
    scores = each.groupBy("sweep_id", "lambda_ps", "lambda_ds", "lambda_ls", "architecture").agg(_composite(metric, _weight(F.col("lambda_ps"), F.col("lambda_ds"), F.col("lambda_ls"))).alias("composite_score"))
    ranked = cut(scores).withColumn("rank", rank_average(["sweep_id"], "composite_score"))
    base = F.max(F.when(F.col("sweep_id") == 0, F.col("rank"))).over(Window.partitionBy("architecture"))
    ranked = ranked.withColumn("base_rank", base).where(F.col("sweep_id") > 0)
    tau = kendall_tau(ranked, ["sweep_id"], "architecture", "base_rank", "rank")
    return ranked.drop("base_rank").join(tau, "sweep_id", "left")


def shift_groups(off: DataFrame, metric: str = "macro_auroc") -> DataFrame:
    """Mean gap of every shift vector within an architecture."""
    return off.groupBy("architecture", *SHIFTS).agg(F.count(F.lit(1)).alias("ordered_pair_count"), F.avg("delta_ij").alias("mean_gap"), F.stddev_samp("delta_ij").alias("std_gap"), F.avg(metric).alias("mean_cross_dataset_auroc"))


def attribution(off: DataFrame) -> DataFrame:
    """Gaps shared out among the active shifts of each cell by weight; shares add up to one, or are null for a total of zero."""
    whole = _weight(*WEIGHTS)
    parts = [F.struct(F.lit(s).alias("shift_type"), F.coalesce(ratio(F.col("delta_ij") * F.lit(w) * F.col(s), whole), F.lit(0.0)).alias("part")) for s, w in zip(SHIFTS, WEIGHTS)]
    long = off.select("architecture", F.explode(F.array(*parts)).alias("x"))
    per = long.groupBy("architecture", F.col("x.shift_type").alias("shift_type")).agg(F.sum("x.part").alias("allocated_gap_total"), F.count(F.lit(1)).alias("off_diagonal_cell_count"))
    return per.withColumn("allocated_gap_share", share_of_total(["architecture"], "allocated_gap_total"))


def paired_vector_tests(groups: DataFrame) -> DataFrame:
    """Exact sign-flip tests between the mean gaps of every two shift vectors, paired by architecture."""
    named = groups.select("architecture", F.format_string("(%d,%d,%d)", *SHIFTS).alias("vector"), "mean_gap")
    a, b = named.alias("a"), named.alias("b")
    pairs = a.join(b, (F.col("a.architecture") == F.col("b.architecture")) & (F.col("a.vector") < F.col("b.vector"))).select(F.col("a.vector").alias("left_vector"), F.col("b.vector").alias("right_vector"), F.col("a.architecture").alias("architecture"), (F.col("a.mean_gap") - F.col("b.mean_gap")).alias("difference"))
    return sign_flip_p(pairs, ["left_vector", "right_vector"], "architecture", "difference")


def gap_comparison(five: DataFrame, binary: DataFrame, metric: str = "macro_auroc", binary_metric: str = "auroc") -> DataFrame:
    """Per architecture: the gap of the five labels, of the binary one, and what of it disappears."""
    f = generalization_gap(five, ["architecture"], metric).select("architecture", F.col("generalization_gap").alias("five_label_gap"))
    b = generalization_gap(binary, ["architecture"], binary_metric).select("architecture", F.col("generalization_gap").alias("binary_gap"))
    return join_checked(f, b, ["architecture"], validate="one_to_one").select("architecture", "five_label_gap", "binary_gap", *compare_gaps(F.col("five_label_gap"), F.col("binary_gap")))


def directional_changes(cells: DataFrame, five: str = "five_auroc", binary: str = "binary_auroc") -> DataFrame:
    """Off-diagonal cells with both gaps, their change and its direction."""
    w = Window.partitionBy("architecture", "source_dataset")
    own = lambda m: F.max(F.when(F.col("source_dataset") == F.col("target_dataset"), F.col(m))).over(w)
    out = cells.withColumn("five_gap", own(five) - F.col(five)).withColumn("binary_gap", own(binary) - F.col(binary)).where(F.col("source_dataset") != F.col("target_dataset"))
    change = F.col("five_gap") - F.col("binary_gap")
    direction = F.when(change > 0, "reduced").when(change < 0, "increased").otherwise("unchanged")
    return out.select("architecture", *CELL, "five_gap", "binary_gap", change.alias("gap_reduction"), direction.alias("direction"))


def directional_summary(changes: DataFrame) -> DataFrame:
    """Per ordered pair over architectures: mean, deviation, range and directions of the change."""
    g = F.col("gap_reduction")
    mean = F.avg(g)
    return changes.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("architectures"),
        mean.alias("mean_gap_reduction"),
        F.stddev_samp(g).alias("sd_gap_reduction"),
        F.min(g).alias("min_gap_reduction"),
        F.max(g).alias("max_gap_reduction"),
        F.count_if(g > 0).alias("reduced"),
        F.count_if(g < 0).alias("increased"),
        F.when(mean > 0, "reduced").when(mean < 0, "increased").otherwise("unchanged").alias("mean_direction"),
    )


def collapsed(predictions: DataFrame, keys: Sequence[str], aggregations: Sequence[str] = ("max_abnormal", "noisy_or", "one_minus_normal")) -> DataFrame:
    """``keys, aggregation, record_count, auroc``: binary scores made of five-label predictions (``y_*``, ``p_*``), on records with any label."""
    ill = ("af_afl", "av_block_1", "lbbb", "rbbb")
    some = F.greatest(*[F.col(f"y_{x}") for x in ill])
    rows = predictions.where((some == 1) | (F.col("y_normal") == 1))
    each = [F.struct(F.lit(a).alias("aggregation"), collapse_probability(a, F.col("p_normal"), [F.col(f"p_{x}") for x in ill]).alias("p")) for a in aggregations]
    long = rows.select(*keys, some.alias("y"), F.explode(F.array(*each)).alias("x")).select(*keys, "y", "x.*")
    return auroc(long, [*keys, "aggregation"], "y", "p").select(*keys, "aggregation", (F.col("positives") + F.col("negatives")).alias("record_count"), "auroc")


def rescored(predictions: DataFrame, keys: Sequence[str], baseline: str = "base") -> DataFrame:
    """``keys, variant, macro_auroc, change``: the predictions scored against each label mapping, and the change against the baseline.

    Each different score is ranked once; variants share the areas.
    """
    per = of_variants(auroc(mapping_pieces(predictions, keys), [*keys, "piece"], "y", "p"))
    cells = per.groupBy(*keys, "variant").agg(F.avg("auroc").alias("macro_auroc"))
    return cells.withColumn("change", against_baseline(keys, "macro_auroc", F.col("variant") == baseline))


def mapping_sensitivity(predictions: DataFrame, baseline: str = "base") -> DataFrame:
    """Per architecture and label mapping: mean score across datasets, gap, rank, and change against the baseline mapping."""
    keys = ["architecture", *CELL]
    cells = rescored(predictions, keys).select(*keys, "variant", "macro_auroc")
    summary = generalization_gap(cells, ["architecture", "variant"], "macro_auroc")
    ranked = summary.withColumn("rank", rank_min(["variant"], F.col("cross_dataset_mean")))
    is_base = F.col("variant") == baseline
    return ranked.withColumn("gap_change", against_baseline(["architecture"], "generalization_gap", is_base)).withColumn("rank_change", against_baseline(["architecture"], "rank", is_base))


def model_summary(cells: DataFrame, metric: str = "macro_auroc") -> DataFrame:
    """Per architecture: mean, deviation and standard error across datasets, own mean and gap, with rank."""
    off = F.when(F.col("source_dataset") != F.col("target_dataset"), F.col(metric))
    own = F.when(F.col("source_dataset") == F.col("target_dataset"), F.col(metric))
    out = cells.select("architecture", off.alias("off"), own.alias("own")).groupBy("architecture").agg(F.avg("own").alias("in_distribution_mean"), F.avg("off").alias("cross_dataset_mean"), F.stddev_samp("off").alias("cross_dataset_sd"), sem("off").alias("cross_dataset_sem"))
    return out.withColumn("generalization_gap", F.col("in_distribution_mean") - F.col("cross_dataset_mean")).withColumn("rank", rank_min([], F.col("cross_dataset_mean")))


def target_difficulty(cells: DataFrame, metric: str = "macro_auroc") -> DataFrame:
    """Per target: mean score of models trained elsewhere, with its deviation and a 95 % interval."""
    off = cells.where(F.col("source_dataset") != F.col("target_dataset"))
    half = F.lit(1.96) * sem(metric)
    return off.groupBy("target_dataset").agg(F.count(F.lit(1)).alias("cells"), F.avg(metric).alias("mean_auroc"), F.stddev_samp(metric).alias("sd_auroc"), (F.avg(metric) - half).alias("low"), (F.avg(metric) + half).alias("high"))


def per_class(cells: DataFrame) -> DataFrame:
    """Per architecture and class: mean and deviation off the diagonal."""
    names = [f"auroc_{c}" for c in CLASS_NAMES if f"auroc_{c}" in cells.columns]
    off = cells.where(F.col("source_dataset") != F.col("target_dataset")).unpivot(["architecture"], names, "class_name", "auroc")
    return off.groupBy("architecture", F.substring("class_name", 7, 100).alias("class_name")).agg(F.count("auroc").alias("cells"), F.avg("auroc").alias("mean_auroc"), F.stddev_samp("auroc").alias("sd_auroc"))


def asymmetry(cells: DataFrame, metric: str = "macro_auroc") -> DataFrame:
    """Per unordered pair: score one way less score the other, mean and standard error over architectures."""
    a = F.least("source_dataset", "target_dataset")
    b = F.greatest("source_dataset", "target_dataset")
    both = cells.where(F.col("source_dataset") != F.col("target_dataset")).groupBy("architecture", a.alias("dataset_a"), b.alias("dataset_b")).agg(F.max(F.when(F.col("source_dataset") == a, F.col(metric))).alias("there"), F.max(F.when(F.col("source_dataset") == b, F.col(metric))).alias("back"))
    d = both.withColumn("difference", F.col("there") - F.col("back")).where(F.col("difference").isNotNull())
    return d.groupBy("dataset_a", "dataset_b").agg(F.count(F.lit(1)).alias("architectures"), F.avg("difference").alias("mean_difference"), F.stddev_samp("difference").alias("sd_difference"), sem("difference").alias("sem_difference"))


def interval_widths(intervals: DataFrame, low: str = "ci_low", high: str = "ci_high") -> DataFrame:
    """Mean and deviation of the widths of intervals per architecture and target."""
    return intervals.groupBy("architecture", "target_dataset").agg(F.avg(F.col(high) - F.col(low)).alias("mean_width"), F.stddev_samp(F.col(high) - F.col(low)).alias("sd_width"))
