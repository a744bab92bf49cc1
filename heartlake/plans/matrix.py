"""Source by target matrices of scores, with nothing hidden that is missing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coerce import no_nan
from ..functions.names import CLASS_NAMES, LABELS
from ..operators.checks import TableError, require_columns, require_unique
from ..operators.metrics import auroc, macro_auroc
from ..operators.reshape import union_by_name

CELL = ("source_dataset", "target_dataset")


def grid(spark: SparkSession, architectures: Sequence[str], datasets: Sequence[str]) -> DataFrame:
    """Every architecture with every ordered pair of datasets, the diagonal included."""
    rows = [(a, s, t) for a in architectures for s in datasets for t in datasets]
    return spark.createDataFrame(rows, "architecture string, source_dataset string, target_dataset string")


def with_blocked(cells: DataFrame, wanted: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """All wanted cells: those scored are COMPLETE, the others say why not and have null scores.

    ``blocked`` gives ``architecture, source_dataset, target_dataset, status,
    detail`` where the reason is known; without it a missing cell is NOT_RUN.
    """
    keys = ["architecture", *CELL]
    values = [c for c in cells.columns if c not in (*keys, "status", "detail")]
    done = cells.select(*keys, *[no_nan(F.col(c)).alias(c) if dict(cells.dtypes)[c] in ("double", "float") else F.col(c) for c in values], F.lit(True).alias("__done"))
    out = wanted.join(done, keys, "left")
    if blocked is not None:
        out = out.join(blocked.select(*keys, F.col("status").alias("__s"), F.col("detail").alias("__d")), keys, "left")
    else:
        out = out.withColumns({"__s": F.lit(None).cast("string"), "__d": F.lit(None).cast("string")})
    status = F.when(F.col("__done"), "COMPLETE").otherwise(F.coalesce("__s", F.lit("NOT_RUN")))
    return out.select(*keys, status.alias("status"), F.when(~F.coalesce(F.col("__done"), F.lit(False)), F.col("__d")).alias("detail"), *values)


def score_cells(predictions: DataFrame, keys: Sequence[str], label: str = "label", truth: str = "y", score: str = "p") -> DataFrame:
    """``keys, record_count, macro_auroc, auroc_<CLASS>`` from long predictions, one scan for all cells."""
    keys = list(keys)
    per = auroc(predictions, [*keys, label], truth, score)
    wide = per.groupBy(*keys).agg(
        F.max(F.col("positives") + F.col("negatives")).alias("record_count"),
        F.avg("auroc").alias("macro_auroc"),
        *[F.max(F.when(F.col(label) == x, F.col("auroc"))).alias(f"auroc_{name}") for x, name in zip(LABELS, CLASS_NAMES)],
    )
    return wide


def macro_by_cell(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, macro_auroc, defined_classes``."""
    return macro_auroc(auroc(predictions, [*keys, "label"], "y", "p"), keys)


def read_matrices(named: Mapping[str, DataFrame], datasets: Sequence[str], metric: str = "macro_auroc") -> DataFrame:
    """Matrices of several architectures as one table; a cell missing, extra or given twice raises."""
    out = union_by_name(named, "architecture")
    require_columns(out, [*CELL, metric], "matrices")
    require_unique(out, ["architecture", *CELL], "matrices")
    wanted = grid(out.sparkSession, list(named), datasets)
    keys = ["architecture", *CELL]
    missing = wanted.join(out.select(*keys), keys, "left_anti").limit(5).collect()
    extra = out.select(*keys).join(wanted, keys, "left_anti").limit(5).collect()
    if missing or extra:
        raise TableError(f"cells missing {[tuple(r) for r in missing]}, extra {[tuple(r) for r in extra]}")
    return out


def diagonal(cells: DataFrame) -> DataFrame:
    return cells.where(F.col("source_dataset") == F.col("target_dataset"))


def off_diagonal(cells: DataFrame) -> DataFrame:
    return cells.where(F.col("source_dataset") != F.col("target_dataset"))


def consolidated_status(expected: DataFrame, metrics: DataFrame, key: str, available: DataFrame | None = None) -> DataFrame:
    """One row per expected key: COMPLETE, NOT_RUN, or BLOCKED_MISSING_DATA where it isn't available."""
    out = expected.select(key).join(metrics.select(key, F.lit(True).alias("__done")).distinct(), key, "left")
    there: Column = F.lit(True)
    if available is not None:
        out = out.join(available.select(key, F.lit(True).alias("__there")).distinct(), key, "left")
        there = F.coalesce("__there", F.lit(False))
    return out.select(key, F.when(F.col("__done"), "COMPLETE").when(there, "NOT_RUN").otherwise("BLOCKED_MISSING_DATA").alias("status"))


def completion(stages: Mapping[str, DataFrame]) -> DataFrame:
    """``stage, cells, complete, all_complete`` of tables with a ``status``."""
    return union_by_name({k: v.select("status") for k, v in stages.items()}, "stage").groupBy("stage").agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("status") == "COMPLETE").alias("complete"), F.every(F.col("status") == "COMPLETE").alias("all_complete"))


def stale(results: DataFrame, inputs: DataFrame, time: str = "modified_at") -> DataFrame:
    """Results older than the newest input: ``name, modified_at, newest_input``."""
    newest = inputs.agg(F.max(time).alias("newest_input"))
    # the right side is one row
    return results.join(F.broadcast(newest), F.col(time) < F.col("newest_input")).select("name", time, "newest_input")
