"""Which records take part, and what is known about those that do."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coerce import blank
from ..functions.names import LABELS
from ..operators.checks import TableError
from ..operators.dedup import conflicting, keep_first
from ..operators.metrics import prevalence
from ..session import cut


@dataclass(frozen=True)
class ColumnSpec:
    """Names of the columns a record table is read by."""

    subject_id: str = "subject_id"
    study_id: str = "study_id"
    path: str = "waveform_path"


def drop_reason(spec: ColumnSpec, labels: Sequence[str] = LABELS, need_positive: bool = False) -> Column:
    """Why a row can't take part, by the first test it fails; null if it can."""
    reason = F.when(blank(F.col(spec.subject_id)) | blank(F.col(spec.study_id)), "missing_id").when(blank(F.col(spec.path)), "missing_path")
    for x in labels:
        reason = reason.when(F.col(x).isNull(), "incomplete_labels")
    if need_positive:
        reason = reason.when(F.greatest(*[F.col(x) for x in labels]) == 0, "no_positive_label")
    return reason


def eligible(df: DataFrame, spec: ColumnSpec = ColumnSpec(), labels: Sequence[str] = LABELS, need_positive: bool = False) -> DataFrame:
    """Rows that pass every test, one per study (the smallest path, then subject).

    A study whose remaining rows disagree in subject, path or labels raises.
    """
    rest = df.where(drop_reason(spec, labels, need_positive).isNull())
    unlike = conflicting(rest, spec.study_id, [spec.subject_id, spec.path, *labels]).limit(5).collect()
    if unlike:
        raise TableError(f"conflicting rows of one study: {[r.asDict() for r in unlike]}")
    return keep_first(rest, [spec.study_id], [F.col(spec.path), F.col(spec.subject_id)])


def cascade_counts(df: DataFrame, spec: ColumnSpec = ColumnSpec(), labels: Sequence[str] = LABELS, need_positive: bool = False) -> DataFrame:
    """``reason, rows``: how many rows each test drops, repeats of a study last, and how many stay.

    As each row is dropped by the first test it fails, one pass gives what a
    cascade of filters would count.
    """
    tagged = df.select(spec.study_id, drop_reason(spec, labels, need_positive).alias("reason"))
    per_study = tagged.where(F.col("reason").isNull()).groupBy(spec.study_id).agg(F.count(F.lit(1)).alias("n"))
    kept = per_study.agg(F.count(F.lit(1)).alias("eligible"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_study"))
    tail = kept.select(F.explode(F.create_map(F.lit("eligible"), F.col("eligible"), F.lit("duplicate_study"), F.col("duplicate_study"))).alias("reason", "rows"))
    return tagged.where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("rows")).unionByName(tail)


def without(df: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among the excluded ones; keys are compared as trimmed text."""
    gone = excluded.select(F.trim(F.col(key).cast("string")).alias("__k")).where(F.col("__k").isNotNull()).distinct()
    return df.withColumn("__k", F.trim(F.col(key).cast("string"))).join(gone, "__k", "left_anti").drop("__k")


def subject_table(df: DataFrame, subject: str, labels: Sequence[str] = LABELS) -> DataFrame:
    """One row per subject: its recordings and its positives of each label."""
    return df.groupBy(subject).agg(F.count(F.lit(1)).alias("n_recordings"), *[F.sum(F.col(x).cast("bigint")).alias(x) for x in labels])


def qc_report(df: DataFrame, subject: str, split: str, labels: Sequence[str] = LABELS) -> DataFrame:
    """Long quality report: ``section, split, label, metric, value``.

    Sections are size (records and subjects per split and in all), prevalence
    (per split and label, and in all) and leakage (subjects in several splits).
    """
    sizes = df.groupBy(split).agg(F.count(F.lit(1)).alias("records"), F.countDistinct(subject).alias("subjects")).unionByName(
        df.agg(F.count(F.lit(1)).alias("records"), F.countDistinct(subject).alias("subjects")).withColumn(split, F.lit("all"))
    )
    size_rows = sizes.unpivot([split], ["records", "subjects"], "metric", "value").select(F.lit("size").alias("section"), F.col(split).alias("split"), F.lit(None).cast("string").alias("label"), "metric", F.col("value").cast("double").alias("value"))
    both = df.select(F.explode(F.array(F.col(split), F.lit("all"))).alias("split"), *labels)
    per = prevalence(both, ["split"], labels)
    label_rows = per.unpivot(["split", "label"], ["prevalence"], "metric", "value").select(F.lit("prevalence").alias("section"), "split", "label", "metric", "value")
    leaks = df.groupBy(subject).agg((F.min(split) < F.max(split)).alias("leaks")).agg(F.count_if("leaks").cast("double").alias("value"))
    leak_rows = leaks.select(F.lit("leakage").alias("section"), F.lit("all").alias("split"), F.lit(None).cast("string").alias("label"), F.lit("subjects_in_several_splits").alias("metric"), "value")
    return size_rows.unionByName(label_rows).unionByName(leak_rows)


def shard_index(df: DataFrame, order: Sequence[str], shard_size: int) -> DataFrame:
    """``df`` with its ``position`` from 1 in a total order and its ``shard`` from 1.

    Positions come from range partitions and their sizes, not from one sorted
    task: the partition sizes are the only small table.
    """
    part = F.spark_partition_id()
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", part).withColumn("__m", F.monotonically_increasing_id() - F.shiftleft(part.cast("bigint"), 33))
    # kept, as a second range partitioning would sample other bounds
    placed = cut(placed)
    sizes = placed.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    sizes = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).drop("__n")
    at = F.col("__before") + F.col("__m") + 1
    return placed.join(sizes, "__p").withColumn("position", at).withColumn("shard", (F.floor((F.col("position") - 1) / shard_size) + 1).cast("bigint")).drop("__p", "__m", "__before")


def systematic_sample(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """``n`` rows at even distances of a total order, first and last included; all if there are no more than ``n``."""
    rows = df.count()
    placed = shard_index(df, order, 1).drop("shard")
    if rows <= n:
        return placed
    at = [int(k * (rows - 1) / (n - 1)) + 1 if n > 1 else 1 for k in range(n)]
    wanted = df.sparkSession.createDataFrame([(x,) for x in sorted(set(at))], "position bigint")
    return placed.join(wanted, "position", "left_semi")
