"""Bootstrap intervals without copies of the data.

Draw ``d`` of replicate ``r`` picks item ``md5("{seed}_{r}_{d}")``, its first 32
bits modulo the number of items, so draws are repeatable and the same in any
engine.  A replicate of records is a count per record, and the area under the
curve takes counts as weights.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coerce import finite

#: Replicates of one task, and of one matrix of counts within it.
_BLOCK, _STEP = 125, 32


def draw(seed: int, replicate: Column, at: Column, n: Column) -> Column:
    """The item (from 0) that a draw picks."""
    digest = F.md5(F.concat_ws("_", F.lit(str(seed)), replicate.cast("string"), at.cast("string")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), n)


def _numbered(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*group)
    return df.withColumn("__at", (F.row_number().over(w.orderBy(*order)) - 1).cast("bigint")).withColumn("__n", F.count(F.lit(1)).over(w))


def _packed(keys: Sequence[str], schema: pa.Schema):
    """Rows of one cell and label, sorted by score and truth; equal ones are one group."""

    def run(rows: pa.Table) -> pa.Table:
        at, y, p = (rows.column(c).to_numpy() for c in ("__at", "__y", "__p"))
        order = np.lexsort((y, p))
        at, y, p = at[order], y[order], p[order]
        score = np.concatenate([[True], p[1:] != p[:-1]])
        start = np.nonzero(score | np.concatenate([[True], y[1:] != y[:-1]]))[0]
        packed = [at.astype("<i4"), start.astype("<i4"), np.nonzero(score[start])[0].astype("<i4"), y[start].astype("<f8")]
        return pa.Table.from_arrays([rows.column(c).slice(0, 1) for c in keys] + [pa.array([x.tobytes()], pa.binary()) for x in packed], schema=schema)

    return run


def _areas(keys: Sequence[str], replicates: int, seed: int, schema: pa.Schema):
    """The areas of one block of replicates, of all cells and labels with one number of records."""

    def run(rows: pa.Table) -> pa.Table:
        n, block = rows.column("__n")[0].as_py(), rows.column("__block")[0].as_py()
        packed = [[np.frombuffer(x, kind) for x, kind in zip(row, ("<i4", "<i4", "<i4", "<f8"))] for row in zip(*(rows.column(c).to_pylist() for c in ("at", "start", "tie", "truth")))]
        last = min(replicates, (block + 1) * _BLOCK)
        which, chosen, areas = [], [], []
        for first in range(block * _BLOCK, last, _STEP):
            some = range(first, min(last, first + _STEP))
            times = np.empty((n, len(some)), np.int32)
            for k, r in enumerate(some):
                bits = b"".join([md5(f"{seed}_{r}_{d}".encode()).digest()[:4] for d in range(n)])
                times[:, k] = np.bincount(np.frombuffer(bits, ">u4") % n, minlength=n)
            for i, (at, start, tie, truth) in enumerate(packed):
                counts = np.add.reduceat(times[at], start, axis=0).astype(np.float64)
                positive, negative = (np.add.reduceat(counts * t[:, None], tie, axis=0) for t in (truth, 1.0 - truth))
                won = (positive * (np.cumsum(negative, axis=0) - negative / 2)).sum(0)
                pairs = positive.sum(0) * negative.sum(0)
                drawn = np.nonzero(counts.sum(0))[0]
                which.append(np.full(len(drawn), i))
                chosen.append(first + drawn)
                areas.append(np.divide(won, pairs, out=np.full(len(pairs), np.nan), where=pairs != 0)[drawn])
        picked = pa.array(np.concatenate(which))
        return pa.Table.from_arrays([rows.column(c).take(picked) for c in keys] + [pa.array(np.concatenate(chosen).astype(np.int32)), pa.array(np.concatenate(areas), from_pandas=True)], schema=schema)

    return run


def _replicate_areas(predictions: DataFrame, cell: Sequence[str], record: str, label: str, truth: str, score: str, replicates: int, seed: int) -> DataFrame:
    """``cell, label, replicate, auroc`` of every replicate; null where a replicate has one kind of truth only.

    A cell's label is sorted once, in one task, and sent to every block of
    replicates as 4 bytes a row.  Draws depend on the number of records alone,
    so the cells that share it share the draws of a block.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    keys = [*cell, label]
    records = _numbered(predictions.select(*cell, record).distinct(), cell, [record])
    fine = predictions.where(F.col(truth).isNotNull() & finite(F.col(score)))
    rows = fine.select(*keys, record, F.col(truth).cast("double").alias("__y"), F.col(score).cast("double").alias("__p")).join(records, [*cell, record]).drop(record)
    named = rows.select(*keys)
    packed = rows.select(*keys, "__n").limit(0).select("*", *[F.lit(None).cast("binary").alias(c) for c in ("at", "start", "tie", "truth")]).schema
    per = named.limit(0).select("*", F.lit(None).cast("int").alias("replicate"), F.lit(None).cast("double").alias("auroc")).schema
    sorted_rows = rows.groupBy(*keys, "__n").applyInArrow(_packed([*keys, "__n"], to_arrow_schema(packed)), packed)
    blocks = sorted_rows.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // _BLOCK))))
    return blocks.groupBy("__n", "__block").applyInArrow(_areas(keys, replicates, seed, to_arrow_schema(per)), per)


def record_intervals(predictions: DataFrame, cell: Sequence[str], record: str = "record_id", label: str = "label", truth: str = "y", score: str = "p", replicates: int = 1000, seed: int = 42) -> DataFrame:
    """``cell, metric, replicates_used, ci_low, ci_high``: 95 % intervals of each class and of the macro mean.

    A class is left out of a replicate in which it has one kind of truth only;
    the macro mean counts only replicates in which all classes are defined.
    """
    cell = list(cell)
    per = _replicate_areas(predictions, cell, record, label, truth, score, replicates, seed)
    classes = per.select(*cell, "replicate", F.col(label).alias("metric"), "auroc")
    macro = per.groupBy(*cell, "replicate").agg(F.avg("auroc").alias("auroc"), F.count_if(F.col("auroc").isNull()).alias("open")).where(F.col("open") == 0).select(*cell, "replicate", F.lit("macro").alias("metric"), "auroc")
    both = classes.unionByName(macro).where(F.col("auroc").isNotNull())
    ends = F.percentile("auroc", F.array(F.lit(0.025), F.lit(0.975)))
    return both.groupBy(*cell, "metric").agg(F.count(F.lit(1)).alias("replicates_used"), ends.alias("e")).select(*cell, "metric", "replicates_used", F.col("e")[0].alias("ci_low"), F.col("e")[1].alias("ci_high"))


def _cell_means(cells: DataFrame, group: Sequence[str], metrics: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """Means of resampled diagonal and other cells: ``group, replicate, own, <metric>``."""
    own = F.col("source_dataset") == F.col("target_dataset")
    kinds = [*group, "own"]
    placed = _numbered(cells.select(*group, own.alias("own"), "source_dataset", "target_dataset", *metrics), kinds, ["source_dataset", "target_dataset"])
    draws = placed.select(*kinds, "__at", "__n", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    tag = F.concat(F.col("replicate").cast("string"), F.when(F.col("own"), "d").otherwise("o"))
    at = draws.select(*kinds, "replicate", draw(seed, tag, F.col("__at"), F.col("__n")).alias("__at"))
    return at.join(placed.select(*kinds, "__at", *metrics), [*kinds, "__at"]).groupBy(*kinds, "replicate").agg(*[F.avg(m).alias(m) for m in metrics])


def _gap(means: DataFrame, group: Sequence[str], metric: str) -> DataFrame:
    return means.groupBy(*group, "replicate").agg((F.max(F.when(F.col("own"), F.col(metric))) - F.max(F.when(~F.col("own"), F.col(metric)))).alias("gap"))


def _ends(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    ends = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    return df.groupBy(*group).agg(ends.alias("e")).select(*group, F.col("e")[0].alias("ci_low"), F.col("e")[1].alias("ci_high"))


def gap_interval(cells: DataFrame, group: Sequence[str], metric: str, replicates: int = 10_000, seed: int = 42) -> DataFrame:
    """95 % interval of the gap, cells resampled on and off the diagonal apart."""
    return _ends(_gap(_cell_means(cells, group, [metric], replicates, seed), group, metric), group, "gap")


def paired_gap_interval(cells: DataFrame, group: Sequence[str], five: str, binary: str, replicates: int = 10_000, seed: int = 42) -> DataFrame:
    """95 % interval of the five-label gap less the binary gap, both on the same drawn cells."""
    means = _cell_means(cells, group, [five, binary], replicates, seed)
    d = F.col(five) - F.col(binary)
    return _ends(_gap(means.select(*group, "own", "replicate", d.alias("d")), group, "d"), group, "gap")
