"""Prediction files, of which the folder names the cell."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import LABELS

#: The folder of a cell, ``<source>__to__<target>``, in any of the layouts.
_CELL = r"([^/]+)__to__([^/]+)/[^/]+$"


def read_predictions(spark: SparkSession, paths: str | Sequence[str], architecture: str | None = None) -> DataFrame:
    """Prediction CSVs with ``architecture, source_dataset, target_dataset`` from their paths.

    Understood layouts: ``<any>/predictions/<s>__to__<t>/<file>``,
    ``<any>/<architecture>/<s>__to__<t>/<file>`` and ``<any>/<s>__to__<t>/<file>``.
    The architecture is the parameter, or the folder above the cell.  Target and
    probability columns are read as numbers, ids as text.
    """
    df = spark.read.option("header", True).csv(paths if isinstance(paths, str) else list(paths))
    path = F.regexp_replace(F.col("_metadata.file_path"), "%20", " ")
    above = F.regexp_extract(path, r"([^/]+)/(?:predictions/)?[^/]+__to__[^/]+/[^/]+$", 1)
    numbers = {c: F.col(c).cast("int") for c in df.columns if c.startswith("target_")} | {c: F.col(c).cast("double") for c in df.columns if c.startswith("probability_")}
    return df.withColumns({"architecture": F.lit(architecture) if architecture else above, "source_dataset": F.regexp_extract(path, _CELL, 1), "target_dataset": F.regexp_extract(path, _CELL, 2)}).withColumns(numbers)


def long_predictions(wide: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """``architecture, source_dataset, target_dataset, record_id, label, y, p``."""
    keys = ["architecture", "source_dataset", "target_dataset", "record_id"]
    rows = F.array(*[F.struct(F.lit(x).alias("label"), F.col(f"target_{x}").alias("y"), F.col(f"probability_{x}").alias("p")) for x in labels])
    return wide.select(*keys, F.explode(rows).alias("x")).select(*keys, "x.*")


def write_predictions(long: DataFrame, path: str, overwrite: bool = False) -> None:
    """Long predictions as Parquet partitioned by cell, so a cell is read alone."""
    long.repartition("architecture", "source_dataset", "target_dataset").write.mode("overwrite" if overwrite else "errorifexists").partitionBy("architecture", "source_dataset", "target_dataset").parquet(path)
