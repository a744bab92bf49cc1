"""Long and wide tables, unions and fixed column sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .checks import require_unique


def union_by_name(parts: Mapping[str, DataFrame], tag: str) -> DataFrame:
    """Named tables put together, the name in column ``tag``; missing columns become null."""
    named = [df.withColumn(tag, F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def melt(df: DataFrame, keys: Sequence[str], values: Sequence[str], name: str = "variable", value: str = "value") -> DataFrame:
    """One row per value column."""
    return df.unpivot(list(keys), list(values), name, value)


def matrix(cells: DataFrame, row: str, column: str, value: str, order: Sequence[str], check: bool = True) -> DataFrame:
    """Cells as a square table with rows and columns in a given order.

    Cells that are missing are null; a cell given twice raises.  Rows and
    columns outside ``order`` are left out.
    """
    if check:
        cells = cut(cells.select(row, column, value))
        require_unique(cells, [row, column], "matrix")
    rows = cells.sparkSession.createDataFrame([(i, name) for i, name in enumerate(order)], f"__at int, {row} string")
    wide = cells.where(F.col(column).isin(*order)).groupBy(row).pivot(column, list(order)).agg(F.max(value))
    return rows.join(wide, row, "left").orderBy("__at").drop("__at")


def with_columns_of(df: DataFrame, schema: Mapping[str, str]) -> DataFrame:
    """Exactly the columns of ``schema``, in its order; missing ones are null of the given type."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in schema.items()])


def drop_empty_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Without the rows that are null in all ``columns``."""
    return df.na.drop("all", subset=list(columns))
