"""Expectations on tables, checked in as few passes as possible.

Checks that need the data run one aggregate for all row rules together and one
per key rule.  They raise ``TableError`` with up to five examples.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class TableError(ValueError):
    """A table breaks what an operator needs."""


def require_columns(df: DataFrame, columns: Sequence[str], what: str = "table") -> None:
    """Raise if a column is missing; looks at the schema only."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise TableError(f"{what} is missing columns: {missing}")


def require_rows(df: DataFrame, rules: Mapping[str, Column], what: str = "table", allow_empty: bool = False) -> int:
    """Raise if any row breaks a rule (a null outcome breaks it); returns the number of rows."""
    ok = {name: F.coalesce(rule, F.lit(False)) for name, rule in rules.items()}
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(~rule).alias(name) for name, rule in ok.items()]).first()
    if not counts["rows"] and not allow_empty:
        raise TableError(f"{what} is empty")
    broken = {name: counts[name] for name in ok if counts[name]}
    if broken:
        name = next(iter(broken))
        raise TableError(f"{what}: rows that break rules {broken}, such as {[r.asDict() for r in df.where(~ok[name]).limit(5).collect()]}")
    return counts["rows"]


def require_unique(df: DataFrame, keys: Sequence[str], what: str = "table") -> None:
    """Raise if a key combination occurs twice; nulls are values here."""
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).limit(5).collect()
    if twice:
        raise TableError(f"{what} repeats {list(keys)}: {[r.asDict() for r in twice]}")


def require_one_value(df: DataFrame, key: str, value: str, what: str = "table") -> None:
    """Raise if a key has two different values (nulls aside): leakage of a subject across splits."""
    two = df.groupBy(key).agg(F.min(value).alias("a"), F.max(value).alias("b")).where(F.col("a") < F.col("b")).limit(5).collect()
    if two:
        raise TableError(f"{what}: several {value} for one {key}: {[r.asDict() for r in two]}")


def require_same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], what: str = "tables") -> None:
    """Raise unless both sides have exactly the same distinct keys."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    only = [[r.asDict() for r in x.exceptAll(y).limit(5).collect()] for x, y in ((a, b), (b, a))]
    if any(only):
        raise TableError(f"{what} differ in keys: left only {only[0]}, right only {only[1]}")


def join_checked(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", validate: str = "many_to_one", complete: Sequence[str] = ()) -> DataFrame:
    """Equi-join whose sides have the stated cardinality.

    ``validate`` is one_to_one, many_to_one, one_to_many or many_to_many; the
    "one" sides are checked for repeated keys.  ``complete`` columns of the
    result must not be null.
    """
    one_left, one_right = {"one_to_one": (True, True), "many_to_one": (False, True), "one_to_many": (True, False), "many_to_many": (False, False)}[validate]
    if one_left:
        require_unique(left, keys, "left side")
    if one_right:
        require_unique(right, keys, "right side")
    out = left.join(right, list(keys), how)
    if complete:
        require_rows(out, {f"{c} is set": F.col(c).isNotNull() for c in complete}, "join", allow_empty=True)
    return out
