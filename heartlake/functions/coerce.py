"""Values read as numbers, flags and text, with defined results for what can't be read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of a flag.
TRUE = ("1", "1.0", "true", "t", "yes", "y")
FALSE = ("0", "0.0", "false", "f", "no", "n")


def blank(c: Column) -> Column:
    """Null or nothing but blanks."""
    return c.isNull() | (F.trim(c.cast("string")) == "")


def binary_flag(c: Column) -> Column:
    """1, 0 or null of any spelling in ``TRUE`` and ``FALSE``; null also for anything unknown."""
    s = F.lower(F.trim(c.cast("string")))
    return F.when(s.isin(*TRUE), F.lit(1)).when(s.isin(*FALSE), F.lit(0)).cast("tinyint")


def bad_flag(c: Column) -> Column:
    """Whether a value is present but no flag."""
    return ~blank(c) & binary_flag(c).isNull()


def strict_boolean(c: Column) -> Column:
    """true, false, 1 and 0 only; anything else, null too, raises."""
    s = F.lower(F.trim(c.cast("string")))
    return F.when(s.isin("true", "1"), True).when(s.isin("false", "0"), False).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), F.coalesce(s, F.lit("null")))).cast("boolean"))


def number(c: Column) -> Column:
    """A finite double, or null where there is none."""
    x = c.cast("string").try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def number_or_raise(c: Column) -> Column:
    """A double; text that is no number raises (ANSI cast)."""
    return c.cast("double")


def finite(c: Column) -> Column:
    """Neither null nor NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def no_nan(c: Column) -> Column:
    """NaN made null, so that averages leave it out."""
    return F.when(~F.isnan(c), c)


def clip(c: Column, low: float, high: float) -> Column:
    """``c`` within ``[low, high]``; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c)))


def ratio(a: Column, b: Column) -> Column:
    """``a / b`` in doubles, null where ``b`` is zero or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def join_texts(columns: list[Column], between: str = "; ") -> Column:
    """Trimmed texts put together; null and blank ones are skipped, none gives an empty text."""
    return F.concat_ws(between, *[F.nullif(F.trim(c), F.lit("")) for c in columns])


def any_positive(*columns: Column) -> Column:
    """Largest of several flags: 1 if any is 1; nulls are skipped."""
    return F.greatest(*columns) if len(columns) > 1 else columns[0]


def noisy_or(*columns: Column) -> Column:
    """``1 - product(1 - p)``; null if any is null."""
    none = F.lit(1.0)
    for c in columns:
        none = none * (F.lit(1.0) - c)
    return F.lit(1.0) - none


def safe_relative_path(c: Column) -> Column:
    """Whether a path stays below its root: not blank, not absolute, no ``..`` step, no drive."""
    p = F.regexp_replace(F.trim(c), r"\\", "/")
    return ~blank(c) & ~p.rlike(r"^/|^[A-Za-z]:|(^|/)\.\.(/|$)")


def md5_fraction(key: Column, seed: int | str) -> Column:
    """``md5("{seed}_{key}")`` as a number, modulo 10000, over 10000.

    The 128 bits are taken in halves, as ``2 ** 64 mod 10000`` is 1616.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}_"), key.cast("string")))
    halves = [F.conv(F.substring(digest, at, 16), 16, 10).cast("decimal(20,0)") for at in (1, 17)]
    return (((halves[0] % 10000) * 1616 + halves[1] % 10000) % 10000).cast("double") / 10000.0


def hash_split(key: Column, seed: int | str = 42, test: float = 0.2, validation: float = 0.1) -> Column:
    """test, val or train by the md5 fraction of the key."""
    x = md5_fraction(key, seed)
    return F.when(x < test, "test").when(x < round(test + validation, 9), "val").otherwise("train")


def plausible_age(c: Column) -> Column:
    """Whether an age lies strictly between 0 and 120; null isn't plausible."""
    return F.coalesce((c > 0) & (c < 120), F.lit(False))
