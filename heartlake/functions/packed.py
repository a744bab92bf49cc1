"""Several values packed in one text field.

The field is split on its quote character: the odd pieces are literals, the
even ones are cut at delimiters.  Array folds put the pieces together again,
with the quoted stretches fenced by control characters, so that one last split
gives the values in order.  All of it is built-in expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What parts two values outside quotes, and what a field holds that holds nothing.
DELIMITERS = "[,;|/&+·、；，｜\\t\\r\\n]"
VOID = ("", "none", "nan", "null", "n/a", "na")

_CUT, _OPEN, _SHUT, _COLON = "\u0001", "\u0002", "\u0003", "\u0004"
_BLANK = "[\\s ]"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{_BLANK}+|{_BLANK}+$", "")


def _fence(text: Column, quote: Column, outside: Callable[[Column], Column]) -> Column:
    """Literals fenced, ``outside`` applied to all other text, doubled quotes made one."""
    pieces = F.split(text, quote)
    last = F.size(pieces) - 1

    def piece(p: Column, i: Column) -> Column:
        doubled = (p == "") & (i > 0) & (i < last)
        return F.when(i % 2 == 1, F.concat(F.lit(_OPEN), p, F.lit(_SHUT))).otherwise(F.when(doubled, quote).otherwise(outside(p)))

    joined = F.array_join(F.transform(pieces, piece), "")
    return F.replace(joined, F.concat(F.lit(_SHUT), quote, F.lit(_OPEN)), quote)


def explode_packed(df: DataFrame, keys: list[str], field: str, position: str = "code_pos", value: str = "code") -> DataFrame:
    """One row per packed value: ``keys``, ``position`` (INT from 1) and ``value``.

    * Quotes (double or single, at the start of a value) keep everything inside
      as one value; a doubled quote inside is one quote.
    * Brackets around the whole field are dropped.  A field in braces with a
      colon outside quotes is a mapping, of which the keys are the values.
    * Outside quotes ``DELIMITERS`` part values; blanks part only values that
      are all digits.  Nothing else parts anything.
    * Values are trimmed; empty ones are dropped and take no position, repeats
      stay.  Null and void fields give no row.

    No shuffle and no Python: rows stay where they were read.
    """
    t, w, i, q, m, f = (F.col(x) for x in ("__t", "__w", "__i", "__q", "__m", "__f"))
    no_literals = F.regexp_replace(t, "\"[^\"]*\"|'[^']*'", "")
    out = df.select(*keys, _trim(F.regexp_replace(field, "[\u0001-\u0004]", " ")).alias("__t")).where(F.col("__t").isNotNull())
    pair = t.rlike(r"^\[[\s\S]*\]$") | t.rlike(r"^\{[\s\S]*\}$") | (t.rlike(r"^\([\s\S]*\)$") & ~no_literals.rlike(r"^\([^(]*\)[\s\S]"))
    out = out.withColumn("__w", pair).withColumn("__i", F.when(w, _trim(F.expr("substring(__t, 2, length(__t) - 2)"))).otherwise(t))
    out = out.where(~F.lower("__i").isin(*VOID))
    opener = F.regexp_extract("__i", rf"(?:^|{DELIMITERS}|:){_BLANK}*([\"'])", 1)
    out = out.withColumn("__q", F.when(opener == "'", F.lit("'")).otherwise(F.lit('"'))).withColumn("__m", t.startswith("{") & no_literals.contains(":"))

    def bare(p: Column) -> Column:
        p = F.regexp_replace(p, DELIMITERS, _CUT)
        return F.when(m, F.replace(p, F.lit(":"), F.lit(_COLON))).otherwise(p)

    other = F.when(q == "'", F.lit('"')).otherwise(F.lit("'"))
    out = out.withColumn("__f", F.split(_fence(i, q, lambda p: F.when(w, _fence(p, other, bare)).otherwise(bare(p))), _CUT))

    def values(p: Column) -> Column:
        key = F.when(m & ~p.contains(_COLON), F.lit("")).otherwise(F.substring_index(p, _COLON, 1))
        plain = _trim(key)
        return (
            F.when(key.contains(_OPEN), F.array(_trim(F.regexp_extract(key, f"{_OPEN}([^{_SHUT}]*)", 1))))
            .when(plain.rlike(rf"^[0-9]+(?:{_BLANK}+[0-9]+)+$"), F.split(plain, f"{_BLANK}+"))
            .otherwise(F.array(plain))
        )

    listed = F.filter(F.flatten(F.transform(f, values)), lambda v: v != "")
    return out.select(*keys, F.posexplode(listed).alias("__p", value)).select(*keys, (F.col("__p") + 1).cast("int").alias(position), value)


def explode_literals(df: DataFrame, keys: list[str], field: str) -> DataFrame:
    """``explode_packed`` of fields that must be literals: mappings, lists, tuples or sets.

    Keys and items may hold the other kind of quote (``{"it's": 1}``).  Null,
    blank and empty literals, ``set()`` among them, give no row; a field that
    isn't a literal raises.
    """
    shaped = F.col(field).rlike(r"^\s*(\{[\s\S]*\}|\[[\s\S]*\]|\([\s\S]*\)|set\(\))\s*$|^\s*$")
    bad = F.raise_error(F.concat(F.lit("not a literal of codes: "), F.col(field))).cast("string")
    text = F.when(F.col(field).isNull() | F.trim(field).isin("", "set()"), F.lit(None).cast("string")).when(shaped, F.col(field)).otherwise(bad)
    return explode_packed(df.select(*keys, text.alias(field)), keys, field)
