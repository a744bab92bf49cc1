"""Fields that hold several codes in one notation, and their map to labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def delimited_codes(c: Column) -> Column:
    """Codes between commas or bars, trimmed, empty ones dropped; null gives an empty array."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), "[,|]"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def mapping_codes(c: Column) -> Column:
    """Keys of a mapping literal such as ``{'NORM': 100.0}``, in order.

    A null or blank field has none; a field that isn't a mapping raises.
    """
    as_json = F.from_json(F.regexp_replace(F.regexp_replace(c, "'", '"'), r"\bNone\b", "null"), "map<string,double>")
    shaped = c.rlike(r"^\s*\{[\s\S]*\}\s*$") & as_json.isNotNull()
    none = F.array().cast("array<string>")
    return F.when(c.isNull() | (F.trim(c) == ""), none).when(shaped, F.map_keys(as_json)).otherwise(F.raise_error(F.concat(F.lit("not a mapping of codes: "), c)).cast("array<string>"))


def labels_of(codes: Column, code_map: dict[str, Sequence[str]], labels: Sequence[str]) -> list[Column]:
    """One 0/1 column per label: whether any of the codes maps to it.

    ``code_map`` is a vocabulary of bounded size and becomes a literal.
    """
    out = []
    for label in labels:
        wanted = [code for code, targets in code_map.items() if label in targets]
        hit = F.arrays_overlap(codes, F.array(*[F.lit(w) for w in wanted])) if wanted else F.lit(False)
        out.append(F.coalesce(hit, F.lit(False)).cast("tinyint").alias(label))
    return out
