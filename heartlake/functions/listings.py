"""How the listing table spells splits, datasets, paths and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of the three splits.
SPLIT_SPELLINGS = {
    "train": ("train", "training"),
    "validation": ("validation", "val", "valid", "dev"),
    "test": ("test", "testing"),
}


def split_name(c: Column) -> Column:
    """train, validation or test, spelling aside; null for anything else."""
    s = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    out = F.lit(None).cast("string")
    for name, spellings in SPLIT_SPELLINGS.items():
        out = F.when(s.isin(*spellings), F.lit(name)).otherwise(out)
    return out


def dataset_name(c: Column) -> Column:
    """Letters and digits in lower case, so that spellings of a dataset agree; null if none is left."""
    return F.nullif(F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", "")), F.lit(""))


def same_file(path: Column) -> Column:
    """A path such that two paths of one file are equal, letter case aside.

    Paths are taken from the root of the signal store, so a leading slash makes
    no difference; neither do blanks around the path, back slashes, repeated
    slashes, ``.`` steps and ``..`` steps.  Blank paths become null.
    """
    p = F.lower(F.regexp_replace(path, r"^\s+|\s+$", ""))
    p = F.regexp_replace(p, r"[\\/]+", "/")
    steps = F.filter(F.split(p, "/"), lambda s: (s != ".") & (s != ""))
    start = F.array().cast("array<string>")
    up = F.aggregate(
        steps,
        start,
        lambda done, s: F.when((s == "..") & (F.size(done) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), done), -1) != ".."), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s))),
    )
    return F.nullif(F.array_join(F.when(p.contains(".."), up).otherwise(steps), "/"), F.lit(""))


def number_in(c: Column) -> Column:
    """The number of an identifier, whatever stands around it, as text without leading zeros.

    Null where there is no number or the number is zero: such values name nobody.
    """
    digits = F.regexp_extract(F.translate(c, "０１２３４５６７８９", "0123456789"), r"([0-9]+)", 1)
    return F.nullif(F.regexp_replace(digits, "^0+", ""), F.lit(""))
