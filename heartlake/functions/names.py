"""Canonical spellings of datasets, models and columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Compact spellings of dataset names and the run ids they stand for.
DATASET_ALIASES = {
    "ptbxl": "ptbxl",
    "mimicivecg": "mimic_iv",
    "mimiciv": "mimic_iv",
    "cpsc2018": "cpsc2018",
    "georgia12lead": "georgia",
    "georgia": "georgia",
    "code15": "code_ii",
    "codeii": "code_ii",
}

#: Label columns, their display names and their order.
LABELS = ("normal", "af_afl", "av_block_1", "lbbb", "rbbb")
CLASS_NAMES = ("NSR", "AFIB_AFL", "IAVB", "LBBB", "RBBB")
DATASETS = ("ptbxl", "mimic_iv", "cpsc2018", "georgia", "code_ii")
SPLITS = ("train", "validation", "test")


def canonical_dataset(c: Column) -> Column:
    """The run id of a dataset name; unknown names stay as they are, trimmed.

    Only letters and digits count, case aside.  Null stays null.
    """
    compact = F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))
    known = F.create_map(*[F.lit(x) for kv in DATASET_ALIASES.items() for x in kv])
    return F.coalesce(F.element_at(known, compact), F.trim(c))


def slug(c: Column) -> Column:
    """Lower case, every other run of characters an underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def ordinal(c: Column, order: tuple[str, ...]) -> Column:
    """Position of a value in a fixed order; values outside come last."""
    out = F.lit(len(order))
    for i, name in enumerate(order):
        out = F.when(c == name, F.lit(i)).otherwise(out)
    return out
