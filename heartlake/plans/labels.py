"""Labels from diagnoses, texts and other labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import any_positive, bad_flag, binary_flag, blank, join_texts, noisy_or
from ..functions.names import LABELS
from ..operators.checks import TableError, join_checked, require_columns, require_rows


def mapped_codes(diagnoses: DataFrame, code_map: DataFrame, study: str, code: str, map_code: str, map_label: str) -> DataFrame:
    """``study, label`` for each diagnosis the map knows; codes are compared trimmed."""
    d = diagnoses.where(~blank(F.col(code))).select(study, F.trim(F.col(code).cast("string")).alias("__code"))
    m = code_map.where(~blank(F.col(map_code))).select(F.trim(F.col(map_code).cast("string")).alias("__code"), F.col(map_label).alias("label")).distinct()
    return d.join(m, "__code").select(study, "label")


def labels_from_diagnoses(diagnoses: DataFrame, code_map: DataFrame, study: str, code: str, labels: Sequence[str] = LABELS, map_code: str = "source_code", map_label: str = "target_label") -> DataFrame:
    """One row per study with a usable code: 1 for labels that a code of it maps to, else 0.

    A study whose codes are all unmapped has only zeros; a study without any
    usable code has no row.  One aggregate does both, no join back.
    """
    require_columns(diagnoses, [study, code], "diagnoses")
    require_columns(code_map, [map_code, map_label], "label map")
    m = code_map.where(~blank(F.col(map_code))).select(F.trim(F.col(map_code).cast("string")).alias("__code"), F.col(map_label).alias("__label")).distinct()
    d = diagnoses.where(~blank(F.col(code))).select(study, F.trim(F.col(code).cast("string")).alias("__code")).distinct()
    return d.join(m, "__code", "left").groupBy(study).agg(*[F.coalesce(F.max((F.col("__label") == x).cast("int")), F.lit(0)).cast("tinyint").alias(x) for x in labels])


def prepare_labels(metadata: DataFrame, study: str, labels: Sequence[str] = LABELS, label_table: DataFrame | None = None, code_map: DataFrame | None = None, code: str = "snomed_code") -> DataFrame:
    """Metadata with flag columns, from wherever the labels are.

    Without ``label_table`` the metadata must hold them; a label table with the
    label columns is joined (several rows of a study count as "or", and a
    study with only nulls stays null); one with codes needs ``code_map``.
    A value that is present but no flag raises.
    """
    if label_table is None:
        require_columns(metadata, labels, "metadata")
        wide = metadata
    else:
        if code_map is not None:
            per_study = labels_from_diagnoses(label_table, code_map, study, code, labels)
        else:
            require_columns(label_table, [study, *labels], "labels")
            require_rows(label_table, {c: ~bad_flag(F.col(c)) for c in labels}, "labels", allow_empty=True)
            per_study = label_table.groupBy(study).agg(*[F.max(binary_flag(F.col(c))).alias(c) for c in labels])
        wide = join_checked(metadata.drop(*labels), per_study, [study], "left")
    require_rows(wide, {c: ~bad_flag(F.col(c)) for c in labels}, "labels", allow_empty=True)
    return wide.withColumns({c: binary_flag(F.col(c)) for c in labels})


def text_labels(df: DataFrame, key: str, reports: Sequence[str], patterns: dict[str, str]) -> DataFrame:
    """Labels of report texts: 1 where a label's pattern occurs in any report column, case aside.

    Stands in for an external labeller: any other can be used in its place, as
    long as it gives ``key`` and one flag per label.
    """
    text = F.lower(join_texts([F.col(c) for c in reports]))
    return df.select(key, text.alias("report"), *[text.rlike(p.lower()).cast("tinyint").alias(name) for name, p in patterns.items()])


def binary_manifest(df: DataFrame, normal: str = "normal", abnormal: Sequence[str] = LABELS[1:], out: str = "abnormal") -> DataFrame:
    """``out``: 1 if any abnormal label is set (normal or not), 0 if only normal is; rows with none are left out."""
    ill = any_positive(*[F.col(c) for c in abnormal])
    return df.where((ill == 1) | (F.col(normal) == 1)).withColumn(out, (ill == 1).cast("tinyint"))


def collapse_probability(aggregation: str, normal: Column, abnormal: Sequence[Column]) -> Column:
    """Probability of "any abnormal" from five: max_abnormal, noisy_or or one_minus_normal."""
    if aggregation == "max_abnormal":
        return any_positive(*abnormal)
    if aggregation == "noisy_or":
        return noisy_or(*abnormal)
    if aggregation == "one_minus_normal":
        return F.lit(1.0) - normal
    raise ValueError(f"unknown aggregation {aggregation!r}")


#: The ways to score the five labels anew.
VARIANTS = ("base", "exclusive_normal", "abnormal_only", "merged_bbb")


def mapping_variants(wide: DataFrame, keys: Sequence[str], truth: str = "y_", score: str = "p_") -> DataFrame:
    """``keys, variant, label, y, p``: the same predictions under each label mapping.

    base: as they are.  exclusive_normal: normal counts only where nothing
    abnormal does, its probability times one less the largest abnormal one.
    abnormal_only: without normal.  merged_bbb: both bundle branch blocks as one.
    """
    y, p = (lambda x: F.col(truth + x)), (lambda x: F.col(score + x))
    ill = LABELS[1:]
    one = lambda v, label, yy, pp: F.struct(F.lit(v).alias("variant"), F.lit(label).alias("label"), yy.cast("int").alias("y"), pp.cast("double").alias("p"))
    some_y, some_p = any_positive(*[y(x) for x in ill]), any_positive(*[p(x) for x in ill])
    rows = [one("base", x, y(x), p(x)) for x in LABELS]
    rows += [one("exclusive_normal", x, y(x), p(x)) for x in ill]
    rows.append(one("exclusive_normal", "normal", F.when(some_y == 1, 0).otherwise(y("normal")), p("normal") * (F.lit(1.0) - some_p)))
    rows += [one("abnormal_only", x, y(x), p(x)) for x in ill]
    rows += [one("merged_bbb", x, y(x), p(x)) for x in LABELS if x not in ("lbbb", "rbbb")]
    rows.append(one("merged_bbb", "bbb", any_positive(y("lbbb"), y("rbbb")), any_positive(p("lbbb"), p("rbbb"))))
    return wide.select(*keys, F.explode(F.array(*rows)).alias("x")).select(*keys, "x.*")


#: The scores that each variant is made of, by the label it has there.
PIECES = {
    "base": {x: x for x in LABELS},
    "exclusive_normal": {**{x: x for x in LABELS[1:]}, "normal": "exclusive"},
    "abnormal_only": {x: x for x in LABELS[1:]},
    "merged_bbb": {**{x: x for x in LABELS if x not in ("lbbb", "rbbb")}, "bbb": "bbb"},
}


def mapping_pieces(wide: DataFrame, keys: Sequence[str], truth: str = "y_", score: str = "p_") -> DataFrame:
    """``keys, piece, y, p``: the seven different scores that all variants are made of."""
    y, p = (lambda x: F.col(truth + x)), (lambda x: F.col(score + x))
    ill = LABELS[1:]
    one = lambda piece, yy, pp: F.struct(F.lit(piece).alias("piece"), yy.cast("int").alias("y"), pp.cast("double").alias("p"))
    some_y, some_p = any_positive(*[y(x) for x in ill]), any_positive(*[p(x) for x in ill])
    rows = [one(x, y(x), p(x)) for x in LABELS]
    rows.append(one("exclusive", F.when(some_y == 1, 0).otherwise(y("normal")), p("normal") * (F.lit(1.0) - some_p)))
    rows.append(one("bbb", any_positive(y("lbbb"), y("rbbb")), any_positive(p("lbbb"), p("rbbb"))))
    return wide.select(*keys, F.explode(F.array(*rows)).alias("x")).select(*keys, "x.*")


def of_variants(pieces: DataFrame) -> DataFrame:
    """Rows of each ``piece`` once for every variant that is made of it, as ``variant`` and ``label``."""
    of = [F.struct(F.lit(p).alias("piece"), F.lit(v).alias("variant"), F.lit(label).alias("label")) for v, made in PIECES.items() for label, p in made.items()]
    each = F.explode(F.filter(F.array(*of), lambda x: x["piece"] == F.col("piece")))
    return pieces.withColumn("__of", each).withColumn("variant", F.col("__of.variant")).withColumn("label", F.col("__of.label")).drop("__of", "piece")


def load_code_map(mapping: DataFrame, code: str = "source_code", label: str = "target_label", version: str = "mapping_version") -> tuple[dict[str, list[str]], str]:
    """A bounded vocabulary as a dict, and its one version; several versions raise."""
    rows = mapping.select(F.trim(code).alias("c"), F.trim(label).alias("l"), F.col(version).alias("v")).distinct().limit(100_001).collect()
    if len(rows) > 100_000:
        raise TableError("a code map of more than 100,000 rows is a table to join, not a vocabulary")
    versions = {r["v"] for r in rows}
    if len(versions) != 1:
        raise TableError(f"a code map needs exactly one version, not {sorted(map(str, versions))}")
    out: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["c"], r["l"])):
        out.setdefault(r["c"], []).append(r["l"])
    return out, versions.pop()
