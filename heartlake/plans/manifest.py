"""The canonical record listing: its rules and its builders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import labels_of
from ..functions.coerce import blank, safe_relative_path
from ..functions.listings import split_name
from ..functions.names import LABELS, SPLITS, ordinal
from ..operators.checks import TableError, join_checked, require_columns, require_one_value, require_rows, require_unique
from ..operators.ranking import first_per_key
from ..session import cut
from .eligibility import eligible, qc_report, without
from .stratify import assign_splits, select_exact, select_subset

#: The columns every listing has.
KEYS = ("dataset", "record_id", "subject_id", "split")
CANONICAL = (*KEYS, "signal_path", "storage", *LABELS, "valid_num_samples", "mapping_version", "split_version")


def violations(df: DataFrame) -> DataFrame:
    """``rule, rows``: how many rows break each rule of the listing; one pass, plus one per key rule."""
    flag = F.lit(True)
    for x in LABELS:
        flag = flag & F.coalesce(F.col(x).isin(0, 1), F.lit(False))
    rules = {
        "blank_id": blank(F.col("record_id")) | blank(F.col("subject_id")),
        "unknown_split": ~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False)),
        "bad_flag": ~flag,
        "bad_sample_count": ~F.coalesce(F.col("valid_num_samples").isin(2500, 5000), F.lit(False)),
    }
    counts = df.agg(*[F.count_if(c).alias(k) for k, c in rules.items()]).unpivot([], list(rules), "rule", "rows")
    twice = df.groupBy("record_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("rows")).select(F.lit("repeated_record").alias("rule"), "rows")
    leak = df.groupBy("subject_id").agg((F.min("split") < F.max("split")).alias("x")).agg(F.count_if("x").alias("rows")).select(F.lit("leaking_subject").alias("rule"), "rows")
    return counts.unionByName(twice).unionByName(leak)


def validate(df: DataFrame) -> DataFrame:
    """The listing in canonical order of columns and rows, or ``TableError``.

    All rules of ``violations`` must hold, and validation and test must have
    both classes of every label.  Other columns are kept, after the key columns.
    """
    require_columns(df, CANONICAL, "listing")
    rules: dict[str, Column] = {"record_id": ~blank(F.col("record_id")), "subject_id": ~blank(F.col("subject_id")), "split": F.col("split").isin(*SPLITS), "valid_num_samples": F.col("valid_num_samples").isin(2500, 5000), "path": safe_relative_path(F.col("signal_path"))}
    require_rows(df, rules | {x: F.col(x).isin(0, 1) for x in LABELS}, "listing")
    require_unique(df, ["record_id"], "listing")
    require_one_value(df, "subject_id", "split", "listing")
    present = df.groupBy("split").agg(*[(F.min(x) == F.max(x)).alias(x) for x in LABELS]).collect()
    names = {r["split"] for r in present}
    if names != set(SPLITS):
        raise TableError(f"listing must have exactly the splits {SPLITS}, not {sorted(names)}")
    one_class = [(r["split"], x) for r in present for x in LABELS if r[x] and r["split"] != "train"]
    if one_class:
        raise TableError(f"only one class in {one_class}")
    rest = [c for c in df.columns if c not in KEYS]
    return df.select(*KEYS, *rest).orderBy(ordinal(F.col("split"), SPLITS), "record_id")


def listing_qc(df: DataFrame) -> DataFrame:
    """Records, subjects and positives per split."""
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("subject_id").alias("subjects"), *[F.sum(F.col(x).cast("bigint")).alias(f"positive_{x}") for x in LABELS])


def _finish(df: DataFrame, dataset: str, storage: str, samples: int, mapping_version: str, split_version: str, seed: int) -> DataFrame:
    fixed = {"dataset": dataset, "storage": storage, "mapping_version": mapping_version, "split_version": split_version}
    return df.withColumns({k: F.lit(v) for k, v in fixed.items()} | {"valid_num_samples": F.lit(samples), "seed": F.lit(seed)}).select(*CANONICAL, "seed")


def from_folds(index: DataFrame, database: DataFrame, codes: Column, code_map: dict[str, Sequence[str]], dataset: str = "ptbxl", seed: int = 42) -> DataFrame:
    """Listing by official folds: 1 to 8 train, 9 validation, 10 test; index and database 1:1 on ``ecg_id``."""
    both = join_checked(index, database, ["ecg_id"], "left", "one_to_one", complete=["patient_id", "strat_fold"])
    require_rows(both, {"fold": F.col("strat_fold").between(1, 10)}, "folds")
    split = F.when(F.col("strat_fold") <= 8, "train").when(F.col("strat_fold") == 9, "validation").otherwise("test")
    rid = F.col("ecg_id").cast("string")
    out = both.select(rid.alias("record_id"), F.col("patient_id").cast("string").alias("subject_id"), split.alias("split"), F.concat(F.lit("signals/"), F.lpad(rid, 5, "0"), F.lit(".npy")).alias("signal_path"), *labels_of(codes, code_map, LABELS))
    return _finish(out, dataset, "npy", 5000, f"{dataset}-five-label-v1", "official-folds", seed)


def from_records(index: DataFrame, codes: Column, code_map: dict[str, Sequence[str]], dataset: str, path: Column, seed: int = 42) -> DataFrame:
    """Listing split by record: every record is its own subject."""
    out = index.select(F.trim(F.col("ecg_id").cast("string")).alias("record_id"), path.alias("signal_path"), *labels_of(codes, code_map, LABELS)).withColumn("subject_id", F.col("record_id"))
    return _finish(assign_splits(out, "subject_id", seed=seed), dataset, "npy", 5000, f"{dataset}-five-label-v1", f"record-80-10-10-seed{seed}", seed)


def from_splits(index: DataFrame, dataset: str = "mimic_iv", storage: str = "wfdb", seed: int = 42) -> DataFrame:
    """Listing that keeps the splits it is given, whatever their spelling."""
    out = index.withColumns({"record_id": F.trim(F.col("study_id").cast("string")), "subject_id": F.trim(F.col("subject_id").cast("string")), "split": split_name(F.col("split")), "signal_path": F.col("waveform_path")})
    return _finish(out, dataset, storage, 5000, f"{dataset}-five-label-v1", f"subject-80-10-10-seed{seed}", seed)


def from_exact(index: DataFrame, n: int, dataset: str = "code_ii", path: Column | None = None, seed: int = 42) -> DataFrame:
    """Listing of exactly ``n`` records (all, if fewer) with the label shares of all, split by subject.

    ``index`` has ``record_id, subject_id``, the labels and ``signal_path`` (or
    ``path`` gives it).  Rows with an id missing or a label outside 0 and 1 can't
    be chosen; of a record listed again the row with the smallest subject counts.
    """
    fine = ~blank(F.col("record_id")) & ~blank(F.col("subject_id"))
    for x in LABELS:
        fine = fine & F.coalesce(F.col(x).isin(0, 1), F.lit(False))
    rows = index.where(fine).withColumns({"record_id": F.trim("record_id"), "subject_id": F.trim("subject_id"), "signal_path": F.col("signal_path") if path is None else path})
    rows = first_per_key(rows.select("record_id", "subject_id", "signal_path", *LABELS), ["record_id"], [F.col("subject_id"), F.col("signal_path")])
    chosen = cut(select_exact(rows, "record_id", n, LABELS, seed))
    return _finish(assign_splits(chosen, "subject_id", seed=seed), dataset, "hdf5", 5000, f"{dataset}-five-label-v1", f"subject-80-10-10-seed{seed}", seed)


def subset_listing(records: DataFrame, excluded: DataFrame, target: int, dataset: str = "mimic_iv", seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The whole way from eligible records to a listing and its quality report.

    ``records`` has ``study_id, subject_id, waveform_path`` and the labels:
    excluded studies leave, whole subjects are chosen to the target, split
    80/10/10, listed and checked by ``violations``; any is an error.
    """
    picked = select_subset(without(eligible(records), excluded, "study_id"), "subject_id", target, LABELS, seed)
    out = cut(from_splits(assign_splits(picked, "subject_id", seed=seed), dataset, seed=seed))
    broken = {r["rule"]: r["rows"] for r in violations(out).collect() if r["rows"]}
    if broken:
        raise TableError(f"listing breaks its rules: {broken}")
    return out, qc_report(out, "subject_id", "split")


def missing_exams(listing: DataFrame, exams: DataFrame) -> DataFrame:
    """Listings of archives (``FILE::EXAM``) whose file or exam isn't there: ``record_id, file, exam, reason``.

    ``exams`` has one row per exam, ``file, exam``.  Reasons are no_file and no_exam.
    """
    wanted = listing.where(F.col("signal_path").contains("::")).select("record_id", F.split_part("signal_path", F.lit("::"), F.lit(1)).alias("file"), F.split_part("signal_path", F.lit("::"), F.lit(2)).alias("exam"))
    known = exams.select("file", "exam").distinct()
    files = known.select("file").distinct().withColumn("__there", F.lit(True))
    left = wanted.join(known, ["file", "exam"], "left_anti").join(files, "file", "left")
    return left.select("record_id", "file", "exam", F.when(F.col("__there").isNull(), "no_file").otherwise("no_exam").alias("reason"))


def only_paths_changed(before: DataFrame, after: DataFrame) -> bool:
    """Whether two listings are equal but for path and storage."""
    rest = [c for c in before.columns if c not in ("signal_path", "storage")]
    if set(before.columns) != set(after.columns):
        return False
    a, b = before.select(*rest), after.select(*rest)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
