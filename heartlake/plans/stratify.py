"""Subsets and splits of whole subjects that keep sizes and label shares.

Subjects with the same number of recordings and the same positives of each
label are interchangeable; they form a stratum.  Each stratum is shared out by
proportion, with the cut points carried over from stratum to stratum along one
line of all subjects, so that totals are off by less than one subject per cut.
Who goes where within a stratum is decided by a hash.  Then few whole subjects move, so that sizes are met and
label shares come closer.  Nothing here needs all subjects in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import LABELS
from ..operators.checks import TableError
from ..operators.joins import salted_join
from ..operators.ranking import place_by_hash, running_total
from ..session import cut
from .eligibility import subject_table, without
from .refine import Goal, refined


def _shares(proportions: Mapping[str, float]) -> dict[str, float]:
    total = sum(proportions.values())
    if len(proportions) < 2 or min(proportions.values()) <= 0 or abs(total - 1) > 1e-8:
        raise ValueError("two or more positive proportions must add up to 1")
    return {k: v / total for k, v in proportions.items()}


def partition_subjects(subjects: DataFrame, subject: str, proportions: Mapping[str, float], labels: Sequence[str] = LABELS, seed: int = 42, out: str = "split") -> DataFrame:
    """``subject, out``: whole subjects shared out by ``proportions``, stratum by stratum.

    Strata lie on one line, rare labels first, and each has its stretch of it;
    a subject's part is named by where its place falls in a repeating pattern
    of the proportions that runs on from one stratum to the next.
    """
    shares = _shares(proportions)
    stratum = [*labels, "n_recordings"]
    placed = place_by_hash(subjects.select(subject, *stratum), stratum, subject, seed)
    sizes = subjects.groupBy(*stratum).agg(F.count(F.lit(1)).alias("__m"))
    sizes = running_total(sizes, [F.col(x).desc() for x in stratum], "__m", "__from")
    rows = salted_join(placed, sizes, stratum).withColumn("__u", (F.col("__from") + F.col("place") - 0.5) * F.lit(0.6180339887498949))
    u = F.col("__u") - F.floor("__u")
    name, upto = None, 0.0
    names = list(shares)
    for k in names[:-1]:
        upto += shares[k]
        name = F.when(u < upto, k) if name is None else name.when(u < upto, k)
    return rows.select(subject, name.otherwise(names[-1]).alias(out))


def _totals(subjects: DataFrame, labels: Sequence[str]) -> tuple[int, list[float]]:
    r = subjects.agg(F.sum("n_recordings").alias("n_recordings"), *[F.sum(x).alias(x) for x in labels]).first()
    return int(r["n_recordings"] or 0), [float(r[x] or 0) for x in labels]


def _goals(total: int, positives: Sequence[float], shares: Mapping[str, float]) -> dict[str, Goal]:
    """Whole records by largest remainder, positives by share."""
    exact = {k: total * v for k, v in shares.items()}
    whole = {k: int(v) for k, v in exact.items()}
    for k in sorted(exact, key=lambda k: (whole[k] - exact[k], k))[: total - sum(whole.values())]:
        whole[k] += 1
    return {k: Goal(whole[k], tuple(p * shares[k] for p in positives)) for k in shares}


def select_subset(records: DataFrame, subject: str, target: int, labels: Sequence[str] = LABELS, seed: int = 42, prevalence: Sequence[float] | None = None) -> DataFrame:
    """Records of whole subjects, ``target`` of them, with the label shares of all or those of ``prevalence``.

    The target is met exactly if there are enough subjects of few recordings;
    else the size is the nearest that whole subjects gave.  A target of all
    records or more takes all.
    """
    if target <= 0:
        raise ValueError("target must be positive")
    subjects = cut(subject_table(records, subject, labels))
    total, positives = _totals(subjects, labels)
    if total <= target:
        return records
    wanted = [p * target for p in prevalence] if prevalence is not None else [p * target / total for p in positives]
    goals = {"in": Goal(target, tuple(wanted)), "out": Goal(total - target, tuple(p - w for p, w in zip(positives, wanted)))}
    parts = partition_subjects(subjects, subject, {"in": target / total, "out": 1 - target / total}, labels, seed, "__part")
    picked = refined(cut(parts), subjects, subject, "__part", goals, labels, seed).where(F.col("__part") == "in")
    return records.join(picked.select(subject), subject, "left_semi")


def assign_splits(records: DataFrame, subject: str, proportions: Mapping[str, float] | None = None, labels: Sequence[str] = LABELS, seed: int = 42) -> DataFrame:
    """``records`` with ``split``: whole subjects, by default 80/10/10; sizes as ``select_subset`` meets them."""
    shares = _shares(proportions or {"train": 0.8, "validation": 0.1, "test": 0.1})
    subjects = cut(subject_table(records, subject, labels))
    parts = cut(partition_subjects(subjects, subject, shares, labels, seed))
    parts = refined(parts, subjects, subject, "split", _goals(*_totals(subjects, labels), shares), labels, seed)
    return salted_join(records.drop("split"), parts, [subject])


def partition_errors(records: DataFrame, split: str, shares: Mapping[str, float], labels: Sequence[str] = LABELS) -> DataFrame:
    """``split, records, wanted, label, prevalence, overall, error`` of each part and label."""
    sums = [F.sum(x).cast("double").alias(x) for x in labels]
    per = records.groupBy(F.col(split).alias("split")).agg(F.count(F.lit(1)).alias("records"), *sums)
    whole = records.agg(F.count(F.lit(1)).alias("__n"), *[F.avg(x).alias(f"__{x}") for x in labels])
    share: Column = F.lit(None)
    for k, v in _shares(shares).items():
        share = F.when(F.col("split") == k, v).otherwise(share)
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("label"), (F.col(x) / F.col("records")).alias("prevalence"), F.col(f"__{x}").alias("overall")) for x in labels])).alias("e")
    rows = per.join(F.broadcast(whole)).select("split", "records", (share * F.col("__n")).alias("wanted"), each)
    return rows.select("split", "records", "wanted", "e.*").withColumn("error", F.abs(F.col("prevalence") - F.col("overall")))


def select_exact(records: DataFrame, key: str, n: int, labels: Sequence[str] = LABELS, seed: int = 42) -> DataFrame:
    """Exactly ``n`` records (or all, if fewer), each label signature by its share.

    Quotas are rounded by largest remainder, ties by signature; within a
    signature a hash decides.
    """
    counts = records.groupBy(*labels).agg(F.count(F.lit(1)).alias("__m"))
    all_rows = Window.partitionBy()
    exact = F.col("__m") * F.lit(float(n)) / F.sum("__m").over(all_rows)
    counts = counts.withColumn("__e", F.least(exact, F.col("__m").cast("double"))).withColumn("__q", F.floor("__e"))
    left = F.least(F.lit(n), F.sum("__m").over(all_rows)) - F.sum("__q").over(all_rows)
    turn = F.row_number().over(Window.orderBy((F.col("__e") - F.col("__q")).desc(), *labels))
    quotas = counts.withColumn("__q", F.col("__q") + (turn <= left).cast("bigint")).select(*labels, "__q")
    placed = place_by_hash(records, labels, key, seed)
    return placed.join(quotas, list(labels)).where(F.col("place") <= F.col("__q")).drop("place", "__q")


def repair(manifest: DataFrame, eligible_records: DataFrame, failed: DataFrame, subject: str, study: str, labels: Sequence[str] = LABELS, seed: int = 42) -> DataFrame:
    """The manifest without failed studies, each split filled up to its old size with unused subjects.

    Replacements come from eligible subjects that the manifest doesn't use and
    that have no failed study; whole subjects, exactly as many records as failed
    in the split, with the label shares of the failed ones.  If whole subjects
    can't give that number, this is an error.
    """
    manifest = cut(manifest)
    kept = without(manifest, failed, study)
    gone = manifest.join(kept.select(study), study, "left_anti")
    lost = gone.groupBy("split").agg(F.count(F.lit(1)).alias("n"), *[F.avg(x).alias(x) for x in labels]).collect()
    unused = cut(eligible_records.join(manifest.select(subject).distinct(), subject, "left_anti"))
    tainted = unused.join(without(unused, failed, study).select(study), study, "left_anti").select(subject).distinct()
    spare = cut(unused.join(tainted, subject, "left_anti"))
    out = kept
    for i, row in enumerate(sorted(lost, key=lambda r: r["split"])):
        more = cut(select_subset(spare, subject, row["n"], labels, seed + 10007 * i, [row[x] or 0.0 for x in labels]))
        found = more.count()
        if found != row["n"]:
            raise TableError(f"split {row['split']} needs {row['n']} records, whole unused subjects give {found}")
        out = out.unionByName(more.withColumn("split", F.lit(row["split"])).select(*out.columns))
        spare = spare.join(more.select(subject).distinct(), subject, "left_anti")
    return out
