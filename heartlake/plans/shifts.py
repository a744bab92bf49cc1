"""How far two datasets lie apart: demographic, domain and label shift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.divergence import kl_nats
from ..operators.checks import TableError, require_columns, require_unique

#: The count columns and the columns of the written table.
AGE = ("age_0_44_count", "age_45_74_count", "age_75_plus_count")
SEX = ("sex_female_count", "sex_male_count")
OUTPUT = ("source_dataset", "target_dataset", "age_kl_nats", "sex_kl_nats", "demographic_kl_nats", "ps_threshold_nats", "PS", "DS", "LS", "shift_vector", "weight_w_ij", "source_age_n", "target_age_n", "source_sex_n", "target_sex_n", "source_metadata_basis", "target_metadata_basis", "ds_reason", "ls_reason")


def check_datasets(demographics: DataFrame, datasets: Sequence[str]) -> None:
    """Raise unless there is exactly one row for each of ``datasets``."""
    require_unique(demographics, ["dataset"], "demographics")
    names = {r["dataset"] for r in demographics.select("dataset").limit(len(datasets) + 1).collect()}
    if names != set(datasets):
        raise TableError(f"demographics must be of {list(datasets)}, not {sorted(map(str, names))}")


def ordered_pairs(df: DataFrame, name: str = "dataset") -> DataFrame:
    """Each row with each other row, both ways: structs ``s`` and ``t``.

    One row per dataset: a table of a few rows, joined on a condition.
    """
    s, t = df.select(F.struct("*").alias("s")), df.select(F.struct("*").alias("t"))
    return s.join(t, F.col(f"s.{name}") != F.col(f"t.{name}"))


def domain_shift() -> tuple[Column, Column]:
    """Flag and reason: another sampling rate, or else documented hardware that differs."""
    rates = F.col("s.sampling_rate_hz") != F.col("t.sampling_rate_hz")
    known = (F.col("s.hardware_documented") == 1) & (F.col("t.hardware_documented") == 1)
    hardware = known & (F.col("s.hardware_group") != F.col("t.hardware_group"))
    reason = (
        F.when(rates, F.format_string("sampling rate differs (%d vs %d Hz)", F.col("s.sampling_rate_hz").cast("int"), F.col("t.sampling_rate_hz").cast("int")))
        .when(hardware, "documented acquisition hardware differs")
        .otherwise("same sampling rate; undocumented hardware is not treated as different")
    )
    return F.coalesce(rates | hardware, F.lit(False)).cast("int"), reason


def shift_vectors(demographics: DataFrame, age: Sequence[str] = AGE, sex: Sequence[str] = SEX, threshold: float = 0.10, pseudo: float = 0.5, weights: tuple[int, int, int] = (1, 2, 3)) -> DataFrame:
    """One row per ordered pair of datasets with its divergences, its three flags and their weight.

    PS is set if the divergences of age and sex together exceed ``threshold``.
    Numbers stay numbers; ``formatted`` makes the text form.
    """
    require_columns(demographics, ["dataset", *age, *sex, "sampling_rate_hz", "hardware_group", "hardware_documented", "label_schema"], "demographics")
    basis = "metadata_basis" if "metadata_basis" in demographics.columns else None
    pairs = ordered_pairs(demographics)
    counts = lambda side, names: F.array(*[F.col(f"{side}.{n}").cast("double") for n in names])
    total = lambda side, names: sum((F.col(f"{side}.{n}") for n in names[1:]), F.col(f"{side}.{names[0]}")).cast("bigint")
    ds, ds_reason = domain_shift()
    ls = (F.col("s.label_schema") != F.col("t.label_schema")).cast("int")
    ls_reason = F.when(ls == 1, F.concat_ws(" vs ", "s.label_schema", "t.label_schema")).otherwise(F.format_string("same raw coding convention (%s)", F.col("s.label_schema")))
    out = pairs.select(
        F.col("s.dataset").alias("source_dataset"),
        F.col("t.dataset").alias("target_dataset"),
        kl_nats(counts("s", age), counts("t", age), pseudo).alias("age_kl_nats"),
        kl_nats(counts("s", sex), counts("t", sex), pseudo).alias("sex_kl_nats"),
        ds.alias("DS"),
        ls.alias("LS"),
        total("s", age).alias("source_age_n"),
        total("t", age).alias("target_age_n"),
        total("s", sex).alias("source_sex_n"),
        total("t", sex).alias("target_sex_n"),
        (F.col(f"s.{basis}") if basis else F.lit(None).cast("string")).alias("source_metadata_basis"),
        (F.col(f"t.{basis}") if basis else F.lit(None).cast("string")).alias("target_metadata_basis"),
        ds_reason.alias("ds_reason"),
        ls_reason.alias("ls_reason"),
    )
    out = out.withColumn("demographic_kl_nats", F.col("age_kl_nats") + F.col("sex_kl_nats")).withColumn("ps_threshold_nats", F.lit(float(threshold)))
    out = out.withColumn("PS", (F.col("demographic_kl_nats") > threshold).cast("int"))
    out = out.withColumn("shift_vector", F.format_string("(%d,%d,%d)", "PS", "DS", "LS")).withColumn("weight_w_ij", weights[0] * F.col("PS") + weights[1] * F.col("DS") + weights[2] * F.col("LS"))
    return out.select(*OUTPUT)


def formatted(shifts: DataFrame) -> DataFrame:
    """Divergences with six decimals and the threshold with two, as text."""
    six = ("age_kl_nats", "sex_kl_nats", "demographic_kl_nats")
    return shifts.withColumns({c: F.format_string("%.6f", c) for c in six} | {"ps_threshold_nats": F.format_string("%.2f", "ps_threshold_nats")})


def histogram(df: DataFrame, group: Sequence[str], value: str, low: float = 0, high: float = 100, step: float = 10, pseudo: int = 1) -> DataFrame:
    """``group, bin, n``: counts per fixed bin, each raised by ``pseudo``; the last bin holds its upper edge."""
    bins = int((high - low) / step)
    at = F.least(F.floor((F.col(value) - low) / step), F.lit(bins - 1))
    seen = df.where((F.col(value) >= low) & (F.col(value) <= high)).groupBy(*group, at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.select(*group).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(seen, [*group, "bin"], "left").select(*group, "bin", (F.coalesce("n", F.lit(0)) + pseudo).cast("bigint").alias("n"))


def null_threshold(df: DataFrame, key: str, value: str, replicates: int = 200, quantile: float = 0.95, low: float = 0, high: float = 100, step: float = 10, seed: int = 42) -> DataFrame:
    """``threshold``: the quantile of the divergence between random halves of the same data.

    Halves are drawn by hash, so replicates are columns of one count per bin
    and not copies of the data: a row adds to each replicate where it is.
    """
    bins = int((high - low) / step)
    at = F.least(F.floor((F.col(value) - low) / step), F.lit(bins - 1)).cast("int")
    rows = df.where((F.col(value) >= low) & (F.col(value) <= high)).select(at.alias("bin"), F.col(key).alias("k"))
    halves = [F.count_if(F.pmod(F.xxhash64(F.lit(seed + r), "k"), F.lit(2)) == 0).alias(f"r{r}") for r in range(replicates)]
    per = rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), *halves)
    long = per.select("bin", "n", F.posexplode(F.array(*[F.col(f"r{r}") for r in range(replicates)])).alias("replicate", "a"))
    sums = long.groupBy("replicate").agg(F.collect_list(F.struct("bin", F.col("a").cast("double").alias("a"), (F.col("n") - F.col("a")).cast("double").alias("b"))).alias("x"))
    filled = lambda side: F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.aggregate("x", F.lit(0.0), lambda s, e: s + F.when(e["bin"] == i, e[side]).otherwise(0.0)))
    kl = sums.select(kl_nats(filled("a"), filled("b"), 1.0).alias("kl"))
    return kl.agg(F.percentile("kl", F.lit(quantile)).alias("threshold"))
