"""Queries on readings and raw signal labels (problems 1 and 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.packed import explode_packed
from ..operators import implausible
from ..session import table
from . import Catalog

catalog = Catalog()

#: The readings of problem 1 in one unit, and the three tests on them.
_CASES = """
WITH r AS (
  SELECT reading_id, signal_path, device, lead, second_no,
         CASE WHEN isfinite(amp) THEN round(CASE WHEN lower(trim(unit)) = 'uv' THEN amp / 1000 ELSE amp END, 9) ELSE amp END AS mv
  FROM lead_readings WHERE amp IS NOT NULL),
q AS (
  SELECT device, quantile_cont(mv, 0.5) AS med, (quantile_cont(mv, 0.84) - quantile_cont(mv, 0.16)) / 2 AS spread
  FROM r WHERE isfinite(mv) AND mv >= 0 GROUP BY device),
s AS (SELECT DISTINCT signal_path, device, lead, second_no, mv FROM r WHERE isfinite(mv)),
m AS (
  SELECT *, CASE WHEN mv = lag(mv) OVER (PARTITION BY signal_path, device, lead ORDER BY second_no, mv) THEN 0 ELSE 1 END AS starts FROM s),
g AS (
  SELECT *, sum(starts) OVER (PARTITION BY signal_path, device, lead ORDER BY second_no, mv ROWS UNBOUNDED PRECEDING) AS no FROM m),
n AS (SELECT *, count(*) OVER (PARTITION BY signal_path, device, lead, no) AS len FROM g),
c AS (
  SELECT reading_id, signal_path, device, 'impossible' AS kind FROM r WHERE NOT isfinite(mv) OR mv < 0
  UNION ALL SELECT reading_id, signal_path, r.device, 'spike' FROM r JOIN q ON r.device = q.device WHERE isfinite(mv) AND abs(mv - med) > 10 * spread
  UNION ALL SELECT r.reading_id, r.signal_path, r.device, 'stuck' FROM r JOIN n ON r.signal_path = n.signal_path AND r.device = n.device
    AND r.lead = n.lead AND r.second_no = n.second_no AND r.mv = n.mv AND n.len >= 10)
"""


@catalog.query("p1_found", _CASES + "SELECT DISTINCT reading_id FROM c")
def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Readings that their device can't plausibly have measured."""
    return implausible.implausible_readings(table(spark, root, "lead_readings")).select("reading_id").distinct()


@catalog.query(
    "p1_devices",
    _CASES
    + """, per AS (SELECT device, count(DISTINCT CASE WHEN kind = 'impossible' THEN reading_id END) AS impossible,
         count(DISTINCT CASE WHEN kind = 'spike' THEN reading_id END) AS spike,
         count(DISTINCT CASE WHEN kind = 'stuck' THEN reading_id END) AS stuck FROM c GROUP BY device)
SELECT r.device, count(*) AS readings, coalesce(max(impossible), 0) AS impossible, coalesce(max(spike), 0) AS spike, coalesce(max(stuck), 0) AS stuck
FROM r LEFT JOIN per ON r.device IS NOT DISTINCT FROM per.device GROUP BY r.device""",
)
def p1_devices(spark: SparkSession, root: str) -> DataFrame:
    """Non-null readings of each device and how many of each kind are implausible."""
    df = table(spark, root, "lead_readings")
    bad = implausible.implausible_readings(df)
    by_kind = bad.groupBy("reading_id").agg(*[F.max((F.col("kind") == k).cast("int")).alias(k) for k in ("impossible", "spike", "stuck")])
    per = df.select("reading_id", "device").join(by_kind, "reading_id").groupBy("device").agg(*[F.sum(k).alias(k) for k in ("impossible", "spike", "stuck")])
    seen = df.where(F.col("amp").isNotNull()).groupBy("device").agg(F.count(F.lit(1)).alias("readings"))
    out = seen.alias("a").join(per.alias("b"), F.col("a.device").eqNullSafe(F.col("b.device")), "left")
    return out.select("a.device", "readings", *[F.coalesce(F.col(k), F.lit(0)).cast("bigint").alias(k) for k in ("impossible", "spike", "stuck")])


@catalog.query(
    "p1_signal_flags",
    _CASES
    + """, per AS (SELECT signal_path, max(CASE WHEN kind = 'impossible' THEN 1 ELSE 0 END) AS bad, max(CASE WHEN kind = 'stuck' THEN 1 ELSE 0 END) AS flat,
         max(CASE WHEN kind = 'spike' THEN 1 ELSE 0 END) AS spiky FROM c GROUP BY signal_path),
measured AS (SELECT DISTINCT signal_path FROM lead_readings WHERE amp IS NOT NULL)
SELECT i.index_id, i.file, i.has_nan, i.is_flatline, coalesce(bad, 0) AS has_impossible, coalesce(flat, 0) AS has_stuck, coalesce(spiky, 0) AS has_spike
FROM signal_index i JOIN measured m ON i.file = m.signal_path LEFT JOIN per ON i.file = per.signal_path""",
)
def p1_signal_flags(spark: SparkSession, root: str) -> DataFrame:
    """The index's own signal flags beside what the readings of the same file show.

    Files without any reading are left out.
    """
    df = table(spark, root, "lead_readings")
    bad = implausible.implausible_readings(df).groupBy("reading_id").agg(*[F.max((F.col("kind") == k).cast("int")).alias(k) for k in ("impossible", "spike", "stuck")])
    per = (
        df.where(F.col("amp").isNotNull())
        .select("reading_id", F.col("signal_path").alias("file"))
        .join(bad, "reading_id", "left")
        .groupBy("file")
        .agg(*[F.coalesce(F.max(k), F.lit(0)).alias(f"has_{k}") for k in ("impossible", "stuck", "spike")])
    )
    return table(spark, root, "signal_index").select("index_id", "file", "has_nan", "is_flatline").join(per, "file").select("index_id", "file", "has_nan", "is_flatline", "has_impossible", "has_stuck", "has_spike")


@catalog.query("p1_off_profile")
def p1_off_profile(spark: SparkSession, root: str) -> DataFrame:
    """Readings that stick out of what is usual at their place in their device's profiles, with how far."""
    found = implausible.off_profile(implausible.readings(table(spark, root, "lead_readings")))
    return found.select("reading_id", "device", *[F.round(c, 4).alias(c) for c in ("z", "usual", "residual")])


@catalog.query("p6_found")
def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """One row per label code of each raw label field, with its position."""
    return explode_packed(table(spark, root, "signal_index"), ["index_id"], "raw_labels")
