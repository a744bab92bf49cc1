"""Readings that a source can't plausibly have measured.

Three tests, each on its own: physically impossible values, spikes against the
source's normal behaviour, and values that are stuck.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import exact_quantiles
from .robust_pca import with_residuals


@dataclass(frozen=True)
class SpikeRule:
    """Parameters of the three tests.

    ``spreads``: distance from the source's median, in spreads, from which on a
    value is a spike; the spread is half the width of the middle ``middle`` of
    the readings.  ``run``: equal values in a row that make a value stuck.
    ``profile``: seconds of one profile row; ``block_rows``: profile rows of a
    source that are separated together.  ``box`` and ``least`` bound the
    low-rank part and the sparse part, in spreads; together they must stay
    below ``spreads``, which makes the candidate search complete.
    ``chunk``: seconds of one piece of a series in the search for runs.
    """

    spreads: float = 10.0
    middle: float = 0.68
    run: int = 10
    profile: int = 64
    block_rows: int = 256
    box: float = 4.0
    least: float = 5.0
    chunk: int = 256

    def __post_init__(self) -> None:
        if not self.box + self.least < self.spreads:
            raise ValueError("box + least must be below spreads")
        if not 0 < self.middle < 1 or self.run < 2:
            raise ValueError("middle must lie in (0, 1) and run be 2 or more")


def millivolts(amp: Column, unit: Column) -> Column:
    """``amp`` in millivolts, to nine decimals.

    Microvolts in any spelling are divided by 1000, volts multiplied; any other
    or no unit is taken as millivolts.  NaN and infinities stay.
    """
    u = F.lower(F.trim(unit))
    factor = F.when(u.isin("uv", "µv", "μv"), F.lit(0.001)).when(u == "v", F.lit(1000.0)).otherwise(F.lit(1.0))
    scaled = F.when(u.isin("uv", "µv", "μv"), amp / F.lit(1000.0)).otherwise(amp * factor)
    finite = ~F.isnan(amp) & (F.abs(amp) < F.lit(1e300))
    return F.when(finite, F.round(scaled, 9)).otherwise(amp)


def _series(*columns: str) -> Column:
    """One text key of several columns; nulls are a value of their own."""
    return F.concat_ws("\u0001", *[F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-")) for c in columns])


def readings(df: DataFrame) -> DataFrame:
    """The columns the tests need, amplitudes in one unit, nulls left out."""
    return df.where(F.col("amp").isNotNull()).select(
        "reading_id",
        "device",
        F.when(F.col("signal_path").isNotNull(), _series("signal_path", "device", "lead")).alias("series"),
        "second_no",
        millivolts(F.col("amp").cast("double"), F.col("unit")).alias("mv"),
    )


def _finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def device_profile(read: DataFrame, rule: SpikeRule) -> DataFrame:
    """Median and usual spread of each device over all its finite, non-negative readings."""
    low = (1 - rule.middle) / 2
    fine = read.where(_finite(F.col("mv")) & (F.col("mv") >= 0) & F.col("device").isNotNull())
    q = exact_quantiles(fine, ["device"], "mv", {"q_low": low, "median": 0.5, "q_high": 1 - low})
    return q.select("device", "median", ((F.col("q_high") - F.col("q_low")) / 2).alias("spread"), "n_values")


def profiled(read: DataFrame, rule: SpikeRule = SpikeRule()) -> DataFrame:
    """``reading_id, device, impossible, z, usual, residual`` of all readings.

    ``z`` is the deviation from the device's median in spreads.  The profile
    rows of a device, ``profile`` seconds of one series each, are parted into
    blocks of about ``block_rows``, and robust principal components separate
    each block into the low-rank behaviour that is ``usual`` and the rest.  A
    device whose spread is 0 has an endless ``z`` in every value off its median.
    Readings without a finite value or a device have null in all three.
    """
    profile = device_profile(read, rule)
    off = F.col("mv") - F.col("median")
    # a device without spread: any deviation lies beyond every bound
    z = F.when(F.col("spread") > 0, off / F.col("spread")).otherwise(F.signum(off) * F.lit(1e9))
    second = F.coalesce(F.col("second_no"), F.lit(0))
    row = F.xxhash64(F.coalesce("series", F.lit("")), F.floor(second / rule.profile))
    # as many readings as full blocks would have, whatever share of all a device has
    blocks = F.ceil(F.coalesce("n_values", F.lit(1)) / (rule.profile * rule.block_rows)).cast("bigint")
    cells = read.join(profile, "device", "left").select(
        "reading_id",
        "device",
        (~_finite(F.col("mv")) | (F.col("mv") < 0)).alias("impossible"),
        # readings without a profile only pass through, spread by their id
        F.when(F.col("n_values").isNull(), F.pmod(F.xxhash64("reading_id"), F.lit(4096))).otherwise(F.pmod(row, blocks)).alias("block"),
        row.alias("profile_row"),
        F.pmod(second, F.lit(rule.profile)).cast("int").alias("place"),
        F.when(_finite(F.col("mv")) & F.col("n_values").isNotNull(), F.greatest(F.lit(-1e9), F.least(F.lit(1e9), z))).alias("z"),
    )
    return with_residuals(cells, "device", "block", "profile_row", "place", "z", rule.profile, rule.box).drop("block", "profile_row", "place")


def off_profile(read: DataFrame, rule: SpikeRule = SpikeRule()) -> DataFrame:
    """``reading_id, device, z, usual, residual`` of readings in the sparse part: they lie ``least`` spreads or more off what is usual at their place.

    Among them are readings that lie within their device's range, but not where
    its profiles have them.
    """
    return profiled(read, rule).where(F.abs("residual") > rule.least).drop("impossible")


def impossible_or_spike(read: DataFrame, rule: SpikeRule = SpikeRule()) -> DataFrame:
    """``reading_id, kind`` of readings that no source can give, and of those too far from the normal behaviour of theirs.

    NaN, infinite and negative readings are impossible.  Candidates for spikes
    are the sparse part of their block; they are held against the device's
    median and spread.  The low-rank part stays within ``box``, so every value
    beyond the limit is a candidate.
    """
    spike = (F.abs("residual") > rule.least) & (F.abs("z") > rule.spreads)
    kinds = F.array_compact(F.array(F.when(F.col("impossible"), F.lit("impossible")), F.when(spike, F.lit("spike"))))
    return profiled(read, rule).select("reading_id", F.explode(kinds).alias("kind"))


def stuck_runs(read: DataFrame, rule: SpikeRule = SpikeRule()) -> DataFrame:
    """Runs of ``run`` or more equal values by second: ``series, mv, from_second, to_second``.

    A series is the readings of one device and lead in one file; readings
    without a file are in none.  It is searched in pieces of ``chunk`` seconds, and only the first and
    last run of each piece are put together across pieces, so no series is ever
    sorted in one task.  Repeated deliveries count once.
    """
    once = (
        read.where(_finite(F.col("mv")) & F.col("second_no").isNotNull() & F.col("series").isNotNull())
        .select("series", F.floor(F.col("second_no") / rule.chunk).alias("piece"), "second_no", "mv")
        .distinct()
    )
    w = Window.partitionBy("series", "piece").orderBy("second_no", "mv")
    starts = F.when(F.col("mv") == F.lag("mv").over(w), 0).otherwise(1)
    runs = (
        once.withColumn("new", starts)
        .withColumn("no", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("series", "piece", "no")
        .agg(F.first("mv").alias("mv"), F.count(F.lit(1)).alias("n"), F.min("second_no").alias("from_second"), F.max("second_no").alias("to_second"))
        .withColumn("last_no", F.max("no").over(Window.partitionBy("series", "piece")))
    )
    edge = (F.col("no") == 1) | (F.col("no") == F.col("last_no"))
    inside = runs.where(~edge & (F.col("n") >= rule.run)).select("series", "mv", "from_second", "to_second")
    o = Window.partitionBy("series").orderBy("piece", "no")
    goes_on = (F.col("no") == 1) & (F.lag("piece").over(o) < F.col("piece")) & (F.lag("no").over(o) == F.lag("last_no").over(o)) & (F.lag("mv").over(o) == F.col("mv"))
    across = (
        runs.where(edge)
        .withColumn("new", F.when(goes_on, 0).otherwise(1))
        .withColumn("chain", F.sum("new").over(o.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("series", "chain")
        .agg(F.first("mv").alias("mv"), F.sum("n").alias("n"), F.min("from_second").alias("from_second"), F.max("to_second").alias("to_second"))
        .where(F.col("n") >= rule.run)
        .select("series", "mv", "from_second", "to_second")
    )
    return inside.unionByName(across)


def stuck(read: DataFrame, rule: SpikeRule = SpikeRule()) -> DataFrame:
    """Every delivery of a reading that belongs to a stuck run.

    Runs are cut at the pieces of their series, so a run of any length meets
    its readings piece by piece.
    """
    piece = F.floor(F.col("second_no") / rule.chunk)
    cuts = F.sequence(F.floor(F.col("from_second") / rule.chunk), F.floor(F.col("to_second") / rule.chunk))
    runs = stuck_runs(read, rule).withColumn("piece", F.explode(cuts))
    between = (F.col("r.second_no") >= F.col("s.from_second")) & (F.col("r.second_no") <= F.col("s.to_second"))
    same = (F.col("r.series") == F.col("s.series")) & (F.col("r.mv") == F.col("s.mv")) & (F.col("r.piece") == F.col("s.piece"))
    return read.withColumn("piece", piece).alias("r").join(runs.alias("s"), same & between, "left_semi").select("reading_id")


def implausible_readings(df: DataFrame, rule: SpikeRule = SpikeRule()) -> DataFrame:
    """``reading_id`` and ``kind`` (impossible, spike, stuck) of all implausible readings.

    A reading may have several kinds.  An empty table gives no rows; readings
    with a null amplitude are never implausible.
    """
    read = readings(df)
    return impossible_or_spike(read, rule).unionByName(stuck(read, rule).withColumn("kind", F.lit("stuck")))
