"""Readings and report texts as they arrive.

Batch operators stay the reference for results; these answer early.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.implausible import SpikeRule, millivolts
from ..plans.labels import text_labels


def once(stream: DataFrame, time: str = "received_at", late: str = "2 days") -> DataFrame:
    """Deliveries without repeats of the same reading that come within ``late``; keys leave the state with the watermark."""
    keys = ["signal_path", "device", "lead", "second_no"]
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def spikes_of(stream: DataFrame, profile: DataFrame, rule: SpikeRule = SpikeRule()) -> DataFrame:
    """Readings beyond what ``profile`` (device, median, spread; of the last batch run) allows, and impossible ones."""
    mv = millivolts(F.col("amp").cast("double"), F.col("unit"))
    read = stream.where(F.col("amp").isNotNull()).select("reading_id", "device", "received_at", mv.alias("mv"))
    finite = ~F.isnan("mv") & (F.abs("mv") != float("inf"))
    far = finite & (F.abs(F.col("mv") - F.col("median")) > rule.spreads * F.col("spread"))
    kind = F.when(~finite | (F.col("mv") < 0), "impossible").when(far, "spike")
    return read.join(profile.select("device", "median", "spread"), "device", "left").withColumn("kind", kind).where(F.col("kind").isNotNull()).select("reading_id", "device", "received_at", "kind")


def per_window(stream: DataFrame, length: str = "5 minutes", late: str = "2 days", time: str = "received_at") -> DataFrame:
    """Readings and mean amplitude per device and window; a window is final when the watermark has passed it."""
    mv = millivolts(F.col("amp").cast("double"), F.col("unit"))
    timed = stream.where(F.col("amp").isNotNull() & ~F.isnan("amp") & (F.abs("amp") != float("inf"))).select("device", F.col(time).cast("timestamp").alias("at"), mv.alias("mv")).withWatermark("at", late)
    return timed.groupBy(F.window("at", length), "device").agg(F.count(F.lit(1)).alias("readings"), F.avg("mv").alias("mean_mv")).select(F.col("window.start").alias("from_time"), "device", "readings", "mean_mv")


def label_as_it_comes(stream: DataFrame, key: str, reports: list[str], patterns: dict[str, str], path: str, checkpoint: str) -> StreamingQuery:
    """Texts labelled file by file and appended to ``path``, each input once; ends when all that is there is read."""
    labelled = text_labels(stream, key, reports, patterns)
    return labelled.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start(path)
