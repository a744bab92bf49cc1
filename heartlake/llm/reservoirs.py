"""A sample with given shares of categories, from mergeable reservoirs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.listings import split_name
from ..session import cut

FLAGS = ["af_afl", "lbbb", "rbbb", "av_block_1"]
_BUCKET_BITS = 12
_PRIORITY_BITS = 60


def eligible(manifest: DataFrame) -> DataFrame:
    """Distinct ``record_id`` and category of the train listings whose four flags are all 0 or 1.

    A record listed with different flags stands in each of its categories.
    """
    fine = split_name(F.col("split")) == "train"
    for f in FLAGS:
        fine = fine & F.col(f).isin(0, 1)
    return manifest.where(fine & F.col("record_id").isNotNull()).select("record_id", *[F.col(f).cast("int").alias(f) for f in FLAGS]).distinct()


def prioritised(rows: DataFrame, seed: int) -> DataFrame:
    """Each record with a random but repeatable priority."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("record_id"))), 1, _PRIORITY_BITS // 4), 16, 10).cast("bigint")
    return rows.withColumn("priority", bits)


class Reservoir:
    """The ``room`` records of smallest priority of one category, and how many it was offered.

    Two merge by keeping the smallest of both and adding the counts.
    """

    def __init__(self, room: int):
        self.room, self.seen, self.priority, self.record = room, 0, np.zeros(0, np.int64), np.zeros(0, object)

    def offer(self, priority: np.ndarray, record: np.ndarray) -> None:
        self.seen += len(priority)
        self.priority, self.record = np.concatenate([self.priority, priority]), np.concatenate([self.record, record])
        if len(self.priority) > 2 * self.room:
            self.trim()

    def trim(self) -> None:
        if len(self.priority) > self.room:
            # records of equal priority go by their name, as everywhere
            keep = np.lexsort((self.record.astype(str), self.priority))[: self.room]
            self.priority, self.record = self.priority[keep], self.record[keep]


def _fill(room: dict[tuple[int, ...], int]):
    """One partition's rows to its reservoirs: a row per kept record, and one with ``seen`` per category."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, ...], Reservoir] = {}
        for batch in batches:
            flags = np.stack([batch.column(f).to_numpy() for f in FLAGS], 1)
            code = flags @ (1 << np.arange(len(FLAGS)))
            record, priority = batch.column("record_id").to_numpy(zero_copy_only=False), batch.column("priority").to_numpy()
            for c in np.unique(code):
                here = np.nonzero(code == c)[0]
                category = tuple(int(x) for x in flags[here[0]])
                held.setdefault(category, Reservoir(room.get(category, 0))).offer(priority[here], record[here])
        for category, r in held.items():
            r.trim()
            n = len(r.priority) + 1
            columns = [pa.array([x] * n, pa.int32()) for x in category]
            columns += [pa.array([*r.record, None], pa.string()), pa.array([*r.priority.tolist(), None], pa.int64()), pa.array([None] * (n - 1) + [r.seen], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*FLAGS, "record_id", "priority", "seen"])

    return run


def reservoirs(manifest: DataFrame, plan: DataFrame, seed: int = 42) -> DataFrame:
    """The reservoirs of all parts of the table, in one pass: ``record_id, priority`` of kept records, ``seen`` of each part.

    Copies of a record meet in one part first, so parts share no record and
    their counts add up.  A category's room is the largest sample any plan
    could ask of it; a category in no plan is only counted.  The room of at
    most 2^4 categories is what is collected.
    """
    most = F.when(F.col("target_share") > 0, F.greatest("sample_size", F.coalesce("min_rows", F.lit(0)))).otherwise(F.coalesce("min_rows", F.lit(0)))
    room = {tuple(int(r[f]) for f in FLAGS): int(r["room"] or 0) for r in plan.where(" and ".join(f"{f} in (0, 1)" for f in FLAGS)).groupBy(*FLAGS).agg(F.max(most).alias("room")).collect()}
    schema = ", ".join(f"{f} int" for f in FLAGS) + ", record_id string, priority bigint, seen bigint"
    return cut(prioritised(eligible(manifest), seed).select(*FLAGS, "record_id", "priority").mapInArrow(_fill(room), schema))


def fill(parts: DataFrame) -> DataFrame:
    """``held`` and ``available`` of each category's merged reservoir."""
    return parts.groupBy(*FLAGS).agg(F.count("record_id").alias("held"), F.sum("seen").alias("available"))


def quotas(plan: DataFrame, filled: DataFrame) -> DataFrame:
    """Plan categories with ``available``, ``quota``, ``drawn``, ``share`` and whether they fall ``short``.

    Within a plan every category gets its exact share of the sample times one
    common factor, but no less than its minimum and no more than it has; the
    factor is the one by which the quotas add up to the sample.  So what
    exhausted categories leave, or minima take, is spread over the others in
    their target proportions.  Only if all together have fewer records, or the
    minima alone are more, the quotas add up to that instead.  Fractions are
    rounded by largest remainder.  A category is short if its reservoir holds
    fewer records than its exact share of the sample or than its minimum.
    """
    w = Window.partitionBy("plan_id")
    minimum = F.coalesce("min_rows", F.lit(0))
    p = (
        plan.select("plan_id", "cat_id", *FLAGS, "target_share", "sample_size", "min_rows")
        .join(filled, FLAGS, "left")
        .withColumn("available", F.coalesce("available", F.lit(0)).cast("bigint"))
        .withColumn("held", F.coalesce("held", F.lit(0)).cast("bigint"))
        .withColumn("exact", F.coalesce(F.round(F.col("target_share") * F.col("sample_size"), 9), F.lit(0.0)))
        .withColumn("low", F.least("available", minimum).cast("double"))
        .withColumn("high", F.when(F.col("exact") > 0, F.col("available")).otherwise(F.col("low")).cast("double"))
    )
    part = _factor(p)
    p = (
        p.join(part, "plan_id", "left")
        .withColumn("fair", F.round(F.greatest("low", F.least("high", F.coalesce("factor", F.lit(0.0)) * F.col("exact"))), 6))
        .withColumn("whole", F.floor("fair"))
        .withColumn("left", F.round(F.sum("fair").over(w) - F.sum("whole").over(w)))
        .withColumn("turn", F.row_number().over(w.orderBy((F.col("fair") - F.col("whole")).desc(), "cat_id")))
        .withColumn("quota", (F.col("whole") + (F.col("turn") <= F.col("left")).cast("int")).cast("bigint"))
    )
    short = (F.col("held") < F.col("exact")) | (F.col("held") < F.col("min_rows"))
    drawn = F.col("quota")
    share = F.round(drawn / F.nullif(F.sum("quota").over(w), F.lit(0)), 6)
    return p.select("plan_id", "cat_id", *FLAGS, "target_share", "sample_size", "min_rows", "available", "quota", drawn.alias("drawn"), share.alias("share"), F.coalesce(short, F.lit(False)).alias("short"))


def _factor(p: DataFrame) -> DataFrame:
    """``plan_id, factor`` at which the bounded shares of a plan add up to its sample.

    Their sum grows with the factor in straight pieces that end where a category
    leaves its minimum or reaches its bound; the piece that holds the sample
    gives the factor.  Beyond the last piece the factor is that piece's end.
    """
    w = Window.partitionBy("plan_id")

    def end(at: Column, slope: Column) -> Column:
        return F.struct((at / F.col("exact")).alias("at"), slope.alias("slope"))

    ends = p.where(F.col("exact") > 0).select("plan_id", F.explode(F.array(end(F.col("low"), F.col("exact")), end(F.col("high"), -F.col("exact")))).alias("e")).groupBy("plan_id", F.col("e.at").alias("at")).agg(F.sum("e.slope").alias("slope"))
    floor = p.groupBy("plan_id").agg(F.sum("low").alias("lowest"), F.max("sample_size").cast("double").alias("size"))
    o = w.orderBy("at")
    steps = ends.withColumn("slope", F.sum("slope").over(o.rowsBetween(Window.unboundedPreceding, 0))).withColumn("next", F.lead("at").over(o))
    steps = steps.withColumn("gain", F.coalesce(F.col("slope") * (F.col("next") - F.col("at")), F.lit(0.0)))
    steps = steps.withColumn("before", F.coalesce(F.sum("gain").over(o.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).join(floor, "plan_id")
    need = F.col("size") - F.col("lowest") - F.col("before")
    inside = F.when(need <= 0, F.col("at")).when((F.col("gain") > 0) & (need <= F.col("gain")), F.col("at") + need / F.col("slope"))
    # the first piece that reaches the sample; else all there is
    return steps.groupBy("plan_id").agg(F.coalesce(F.min(inside), F.max("at")).alias("factor"))


def report(manifest: DataFrame, plan: DataFrame, seed: int = 42) -> DataFrame:
    """The quotas of all plan categories, by the reservoirs' fill."""
    return quotas(plan, fill(reservoirs(manifest, plan, seed)))


def draw(manifest: DataFrame, plan: DataFrame, seed: int = 42) -> DataFrame:
    """``plan_id, cat_id, record_id``: the sample of each plan.

    A category's reservoir holds the records of smallest priority; reservoirs
    of parts of the data merge by taking the smallest again.  The merge counts
    kept records per priority bucket, finds the bucket in which each quota ends,
    drops what lies beyond and ranks the others within their bucket, so a
    category of any share of the data is spread over its buckets.  The trim to
    a quota keeps the smallest priorities, which is a uniform sample without
    replacement.
    """
    parts = reservoirs(manifest, plan, seed)
    rows = parts.where(F.col("record_id").isNotNull()).withColumn("bucket", F.shiftright("priority", _PRIORITY_BITS - _BUCKET_BITS))
    per = rows.groupBy(*FLAGS, "bucket").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy(*FLAGS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumn("before", F.sum("n").over(upto) - F.col("n"))
    wanted = quotas(plan, fill(parts)).where(F.col("drawn") > 0)
    deepest = wanted.groupBy(*FLAGS).agg(F.max("drawn").alias("deepest"))
    open_buckets = per.join(deepest, FLAGS).where(F.col("before") < F.col("deepest")).select(*FLAGS, "bucket", "before")
    inside = Window.partitionBy(*FLAGS, "bucket").orderBy("priority", "record_id")
    reservoir = rows.join(open_buckets, [*FLAGS, "bucket"]).withColumn("place", F.col("before") + F.row_number().over(inside))
    return reservoir.join(wanted.select("plan_id", "cat_id", *FLAGS, "drawn"), FLAGS).where(F.col("place") <= F.col("drawn")).select("plan_id", "cat_id", "record_id")
