"""Audit of overlaps between datasets: exact and near-equal windows, and their removal.

Exact matches join on the window hash.  Near ones are proposed by the cosine
of fingerprints: the ``k`` nearest source windows of each target window at or
above a cosine, found by random signs and verified exactly.  For a stated query
set there is an exact search too, block against block with NumPy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.listings import split_name
from ..operators.joins import salted_join
from ..operators.ranking import first_per_key, top_per_group
from ..operators.vector_join import near_join


@dataclass(frozen=True)
class AuditThresholds:
    """``k`` neighbours per target window of at least ``candidate_cosine``; a near
    match has ``median_correlation`` or more and ``median_nrmse`` or less."""

    k: int = 5
    candidate_cosine: float = 0.97
    median_correlation: float = 0.995
    median_nrmse: float = 0.15

    def __post_init__(self) -> None:
        if self.k < 1 or not -1 <= self.candidate_cosine <= 1 or not -1 <= self.median_correlation <= 1 or self.median_nrmse < 0:
            raise ValueError("thresholds out of range")


def _blocks(df: DataFrame, key: str, vector: str, blocks: int, name: str) -> DataFrame:
    """Usable vectors in ``blocks`` rows: ids and vectors of each block as arrays."""
    usable = df.where(F.col(vector).isNotNull() & (F.size(vector) > 0))
    return usable.groupBy(F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias(name)).agg(F.collect_list(F.struct(F.col(key).alias("id"), F.col(vector).alias("v"))).alias(f"{name}_rows"))


def cosine_top_k(queries: DataFrame, base: DataFrame, key: str, vector: str, k: int = 5, least: float = -1.0, block_rows: int = 4096) -> DataFrame:
    """``query_id, base_id, cosine, rank``: exact ``k`` nearest by cosine, the row itself aside.

    Both sides are cut into blocks of about ``block_rows`` vectors and every
    query block meets every base block in one matrix product, so a task holds
    two blocks.  Zero vectors and vectors of another length match nothing.  The
    work is the product of the sides: state a query set for large collections.
    """
    q_blocks, b_blocks = (max(1, -(-df.count() // block_rows)) for df in (queries, base))
    q, b = _blocks(queries, key, vector, q_blocks, "qb"), _blocks(base, key, vector, b_blocks, "bb")

    def unit(rows: list) -> tuple[np.ndarray, np.ndarray]:
        size = max((len(r["v"]) for r in rows), default=0)
        rows = [r for r in rows if len(r["v"]) == size]
        ids, m = np.array([r["id"] for r in rows], dtype=object), np.array([r["v"] for r in rows], dtype=np.float64)
        length = np.sqrt((m * m).sum(1)) if len(rows) else np.zeros(0)
        ok = np.isfinite(length) & (length > 0)
        return ids[ok], m[ok] / length[ok, None]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for qr, br in zip(batch["qb_rows"], batch["bb_rows"]):
                (qi, qm), (bi, bm) = unit(list(qr)), unit(list(br))
                if not len(qi) or not len(bi) or qm.shape[1] != bm.shape[1]:
                    continue
                sim = np.round(qm @ bm.T, 9)
                sim[qi[:, None] == bi[None, :]] = -2.0
                take = min(k, len(bi))
                # ties at the cut go to the smaller id, so the ids are sorted first
                order = np.argsort(bi, kind="stable")
                top = order[np.argsort(-sim[:, order], axis=1, kind="stable")[:, :take]]
                val = np.take_along_axis(sim, top, 1)
                r, c = np.nonzero(val >= max(least, -1.5))
                yield pd.DataFrame({"query_id": qi[r], "base_id": bi[top[r, c]], "cosine": val[r, c]})

    id_type = dict(queries.dtypes)[key]
    pairs = q.select("qb_rows", F.explode(F.sequence(F.lit(0), F.lit(b_blocks - 1))).alias("bb")).join(b, "bb").select("qb_rows", "bb_rows")
    found = pairs.repartition(q_blocks * b_blocks).mapInPandas(run, f"query_id {id_type}, base_id {id_type}, cosine double")
    w = Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "base_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def candidates(source: DataFrame, target: DataFrame, rule: AuditThresholds = AuditThresholds()) -> DataFrame:
    """``source_id, target_id, candidate_cosine, exact`` of window tables with ``window_id, exact_hash, features``."""
    s, t = source.where(F.col("exact_hash").isNotNull()), target.where(F.col("exact_hash").isNotNull())
    same = salted_join(s.select("exact_hash", F.col("window_id").alias("source_id")), t.select("exact_hash", F.col("window_id").alias("target_id")), ["exact_hash"])
    exact = same.select("source_id", "target_id", F.lit(1.0).alias("candidate_cosine"), F.lit(True).alias("exact"))
    found = near_join(target, source, "window_id", "features", rule.candidate_cosine)
    near = top_per_group(found, ["left_id"], [F.col("cosine").desc(), F.col("right_id")], rule.k)
    near = near.select(F.col("right_id").alias("source_id"), F.col("left_id").alias("target_id"), F.col("cosine").alias("candidate_cosine"), F.lit(False).alias("exact"))
    return exact.unionByName(near).groupBy("source_id", "target_id").agg(F.max("candidate_cosine").alias("candidate_cosine"), F.max("exact").alias("exact"))


def verified_by_features(pairs: DataFrame, leads: int = 12) -> DataFrame:
    """``pairs`` (with ``left`` and ``right`` fingerprints) plus ``median_correlation, median_nrmse``, to nine decimals.

    For tables that hold fingerprints but no waveforms: a fingerprint is a
    window's leads in coarse steps, and leads are compared as in a window, at
    lag 0.  Leads that don't move on both sides are left out; without any, and
    for fingerprints that differ in length or aren't finite, both are null.
    """
    keep = [c for c in pairs.columns if c not in ("left", "right")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            correlation, error = [], []
            for a, b in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist()):
                c = e = None
                if a and b and len(a) == len(b) and len(a) % leads == 0 and None not in a and None not in b:
                    x, y = (np.asarray(v, np.float64).reshape(leads, -1) for v in (a, b))
                    if np.isfinite(x).all() and np.isfinite(y).all():
                        x, y = x - x.mean(1, keepdims=True), y - y.mean(1, keepdims=True)
                        size = np.sqrt((x * x).sum(1) * (y * y).sum(1))
                        moves = size > 1e-12
                        if moves.any():
                            each = np.minimum((x * y).sum(1)[moves] / size[moves], 1.0)
                            # of standardised leads the error follows from the correlation
                            c, e = round(float(np.median(each)), 9), round(float(np.median(np.sqrt(2 - 2 * each))), 9)
                correlation.append(c)
                error.append(e)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array(correlation, pa.float64()), pa.array(error, pa.float64())], names=[*keep, "median_correlation", "median_nrmse"])

    kinds = ", ".join(f"{c} {t}" for c, t in pairs.dtypes if c in keep)
    return pairs.mapInArrow(run, f"{kinds}, median_correlation double, median_nrmse double")


def audit_direction(source: DataFrame, target: DataFrame, rule: AuditThresholds = AuditThresholds(), verify=verified_by_features, signal: str = "features") -> DataFrame:
    """One match per target record that source records hold too, exactly or nearly.

    Both tables have ``window_id, dataset, record_id, window_index, exact_hash,
    features``.  Exact candidates need no proof; near ones are verified on the
    two windows' ``signal``: fingerprints with ``verified_by_features``, or
    waveforms with ``signals.verified``.
    """
    found = candidates(source, target, rule)
    name = lambda df, side: df.select(F.col("window_id").alias(f"{side}_id"), *[F.col(c).alias(f"{side}_{c}") for c in ("dataset", "record_id", "window_index")], F.col(signal).alias("left" if side == "source" else "right"))
    pairs = salted_join(salted_join(found, name(source, "source"), ["source_id"]), name(target, "target"), ["target_id"])
    return best_matches(verify(pairs), rule)


def audit(windows: DataFrame, part: str, rule: AuditThresholds = AuditThresholds()) -> DataFrame:
    """``audit_direction`` of all train windows against all test windows, whatever their datasets, in one plan; ``part`` names the split."""
    usable = windows.where(F.col("record_id").isNotNull())
    return audit_direction(usable.where(F.col(part) == "train"), usable.where(F.col(part) == "test"), rule)


def best_matches(verified: DataFrame, rule: AuditThresholds = AuditThresholds()) -> DataFrame:
    """One match per target record: exact before near, then correlation, error and the source's ids."""
    near = (F.col("median_correlation") >= rule.median_correlation) & (F.col("median_nrmse") <= rule.median_nrmse)
    kept = verified.where(F.col("exact") | F.coalesce(near, F.lit(False))).withColumn("match_type", F.when(F.col("exact"), "exact").otherwise("near"))
    order = [F.col("exact").desc(), F.col("median_correlation").desc_nulls_last(), F.col("median_nrmse").asc_nulls_last(), F.col("source_record_id"), F.col("source_window_index"), F.col("target_window_index"), *[F.col(c) for c in ("source_id", "target_id") if c in verified.columns]]
    return first_per_key(kept, ["target_record_id"], order)


def without_overlaps(manifest: DataFrame, matches: DataFrame) -> DataFrame:
    """The listing without the test rows of matched target records, in any spelling of test; other splits stay whole."""
    gone = matches.select(F.col("target_record_id").alias("record_id")).distinct().withColumn("__split", F.lit("test"))
    return manifest.withColumn("__split", split_name(F.col("split"))).join(gone, ["record_id", "__split"], "left_anti").select(*manifest.columns)


def without_plain_overlaps(manifest: DataFrame, matches: DataFrame) -> DataFrame:
    """As ``without_overlaps``, but only rows whose split is exactly ``test``."""
    gone = matches.select(F.col("target_record_id").alias("record_id")).distinct().withColumn("split", F.lit("test"))
    return manifest.join(gone, ["record_id", "split"], "left_anti")


def removal_summary(matches: DataFrame, test_windows: DataFrame) -> DataFrame:
    """Per source and target: exact and near records removed, and their share of the records audited."""
    audited = test_windows.groupBy(F.col("dataset").alias("target_dataset")).agg(F.countDistinct("record_id").alias("audited"))
    per = matches.groupBy("source_dataset", "target_dataset").agg(
        F.countDistinct(F.when(F.col("match_type") == "exact", F.col("target_record_id"))).alias("exact_removed"),
        F.countDistinct(F.when(F.col("match_type") == "near", F.col("target_record_id"))).alias("near_removed"),
        F.countDistinct("target_record_id").alias("removed"),
    )
    return per.join(audited, "target_dataset").withColumn("fraction", F.col("removed") / F.greatest(F.col("audited"), F.lit(1)))
