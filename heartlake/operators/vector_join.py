"""Pairs of vectors at or above a cosine, by random signs and exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import salted_join


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Positions and unit vectors of the rows that are finite, not all zero and as long as the first such one."""
    rows = [(i, np.asarray(v, dtype=np.float64)) for i, v in enumerate(column.to_pylist()) if v is not None and len(v) and None not in v]
    rows = [(i, v) for i, v in rows if np.isfinite(v).all() and v.any()]
    rows = [(i, v) for i, v in rows if len(v) == len(rows[0][1])]
    if not rows:
        return np.zeros(0, np.int64), np.zeros((0, 0))
    m = np.stack([v for _, v in rows])
    return np.array([i for i, _ in rows]), m / np.sqrt((m * m).sum(1))[:, None]


def sign_tables(rows: int, least: float, missed: float) -> tuple[int, int]:
    """Signs of a key and number of keys, such that a pair at ``least`` shares no key with chance ``missed``.

    Keys grow with the logarithm of the collection, so that unrelated vectors
    share few.
    """
    bits = min(40, max(12, math.ceil(math.log2(max(rows, 2))) + 4))
    agree = (1 - math.acos(least) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(missed) / math.log(1 - agree))) if agree < 1 else 1


def near_join(left: DataFrame, right: DataFrame, key: str, vector: str, least: float, missed: float = 1e-6, seed: int = 13) -> DataFrame:
    """``left_id, right_id, cosine``: pairs of different ids with cosine ``least`` (positive) or more, rounded to nine decimals.

    Each side is hashed once and only rows that share a key meet; hot keys are
    salted.  A pair at the threshold is missed with chance ``missed``, a closer
    one far less often; every pair is verified in double precision.  Vectors
    that are null, not finite, all zero or of a length of their own match nothing.
    """
    if not 0 < least <= 1:
        raise ValueError("least must lie in (0, 1]")
    bits, tables = sign_tables(left.count() + right.count(), least, missed)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        power, tag = 1 << np.arange(bits, dtype=np.int64), np.arange(tables, dtype=np.int64) << bits
        for batch in batches:
            at, u = _matrix(batch.column(1))
            if not len(at):
                continue
            dim = u.shape[1]
            if dim not in planes:
                planes[dim] = np.random.default_rng([seed, dim]).standard_normal((dim, bits * tables))
            found = (u @ planes[dim] > 0).reshape(len(at), tables, bits) @ power + tag
            ids = np.repeat(at, tables)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids)), pa.array(found.ravel())], names=["id", "key"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.array(batch.column(i).to_pylist(), dtype=np.float64) if _even(batch.column(2), batch.column(3)) else None for i in (2, 3))
            if a is None:
                a, b, some = _pairwise(batch)
            else:
                some = np.arange(batch.num_rows)
            cos = np.round((a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1)), 9) if len(some) else np.zeros(0)
            near = cos >= least
            rows = pa.array(some[near])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(cos[near])], names=["left_id", "right_id", "cosine"])

    kind = dict(left.dtypes)[key]
    a, b = (df.select(F.col(key).alias("id"), F.col(vector).alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull()) for df in (left, right))
    ka, kb = (df.mapInArrow(keys, f"id {kind}, key bigint") for df in (a, b))
    pairs = salted_join(ka.withColumnRenamed("id", "left_id"), kb.withColumnRenamed("id", "right_id"), ["key"]).where(F.col("left_id") != F.col("right_id")).select("left_id", "right_id").distinct()
    both = salted_join(salted_join(pairs, a.toDF("left_id", "va"), ["left_id"]), b.toDF("right_id", "vb"), ["right_id"])
    return both.select("left_id", "right_id", "va", "vb").mapInArrow(verify, f"left_id {kind}, right_id {kind}, cosine double")


def _even(a: pa.Array, b: pa.Array) -> bool:
    """Whether all lists of both columns have one length."""
    sizes = {len(x) for c in (a, b) for x in c}
    return len(sizes) == 1


def _pairwise(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of equal length, filled up with zeros, which change no cosine."""
    rows = [(i, x, y) for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())) if len(x) == len(y)]
    size = max((len(x) for _, x, _ in rows), default=0)
    pad = lambda v: np.pad(np.asarray(v, np.float64), (0, size - len(v)))
    return np.array([pad(x) for _, x, _ in rows]), np.array([pad(y) for _, _, y in rows]), np.array([i for i, _, _ in rows], np.int64)
