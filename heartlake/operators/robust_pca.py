"""Robust principal components on blocks of profile rows.

A block is a matrix of profile rows of one source; it is separated into a
low-rank part, which is the source's normal behaviour, and a sparse part.  The
low-rank part is held to a box of plausible values, so that a block full of
spikes can't be taken for normal.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def separate(matrix: np.ndarray, known: np.ndarray, box: float, iterations: int = 12) -> np.ndarray:
    """The low-rank part of ``matrix``, within ``[-box, box]``.

    Principal component pursuit by alternating projections with growing
    penalty.  Cells that are not ``known`` follow the low-rank part.
    """
    rows, cols = matrix.shape
    cap = 50.0 * box
    m = np.clip(np.where(known, matrix, 0.0), -cap, cap)
    weight = 1.0 / np.sqrt(max(rows, cols))
    norm = max(np.linalg.norm(m, 2), 1e-9)
    mu, dual = 1.25 / norm, m / max(norm, np.abs(m).max() / weight)
    low, sparse = np.zeros_like(m), np.zeros_like(m)
    for _ in range(iterations):
        u, s, v = np.linalg.svd(m - sparse + dual / mu, full_matrices=False)
        low = np.clip((u * np.maximum(s - 1.0 / mu, 0.0)) @ v, -box, box)
        m = np.where(known, m, low)
        left = m - low + dual / mu
        sparse = np.sign(left) * np.maximum(np.abs(left) - weight / mu, 0.0)
        gap = m - low - sparse
        dual = dual + mu * gap
        mu = min(mu * 1.6, 1e7)
        if np.linalg.norm(gap) < 1e-6 * norm:
            break
    return low


def with_residuals(df: DataFrame, source: str, block: str, row: str, column: str, value: str, columns: int, box: float) -> DataFrame:
    """The rows of ``df`` with ``usual``, the low-rank part of their ``value``, and ``residual``, what is left of it.

    Each block, the rows of one ``source`` and ``block`` number, is a matrix of
    profile rows (``row``) and ``column``s 0 to ``columns`` - 1; ``value`` is the
    deviation from the source's median in units of its spread.  The caller
    numbers blocks so that each fits a task.  A place that several rows claim
    holds the first by value; each row has the residual of its own value.  Rows
    without a finite value have nulls and stand in no matrix.
    """
    names = df.columns
    fields = [f.name + " " + f.dataType.simpleString() for f in df.schema.fields]

    def residuals(part: pd.DataFrame) -> pd.DataFrame:
        val = part[value].to_numpy(dtype=float)
        fine = np.isfinite(val)
        usual = np.full(len(part), np.nan)
        if fine.any():
            ids, firsts = pd.factorize(part[row].to_numpy()[fine])
            col, known_val = part[column].to_numpy()[fine].astype(int), val[fine]
            m, known = np.zeros((len(firsts), columns)), np.zeros((len(firsts), columns), dtype=bool)
            order = np.argsort(-known_val, kind="stable")  # the smallest value is written last
            m[ids[order], col[order]] = known_val[order]
            known[ids, col] = True
            usual[fine] = separate(m, known, box)[ids, col]
        out = part[names].copy()
        out["usual"], out["residual"] = usual, val - usual
        return out

    return df.groupBy(source, block).applyInPandas(residuals, ", ".join([*fields, "usual double", "residual double"]))
