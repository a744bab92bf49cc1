"""Fixed-length vectors between Arrow, NumPy and shuffles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the usable vectors and their float32 matrix.

    Usable vectors have ``dim`` finite numbers, not all zero.  Null, short and
    long lists and lists with a null inside aren't usable.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(0, np.int64), np.zeros((0, dim), np.float32)
    good = np.nonzero(np.asarray(pc.fill_null(column.value_lengths(), -1)) == dim)[0]
    start = np.asarray(column.offsets)[:-1][good].astype(np.int64)
    values = column.values
    if values.null_count:
        values = pc.fill_null(values, float("nan"))
    flat = values.to_numpy(zero_copy_only=False)
    if len(good) == len(column):
        m = flat[start[0] : start[0] + len(good) * dim].reshape(len(good), dim)
    else:
        m = flat[start[:, None] + np.arange(dim)]
    with np.errstate(over="ignore"):
        m = m.astype(np.float32, copy=False)
    fine = np.isfinite(m).all(1) & (m != 0).any(1)
    return good[fine], np.ascontiguousarray(m[fine])


def unit(m: np.ndarray) -> np.ndarray:
    """Rows divided by their length, in float32; lengths are taken in double precision."""
    length = np.sqrt(np.einsum("ij,ij->i", m, m, dtype=np.float64))
    return (m / length[:, None]).astype(np.float32)


def pack(m: np.ndarray) -> list[bytes]:
    """Each row as bytes, without loss: equal-weight bytes side by side, then compressed."""
    planes = np.ascontiguousarray(m.astype("<f4", copy=False).view(np.uint8).reshape(len(m), m.shape[1], 4).transpose(0, 2, 1))
    press = zstandard.ZstdCompressor(level=1)
    return [press.compress(p) for p in planes]


def unpack(rows: list[bytes], dim: int) -> np.ndarray:
    """The matrix that ``pack`` was given."""
    if not rows:
        return np.zeros((0, dim), np.float32)
    press = zstandard.ZstdDecompressor()
    flat = np.frombuffer(b"".join(press.decompress(r) for r in rows), np.uint8)
    return np.ascontiguousarray(flat.reshape(len(rows), 4, dim).transpose(0, 2, 1)).view("<f4").reshape(len(rows), dim)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row cosine in double precision, to six decimals."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    dot = np.einsum("ij,ij->i", a, b)
    return np.round(dot / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b)), 6)
