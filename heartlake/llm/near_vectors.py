"""All pairs of vectors at or above a high cosine, by sign hashes and exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import salted_join
from ..session import cut
from .vectors import cosines, matrix, unit


@dataclass(frozen=True)
class SignHashes:
    """Parameters of the join.

    At the threshold of 0.99 (8.1 degrees) one sign agrees with chance 0.955.
    ``bits`` signs make the key of a table; their number grows with the
    logarithm of the collection, so that buckets of unrelated vectors don't
    grow.  The number of tables follows from ``missed``, the chance that a pair
    at the threshold shares no key; closer pairs are missed far more seldom.
    Half of that chance is left for buckets that are parted again.
    The sketch of 512 signs, of which at most ``apart`` may differ (23 do on
    average, with a deviation of 4.7), loses less than one pair in ten
    millions.  A bucket of more than ``hot`` vectors is parted again, by tables
    of ``fine_bits`` signs, as many as that chance needs; what then still shares
    a bucket with very many is spread over tasks.  ``broadcast_ids`` bounds
    the ids (8 bytes each) sent to every task to fetch their vectors; beyond
    it both sides are shuffled.
    """

    dim: int = 768
    least: float = 0.99
    missed: float = 3e-6
    apart: int = 49
    hot: int = 1000
    fine_bits: int = 16
    broadcast_ids: int = 500_000
    seed: int = 11

    def _tables(self, bits: int) -> int:
        agree = (1 - math.acos(self.least) / math.pi) ** bits
        return math.ceil(math.log(self.missed / 2) / math.log(1 - agree))

    @property
    def fine_tables(self) -> int:
        return self._tables(self.fine_bits)

    def shape(self, rows: int) -> tuple[int, int]:
        """Bits and tables for a collection of ``rows`` vectors."""
        bits = min(40, max(16, math.ceil(math.log2(max(rows, 2))) + 7))
        return bits, self._tables(bits)


_WORDS = 8  # of the sketch


def _hash(rule: SignHashes, rows: int):
    bits, tables = rule.shape(rows)

    def lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel(), kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(rule.seed)
        finer = rng.standard_normal((rule.dim, rule.fine_bits * rule.fine_tables)).astype(np.float32)
        drawn = rng.standard_normal((rule.dim, 64 * _WORDS)).astype(np.float32)
        planes = rng.standard_normal((rule.dim, bits * tables)).astype(np.float32)
        power, fine_power = 1 << np.arange(bits, dtype=np.int64), 1 << np.arange(rule.fine_bits, dtype=np.int64)
        tag = np.arange(tables, dtype=np.int64) << bits
        for batch in batches:
            at, m = matrix(batch.column(2), rule.dim)
            if not len(at):
                continue
            u = unit(m)
            keys = (u @ planes > 0).reshape(len(at), tables, bits) @ power + tag
            fine = (u @ finer > 0).reshape(len(at), rule.fine_tables, rule.fine_bits) @ fine_power
            sketch = np.packbits(u @ drawn > 0, axis=1).view(">i8").astype(np.int64)
            content = [xxhash.xxh3_128_digest(row.tobytes()) for row in m]
            rows_at = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows_at).cast(pa.int64()), batch.column(1).take(rows_at), pa.array(content, pa.binary()), lists(keys, pa.int64()), lists(fine, pa.int32()), lists(sketch, pa.int64())],
                names=["id", "owner", "content", "keys", "fine", "sketch"],
            )

    return run


def _verify(rule: SignHashes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, m = matrix(batch.column(2), rule.dim)
            b, n = matrix(batch.column(3), rule.dim)
            cos = cosines(m, n)
            near = pa.array(np.nonzero(cos >= rule.least)[0])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(near), batch.column(1).take(near), pa.array(cos[cos >= rule.least])], names=["id_a", "id_b", "cosine"])

    return run


def _pairs(rows: DataFrame, keys: list[str], spread: bool = False) -> DataFrame:
    a = rows.select(*keys, F.col("id").alias("id_a"))
    b = rows.select(*keys, F.col("id").alias("id_b"))
    return (salted_join(a, b, keys, 2_000) if spread else a.join(b, keys)).where(F.col("id_a") < F.col("id_b")).select("id_a", "id_b")


def near_pairs(df: DataFrame, id_col: str, owner: str, features: str, rule: SignHashes = SignHashes()) -> tuple[DataFrame, DataFrame]:
    """Pairs of near vectors and who owns them.

    The first table is ``id_a, id_b, cosine``, smaller id first: all pairs of
    different vectors with cosine ``least`` or more, in double precision and
    rounded to six decimals, where exact copies count as one vector, named by
    its smallest id.  Pairs that link no two owners, as both vectors belong to
    one and the same owner alone, are left out.  The second is ``id, owner``: each vector and every owner
    of a copy of it, once.  Vectors that aren't usable are in neither.
    """
    base = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(owner).alias("owner"), F.col(features).alias("features"))
    hashed = cut(base.mapInArrow(_hash(rule, base.count()), "id bigint, owner string, content binary, keys array<bigint>, fine array<int>, sketch array<bigint>"))
    sole = F.when(F.min("owner") == F.max("owner"), F.min("owner"))
    first = hashed.groupBy("content").agg(F.min("id").alias("rep"), sole.alias("sole"))
    owners = salted_join(hashed.select("content", "owner").distinct(), first, ["content"]).select(F.col("rep").alias("id"), "owner")
    one = cut(hashed.join(first.select(F.col("rep").alias("id"), "sole"), "id").select("id", "keys", "fine", "sketch", "sole"))

    rows = one.select("id", F.explode("keys").alias("key"))
    hot = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rule.hot).select("key")
    hot = cut(hot)
    if hot.isEmpty():
        pairs = _pairs(rows, ["key"])
    else:
        finer = rows.join(hot, "key", "left_semi").join(one.select("id", "fine"), "id").select("id", "key", F.posexplode("fine").alias("no", "fine"))
        pairs = _pairs(rows.join(hot, "key", "left_anti"), ["key"]).unionByName(_pairs(finer, ["key", "no", "fine"], spread=True))
    differ = F.lit(0)
    for k in range(_WORDS):
        differ = differ + F.bit_count(F.col("sa")[k].bitwiseXOR(F.col("sb")[k]))
    sketch = one.select("id", "sketch", "sole")
    links_two = ~F.coalesce(F.col("oa") == F.col("ob"), F.lit(False))
    close = cut(
        pairs.distinct()
        .join(sketch.select(F.col("id").alias("id_a"), F.col("sketch").alias("sa"), F.col("sole").alias("oa")), "id_a")
        .join(sketch.select(F.col("id").alias("id_b"), F.col("sketch").alias("sb"), F.col("sole").alias("ob")), "id_b")
        .where(links_two & (differ <= rule.apart))
        .select("id_a", "id_b")
    )
    wanted = close.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct()
    if 2 * close.count() <= rule.broadcast_ids:
        wanted = F.broadcast(wanted)
    fetched = base.join(wanted, "id", "left_semi").select("id", "features")
    both = (
        close.join(fetched.select(F.col("id").alias("id_a"), F.col("features").alias("fa")), "id_a")
        .join(fetched.select(F.col("id").alias("id_b"), F.col("features").alias("fb")), "id_b")
        .select("id_a", "id_b", "fa", "fb")
    )
    return both.mapInArrow(_verify(rule), "id_a bigint, id_b bigint, cosine double"), owners
