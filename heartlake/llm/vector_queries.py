"""Problem 3: the most similar windows of every window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..session import table
from .neighbours import nearest, neighbour_pairs

catalog = Catalog()


@catalog.query("p3_found")
def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of windows of which one is among the other's five nearest."""
    return neighbour_pairs(nearest(table(spark, root, "fingerprint_cache")))


@catalog.query("p3_neighbours")
def p3_neighbours(spark: SparkSession, root: str) -> DataFrame:
    """The five nearest windows of each window, with the metadata of both."""
    cache = table(spark, root, "fingerprint_cache")
    meta = cache.select("vec_id", "dataset", "record_id", "split", "window_index")
    other = meta.select(*[F.col(c).alias(f"other_{c.removeprefix('vec_')}") for c in meta.columns])
    return nearest(cache).join(meta, "vec_id").join(other, "other_id").select("vec_id", "rank", "other_id", "cosine", *meta.columns[1:], *other.columns[1:])
