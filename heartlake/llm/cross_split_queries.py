"""Problem 2: recordings in both the training and an evaluation split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..functions.listings import dataset_name
from ..session import table
from .cross_split import coverage, listings, overlaps

catalog = Catalog()

_SPLIT = "CASE WHEN lower(trim(split, E' \\t\\r\\n')) IN ('train', 'training') THEN 1 WHEN lower(trim(split, E' \\t\\r\\n')) IN ('validation', 'val', 'valid', 'dev', 'test', 'testing') THEN 0 END"
_FILE = r"""nullif(ltrim(regexp_replace(regexp_replace(regexp_replace(lower(trim(signal_path, E' \t\r\n')), '[\\/]+', '/', 'g'), '(^|/)(\./)+', '\1', 'g'), '[^/]+/\.\./', '', 'g'), '/'), '')"""
_PAIRS = f"""
WITH m AS (SELECT manifest_id AS id, nullif(trim(record_id), '') AS record, {_FILE} AS file, {_SPLIT} AS train FROM week2_manifest),
t AS (SELECT * FROM m WHERE train = 1), e AS (SELECT * FROM m WHERE train = 0),
v AS (SELECT trim(record_id) AS record, CAST(features AS DOUBLE[]) AS f FROM fingerprint_cache
      WHERE record_id IS NOT NULL AND len(features) = 768 AND len(list_filter(features, lambda x: isfinite(x))) = 768 AND len(list_filter(features, lambda x: x <> 0)) > 0),
u AS (SELECT DISTINCT record, f, sqrt(list_dot_product(f, f)) AS n FROM v),
near AS (SELECT DISTINCT a.record AS ra, b.record AS rb FROM u a JOIN u b ON a.record <> b.record WHERE round(list_dot_product(a.f, b.f) / (a.n * b.n), 6) >= 0.99),
p AS (
  SELECT t.id AS a, e.id AS b FROM t JOIN e ON t.record = e.record
  UNION SELECT t.id, e.id FROM t JOIN e ON t.file = e.file
  UNION SELECT t.id, e.id FROM near JOIN t ON t.record = ra JOIN e ON e.record = rb)
SELECT DISTINCT least(a, b) AS manifest_id_a, greatest(a, b) AS manifest_id_b FROM p"""


@catalog.query("p2_found", _PAIRS)
def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of listings, one in train and one in validation or test, of the same recording."""
    both = overlaps(table(spark, root, "week2_manifest"), table(spark, root, "fingerprint_cache"))
    return both.select(F.least("train_id", "eval_id").alias("manifest_id_a"), F.greatest("train_id", "eval_id").alias("manifest_id_b")).distinct()


_NAME = "nullif(lower(regexp_replace(dataset, '[^\\p{L}\\p{N}]', '', 'g')), '')"
_REPORT = (
    _PAIRS[: _PAIRS.index("p AS (")]
    + f"""x AS (
  SELECT t.id AS a, e.id AS b, 'record' AS reason FROM t JOIN e ON t.record = e.record
  UNION SELECT t.id, e.id, 'file' FROM t JOIN e ON t.file = e.file
  UNION SELECT t.id, e.id, 'window' FROM near JOIN t ON t.record = ra JOIN e ON e.record = rb),
g AS (SELECT a, b, bool_or(reason = 'record') AS r, bool_or(reason = 'file') AS f, bool_or(reason = 'window') AS w FROM x GROUP BY a, b),
h AS (SELECT manifest_id AS id, CASE WHEN lower(trim(split, E' \\t\\r\\n')) IN ('test', 'testing') THEN 'test' ELSE 'validation' END AS split, {_NAME} AS dataset FROM week2_manifest)
SELECT split, dataset, count(*) AS pairs, count(DISTINCT b) AS eval_listings, count(*) FILTER (r) AS by_record, count(*) FILTER (f) AS by_file, count(*) FILTER (w) AS by_window
FROM g JOIN h ON h.id = b GROUP BY ALL"""
)


@catalog.query("p2_report", _REPORT)
def p2_report(spark: SparkSession, root: str) -> DataFrame:
    """Overlapping pairs and evaluation listings per split and dataset of the evaluation listing."""
    manifest = table(spark, root, "week2_manifest")
    both = overlaps(manifest, table(spark, root, "fingerprint_cache")).groupBy("train_id", "eval_id").agg(F.collect_set("reason").alias("reasons"))
    held = listings(manifest).select(F.col("id").alias("eval_id"), "split", dataset_name(F.col("dataset")).alias("dataset"))
    counts = [F.count_if(F.array_contains("reasons", r)).alias(f"by_{r}") for r in ("record", "file", "window")]
    return both.join(held, "eval_id").groupBy("split", "dataset").agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("eval_id").alias("eval_listings"), *counts)


@catalog.query("p2_coverage")
def p2_coverage(spark: SparkSession, root: str) -> DataFrame:
    """How much of each evaluation listing's text stands in training listings."""
    return coverage(table(spark, root, "week2_manifest"))
