"""Relational queries on the star schema and the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coerce import number, ratio
from ..functions.listings import split_name
from ..operators.metrics import sem
from ..operators.quantiles import exact_quantiles
from ..operators.ranking import first_per_key, ranked, sample_rows, share_of_total, top_per_group
from ..operators.reshape import drop_empty_rows, union_by_name, with_columns_of
from ..plans import overlap
from ..session import cut, table
from ..sources.tables import row_slice
from . import Catalog
from .base import r6, rounded

catalog = Catalog()


@catalog.query("filter_project", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45 AND l_linestatus <> 'O'")
def filter_project(spark: SparkSession, root: str) -> DataFrame:
    """A filter that reaches the scan."""
    li = table(spark, root, "lineitem").where((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 45) & (F.col("l_linestatus") != "O"))
    return li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")


@catalog.query("pricing_summary", f"SELECT l_returnflag, l_linestatus, count(*) AS lines, CAST(sum(l_quantity) AS BIGINT) AS quantity, {r6('avg(l_quantity)')} AS mean_quantity, {r6('stddev_samp(l_quantity)')} AS sd_quantity, min(l_discount) AS min_discount, max(l_discount) AS max_discount, count(*) FILTER (l_discount > 0.05) AS discounted FROM lineitem GROUP BY ALL")
def pricing_summary(spark: SparkSession, root: str) -> DataFrame:
    """Named aggregates per group."""
    q = F.col("l_quantity")
    return rounded(table(spark, root, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("lines"), F.sum(q).cast("bigint").alias("quantity"), F.avg(q).alias("mean_quantity"), F.stddev_samp(q).alias("sd_quantity"), F.min("l_discount").alias("min_discount"), F.max("l_discount").alias("max_discount"), F.count_if(F.col("l_discount") > 0.05).alias("discounted")))


@catalog.query("semi_filter", "SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def semi_filter(spark: SparkSession, root: str) -> DataFrame:
    """Customers with an urgent order."""
    urgent = table(spark, root, "orders").where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, root, "customer").join(urgent, "c_custkey", "left_semi").select("c_custkey", "c_mktsegment")


@catalog.query("anti_filter", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_filter(spark: SparkSession, root: str) -> DataFrame:
    """Customers without orders."""
    return table(spark, root, "customer").join(table(spark, root, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@catalog.query("left_join_zero", "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def left_join_zero(spark: SparkSession, root: str) -> DataFrame:
    """Orders of each customer, none counted as zero; orders are counted before the join."""
    per = table(spark, root, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders"))
    return table(spark, root, "customer").select("c_custkey").join(per, "c_custkey", "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"))


@catalog.query("rank_min", "SELECT o_orderkey, o_orderpriority, CAST(rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC) AS INT) AS rank FROM orders")
def rank_min_query(spark: SparkSession, root: str) -> DataFrame:
    """Orders by price within their priority."""
    orders = table(spark, root, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return ranked(orders, ["o_orderpriority"], "o_totalprice").select("o_orderkey", "o_orderpriority", F.col("rank").cast("int").alias("rank"))


@catalog.query("rank_average", "SELECT c_custkey, c_mktsegment, CAST(rank() OVER (PARTITION BY c_mktsegment ORDER BY floor(c_acctbal / 500) DESC) + (count(*) OVER (PARTITION BY c_mktsegment, floor(c_acctbal / 500)) - 1) / 2.0 AS DOUBLE) AS rank FROM customer")
def rank_average_query(spark: SparkSession, root: str) -> DataFrame:
    """Customers by balance class, equals sharing a rank."""
    c = table(spark, root, "customer").select("c_custkey", "c_mktsegment", F.floor(F.col("c_acctbal") / 500).alias("step"))
    return ranked(c, ["c_mktsegment"], "step", average=True).select("c_custkey", "c_mktsegment", "rank")


@catalog.query("top_n_per_group", "SELECT o_orderpriority, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS no FROM orders) WHERE no <= 5")
def top_n_per_group(spark: SparkSession, root: str) -> DataFrame:
    """The five dearest orders of each priority."""
    return top_per_group(table(spark, root, "orders"), ["o_orderpriority"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 5).select("o_orderpriority", "o_orderkey", "o_totalprice")


@catalog.query("first_per_key", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus, o_totalprice DESC, o_orderdate DESC, o_orderkey) AS no FROM orders) WHERE no = 1")
def first_per_key_query(spark: SparkSession, root: str) -> DataFrame:
    """One order per customer in an order of mixed directions."""
    order = [F.col("o_orderstatus"), F.col("o_totalprice").desc(), F.col("o_orderdate").desc(), F.col("o_orderkey")]
    return first_per_key(table(spark, root, "orders"), ["o_custkey"], order).select("o_custkey", "o_orderkey")


@catalog.query("top_k_by_penalty", "SELECT p_partkey, p_size FROM part ORDER BY (p_size - 25) * (p_size - 25), md5('42_' || p_partkey) LIMIT 50")
def top_k_by_penalty(spark: SparkSession, root: str) -> DataFrame:
    """The fifty parts of least penalty, ties by digest."""
    p = table(spark, root, "part")
    return p.orderBy((F.col("p_size") - 25) * (F.col("p_size") - 25), F.md5(F.concat(F.lit("42_"), F.col("p_partkey").cast("string")))).limit(50).select("p_partkey", "p_size")


@catalog.query("seeded_sample", "SELECT p_partkey FROM part ORDER BY md5('42_' || p_partkey), p_partkey LIMIT 20")
def seeded_sample(spark: SparkSession, root: str) -> DataFrame:
    """Twenty random parts, the same every time."""
    return sample_rows(table(spark, root, "part"), "p_partkey", 20).select("p_partkey")


@catalog.query("row_slice", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 50")
def row_slice_query(spark: SparkSession, root: str) -> DataFrame:
    """A stretch of the orders in order of their keys."""
    return row_slice(table(spark, root, "orders").select("o_orderkey"), ["o_orderkey"], 50, 100)


@catalog.query("share_of_total", f"WITH a AS (SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ALL) SELECT c_mktsegment, c_nationkey, n, {r6('n / sum(n) OVER (PARTITION BY c_mktsegment)')} AS share FROM a")
def share_of_total_query(spark: SparkSession, root: str) -> DataFrame:
    """Nations' shares of each segment."""
    a = table(spark, root, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return rounded(a.withColumn("share", share_of_total(["c_mktsegment"], "n")))


@catalog.query("quantiles", f"SELECT event_type, {r6('quantile_cont(value, 0.025)')} AS low, {r6('quantile_cont(value, 0.5)')} AS median, {r6('quantile_cont(value, 0.975)')} AS high, count(*) AS n_values FROM events GROUP BY event_type")
def quantiles(spark: SparkSession, root: str) -> DataFrame:
    """Exact quantiles per event type."""
    return rounded(exact_quantiles(table(spark, root, "events"), ["event_type"], "value", {"low": 0.025, "median": 0.5, "high": 0.975}))


@catalog.query("mean_sem", f"SELECT event_type, count(*) AS n, {r6('avg(value)')} AS mean, {r6('CASE WHEN count(*) > 1 THEN stddev_samp(value) / sqrt(count(*)) END')} AS sem FROM events GROUP BY event_type")
def mean_sem(spark: SparkSession, root: str) -> DataFrame:
    """Means with their standard errors."""
    return rounded(table(spark, root, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), sem("value").alias("sem")))


@catalog.query("value_counts", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def value_counts(spark: SparkSession, root: str) -> DataFrame:
    """Rows and distinct users per value."""
    return table(spark, root, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


@catalog.query("numeric_coercion", "SELECT event_id, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k FROM events")
def numeric_coercion(spark: SparkSession, root: str) -> DataFrame:
    """Numbers taken from text, null where there are none."""
    return table(spark, root, "events").select("event_id", number(F.regexp_extract("props", "([0-9]+)", 1)).alias("k"))


@catalog.query("guarded_ratio", f"WITH a AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS b, count(*) FILTER (event_type = 'refund') AS r FROM events GROUP BY user_id) SELECT user_id, {r6('b / nullif(r, 0)')} AS ratio FROM a")
def guarded_ratio(spark: SparkSession, root: str) -> DataFrame:
    """A ratio that is null where its divisor is zero."""
    a = table(spark, root, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("b"), F.count_if(F.col("event_type") == "refund").alias("r"))
    return rounded(a.select("user_id", ratio(F.col("b"), F.col("r")).alias("ratio")))


@catalog.query("union_by_name", "SELECT 'customer' AS kind, c_custkey AS id, c_mktsegment AS segment, NULL AS balance FROM customer UNION ALL SELECT 'supplier', s_suppkey, NULL, s_acctbal FROM supplier")
def union_by_name_query(spark: SparkSession, root: str) -> DataFrame:
    """Two tables of different columns as one."""
    c = table(spark, root, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, root, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return with_columns_of(union_by_name({"customer": c, "supplier": s}, "kind"), {"kind": "string", "id": "bigint", "segment": "string", "balance": "double"})


@catalog.query("events_wide", "SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'purchase') AS purchase FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY user_id")
def events_wide(spark: SparkSession, root: str) -> DataFrame:
    """Events of each user, types as columns."""
    kinds = ["click", "view", "purchase"]
    wide = table(spark, root, "events").where(F.col("event_type").isin(*kinds)).groupBy("user_id").pivot("event_type", kinds).agg(F.count(F.lit(1)))
    return drop_empty_rows(wide, kinds).na.fill(0, kinds)


@catalog.query("ordered_pairs", "SELECT s.r_name AS source, t.r_name AS target FROM region s JOIN region t ON s.r_name <> t.r_name")
def ordered_pairs_query(spark: SparkSession, root: str) -> DataFrame:
    """Every region with every other."""
    from ..plans.shifts import ordered_pairs

    return ordered_pairs(table(spark, root, "region"), "r_name").select(F.col("s.r_name").alias("source"), F.col("t.r_name").alias("target"))


_COS = "list_dot_product(q.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))"
_TOPK = f"""WITH c AS (SELECT q.vec_id AS query_id, b.vec_id AS base_id, {_COS} AS cosine FROM embeddings q JOIN embeddings b ON q.vec_id <> b.vec_id WHERE q.vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 9) DESC, base_id) AS rank FROM c)"""


@catalog.query("cosine_topk", f"{_TOPK} SELECT query_id, base_id, {r6('cosine')} AS cosine, CAST(rank AS INT) AS rank FROM k WHERE rank <= 5")
def cosine_topk(spark: SparkSession, root: str) -> DataFrame:
    """Exact nearest vectors of every twentieth vector."""
    e = table(spark, root, "embeddings").select("vec_id", "embedding")
    return rounded(overlap.cosine_top_k(e.where(F.col("vec_id") % 20 == 0), e, "vec_id", "embedding"))


@catalog.query("near_neighbours", f"{_TOPK} SELECT query_id, base_id, {r6('cosine')} AS cosine FROM k WHERE rank <= 5 AND round(cosine, 9) >= 0.3")
def near_neighbours(spark: SparkSession, root: str) -> DataFrame:
    """Those of them above a cosine."""
    e = table(spark, root, "embeddings").select("vec_id", "embedding")
    return rounded(overlap.cosine_top_k(e.where(F.col("vec_id") % 20 == 0), e, "vec_id", "embedding", least=0.3).drop("rank"))


_HASH = """WITH w AS (SELECT vec_id, dataset, record_id, CASE WHEN lower(trim(split)) = 'train' THEN 'train' WHEN lower(trim(split)) = 'test' THEN 'test' END AS part, exact_hash FROM fingerprint_cache WHERE exact_hash IS NOT NULL)"""


@catalog.query("exact_window_matches", f"{_HASH} SELECT s.record_id AS source_record_id, t.record_id AS target_record_id, count(*) AS windows FROM w s JOIN w t USING (exact_hash) WHERE s.part = 'train' AND t.part = 'test' GROUP BY ALL")
def exact_window_matches(spark: SparkSession, root: str) -> DataFrame:
    """Records of train and test with windows of one hash."""
    part = F.lower(F.trim("split"))
    w = table(spark, root, "fingerprint_cache").where(F.col("exact_hash").isNotNull()).select("record_id", part.alias("part"), "exact_hash")
    s = w.where(F.col("part") == "train").select("exact_hash", F.col("record_id").alias("source_record_id"))
    t = w.where(F.col("part") == "test").select("exact_hash", F.col("record_id").alias("target_record_id"))
    return s.join(t, "exact_hash").groupBy("source_record_id", "target_record_id").agg(F.count(F.lit(1)).alias("windows"))


_MATCHED = _HASH + """, m AS (SELECT DISTINCT t.dataset AS target_dataset, s.dataset AS source_dataset, t.record_id FROM w s JOIN w t USING (exact_hash) WHERE s.part = 'train' AND t.part = 'test')"""

#: The whole audit: exact and near candidates, verified on fingerprints of 12 leads in 64 steps, the best match of each test record.
_AUDIT = """WITH w AS (
  SELECT vec_id, dataset, record_id, window_index, exact_hash, CASE WHEN lower(trim(split, E' \\t\\r\\n')) IN ('train', 'training') THEN 'train' WHEN lower(trim(split, E' \\t\\r\\n')) IN ('test', 'testing') THEN 'test' END AS part,
         CASE WHEN len(features) = 768 AND len(list_filter(features, lambda x: isfinite(x))) = 768 AND len(list_filter(features, lambda x: x <> 0)) > 0 THEN CAST(features AS DOUBLE[]) END AS f
  FROM fingerprint_cache WHERE record_id IS NOT NULL),
s AS (SELECT * FROM w WHERE part = 'train'), t AS (SELECT * FROM w WHERE part = 'test'),
cosines AS (
  SELECT t.vec_id AS tid, s.vec_id AS sid, round(list_dot_product(s.f, t.f) / sqrt(list_dot_product(s.f, s.f) * list_dot_product(t.f, t.f)), 9) AS cosine
  FROM t JOIN s ON s.f IS NOT NULL AND t.f IS NOT NULL AND s.vec_id <> t.vec_id),
near AS (SELECT tid, sid FROM (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY cosine DESC, sid) AS no FROM cosines WHERE cosine >= 0.97) WHERE no <= 5),
c AS (
  SELECT tid, sid, max(exact) AS exact FROM (SELECT tid, sid, 0 AS exact FROM near UNION ALL SELECT t.vec_id, s.vec_id, 1 FROM s JOIN t USING (exact_hash)) GROUP BY ALL),
leads AS (
  SELECT tid, sid, exact, lead, list_slice(s.f, 64 * lead + 1, 64 * lead + 64) AS x, list_slice(t.f, 64 * lead + 1, 64 * lead + 64) AS y
  FROM c JOIN s ON s.vec_id = sid JOIN t ON t.vec_id = tid, range(0, 12) r(lead)),
centred AS (SELECT tid, sid, exact, lead, list_transform(x, lambda v: v - list_avg(x)) AS x, list_transform(y, lambda v: v - list_avg(y)) AS y FROM leads),
corr AS (
  SELECT tid, sid, exact, CASE WHEN sqrt(list_dot_product(x, x) * list_dot_product(y, y)) > 1e-12 THEN least(list_dot_product(x, y) / sqrt(list_dot_product(x, x) * list_dot_product(y, y)), 1.0) END AS r FROM centred),
v AS (SELECT tid, sid, exact, round(median(r), 9) AS corr, round(median(sqrt(2 - 2 * r)), 9) AS nrmse FROM corr GROUP BY ALL),
kept AS (
  SELECT v.*, s.dataset AS source_dataset, t.dataset AS target_dataset, s.record_id AS source_record_id, t.record_id AS target_record_id,
         row_number() OVER (PARTITION BY t.record_id ORDER BY exact DESC, corr DESC NULLS LAST, nrmse ASC NULLS LAST, s.record_id, s.window_index, t.window_index, sid, tid) AS no
  FROM v JOIN s ON s.vec_id = sid JOIN t ON t.vec_id = tid WHERE exact = 1 OR (corr >= 0.995 AND nrmse <= 0.15)),
best AS (SELECT *, CASE WHEN exact = 1 THEN 'exact' ELSE 'near' END AS match_type FROM kept WHERE no = 1)"""


def _windows(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "fingerprint_cache").select(F.col("vec_id").alias("window_id"), "dataset", "record_id", "window_index", split_name(F.col("split")).alias("part"), "exact_hash", "features")


@catalog.query("audit_matches", f"{_AUDIT} SELECT target_record_id, source_record_id, match_type, {r6('corr')} AS median_correlation FROM best")
def audit_matches(spark: SparkSession, root: str) -> DataFrame:
    """The best train match of each test record that has one, exact or near."""
    return rounded(overlap.audit(_windows(spark, root), "part").select("target_record_id", "source_record_id", "match_type", "median_correlation"))


@catalog.query("overlap_removal_summary", f"""{_AUDIT}, a AS (SELECT dataset AS target_dataset, count(DISTINCT record_id) AS audited FROM t GROUP BY dataset)
SELECT source_dataset, target_dataset, count(DISTINCT target_record_id) FILTER (match_type = 'exact') AS exact_removed, count(DISTINCT target_record_id) FILTER (match_type = 'near') AS near_removed,
  count(DISTINCT target_record_id) AS removed, max(audited) AS audited, {r6('count(DISTINCT target_record_id) / max(audited)')} AS fraction FROM best JOIN a USING (target_dataset) GROUP BY ALL""")
def overlap_removal_summary(spark: SparkSession, root: str) -> DataFrame:
    """Test records that exact and near matches would remove, per pair of datasets."""
    w = cut(_windows(spark, root))
    return rounded(overlap.removal_summary(overlap.audit(w, "part"), w.where((F.col("part") == "test") & F.col("record_id").isNotNull())))


@catalog.query("filtered_listing", f"{_MATCHED} SELECT split, count(*) AS rows FROM week2_manifest x WHERE NOT (split = 'test' AND EXISTS (SELECT 1 FROM m WHERE m.record_id = x.record_id)) OR split IS NULL GROUP BY split")
def filtered_listing(spark: SparkSession, root: str) -> DataFrame:
    """Rows per split without those of matched records whose split is exactly ``test``, as its SQL has it. ``clean_listing`` takes every spelling."""
    part = F.lower(F.trim("split"))
    w = table(spark, root, "fingerprint_cache").where(F.col("exact_hash").isNotNull()).select("record_id", part.alias("part"), "exact_hash")
    t = w.where(F.col("part") == "test").join(w.where(F.col("part") == "train").select("exact_hash"), "exact_hash", "left_semi").select(F.col("record_id").alias("target_record_id"))
    return overlap.without_plain_overlaps(table(spark, root, "week2_manifest"), t).groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


_TEST = "lower(trim({c}, E' \\t\\r\\n')) IN ('test', 'testing')"
_TRAIN = "lower(trim({c}, E' \\t\\r\\n')) IN ('train', 'training')"


@catalog.query("clean_listing", f"WITH w AS (SELECT record_id, split, exact_hash FROM fingerprint_cache WHERE exact_hash IS NOT NULL), m AS (SELECT DISTINCT t.record_id FROM w s JOIN w t USING (exact_hash) WHERE {_TRAIN.format(c='s.split')} AND {_TEST.format(c='t.split')}) SELECT split, count(*) AS rows FROM week2_manifest x WHERE NOT coalesce({_TEST.format(c='split')} AND EXISTS (SELECT 1 FROM m WHERE m.record_id = x.record_id), false) GROUP BY split")
def clean_listing(spark: SparkSession, root: str) -> DataFrame:
    """Rows per split once matched test records are gone, however test is spelled."""
    w = table(spark, root, "fingerprint_cache").where(F.col("exact_hash").isNotNull()).select("record_id", split_name(F.col("split")).alias("part"), "exact_hash")
    t = w.where(F.col("part") == "test").join(w.where(F.col("part") == "train").select("exact_hash"), "exact_hash", "left_semi").select(F.col("record_id").alias("target_record_id"))
    return overlap.without_overlaps(table(spark, root, "week2_manifest"), t).groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


@catalog.query("training_best_epoch", "SELECT o_custkey AS run, max_by(o_orderkey, ROW(o_totalprice, -o_orderkey)) AS best, count(*) AS epochs FROM orders GROUP BY o_custkey")
def training_best_epoch(spark: SparkSession, root: str) -> DataFrame:
    """The best step of each run: the row of the highest score, the first of equals."""
    return table(spark, root, "orders").groupBy(F.col("o_custkey").alias("run")).agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("best"), F.count(F.lit(1)).alias("epochs"))
