"""Inputs that several queries share, in Spark and as SQL.

Regions play the datasets of a transfer matrix (supplier's region the source,
customer's the target), return flags the architectures, and mean discount the
score.  Predictions are made of the listing's flags and of digests, so that
both engines make the same ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import DATASETS, LABELS, canonical_dataset
from ..operators.ranking import first_per_key
from ..session import table

REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
ARCHITECTURES = ("A", "N", "R")
MODELS = ("encoder", "residual")
THRESHOLD = 0.0005


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles to ``digits`` decimals, so that engines agree."""
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def r6(expression: str) -> str:
    """The same rounding in SQL, without a negative zero."""
    return f"(round({expression}, 6) + 0.0)"


def cells(spark: SparkSession, root: str) -> DataFrame:
    """``architecture, source_dataset, target_dataset, record_count, macro_auroc, auroc``; the last plays the binary score."""
    t = lambda name: table(spark, root, name)
    region = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    supplier = t("supplier").join(region, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("r_name").alias("source_dataset"))
    customer = t("customer").join(region, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("r_name").alias("target_dataset"))
    orders = t("orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "target_dataset")
    lines = t("lineitem").select("l_orderkey", "l_suppkey", F.col("l_returnflag").alias("architecture"), "l_discount", "l_tax")
    rows = lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    whole = lambda c: F.sum(F.round(F.col(c) * 100).cast("bigint"))
    n = F.count(F.lit(1))
    return rows.groupBy("architecture", "source_dataset", "target_dataset").agg(n.alias("record_count"), F.round(whole("l_discount") / (n * F.lit(10.0)), 9).alias("macro_auroc"), F.round(whole("l_tax") / (n * F.lit(8.0)), 9).alias("auroc"))


CELLS = """cells AS (
  SELECT l_returnflag AS architecture, rs.r_name AS source_dataset, rc.r_name AS target_dataset, count(*) AS record_count,
         round(sum(CAST(round(l_discount * 100) AS BIGINT)) / (count(*) * 10.0), 9) AS macro_auroc,
         round(sum(CAST(round(l_tax * 100) AS BIGINT)) / (count(*) * 8.0), 9) AS auroc
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ns ON s_nationkey = ns.n_nationkey JOIN region rs ON ns.n_regionkey = rs.r_regionkey
       JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation nc ON c_nationkey = nc.n_nationkey JOIN region rc ON nc.n_regionkey = rc.r_regionkey
  GROUP BY ALL)"""


def demographics(spark: SparkSession, root: str) -> DataFrame:
    """Counts per region: balances play ages, segments play sexes."""
    t = lambda name: table(spark, root, name)
    rows = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    b, key = F.col("c_acctbal"), F.col("r_regionkey")
    first = F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING")
    return rows.groupBy(F.col("r_name").alias("dataset"), key.alias("k")).agg(
        F.count_if(b < 2000).alias("age_0_44_count"), F.count_if((b >= 2000) & (b < 6000)).alias("age_45_74_count"), F.count_if(b >= 6000).alias("age_75_plus_count"), F.count_if(first).alias("sex_female_count"), F.count_if(~first).alias("sex_male_count")
    ).select("*", F.when(F.col("k").isin(0, 2), 400).otherwise(500).alias("sampling_rate_hz"), F.concat(F.lit("hw"), (F.col("k") % 2).cast("string")).alias("hardware_group"), (F.col("k") != 1).cast("int").alias("hardware_documented"), F.concat(F.lit("schema"), (F.col("k") % 3).cast("string")).alias("label_schema")).drop("k")


DEMOGRAPHICS = """demographics AS (
  SELECT r_name AS dataset, count(*) FILTER (c_acctbal < 2000) AS a0, count(*) FILTER (c_acctbal >= 2000 AND c_acctbal < 6000) AS a1, count(*) FILTER (c_acctbal >= 6000) AS a2,
         count(*) FILTER (c_mktsegment IN ('AUTOMOBILE', 'BUILDING')) AS x0, count(*) FILTER (c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING')) AS x1,
         CASE WHEN r_regionkey IN (0, 2) THEN 400 ELSE 500 END AS rate, 'hw' || (r_regionkey % 2) AS hw, CASE WHEN r_regionkey <> 1 THEN 1 ELSE 0 END AS doc, 'schema' || (r_regionkey % 3) AS scheme
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, r_regionkey)"""


def _kl(names: list[str]) -> str:
    n = len(names)
    p = [f"((s.{x} + 0.5) / (s.{' + s.'.join(names)} + {0.5 * n}))" for x in names]
    q = [f"((t.{x} + 0.5) / (t.{' + t.'.join(names)} + {0.5 * n}))" for x in names]
    return " + ".join(f"{a} * ln({a} / {b})" for a, b in zip(p, q))


SHIFTS = f"""{DEMOGRAPHICS},
raw_shifts AS (
  SELECT s.dataset AS source_dataset, t.dataset AS target_dataset, {_kl(['a0', 'a1', 'a2'])} AS age_kl, {_kl(['x0', 'x1'])} AS sex_kl,
         CASE WHEN s.rate <> t.rate OR (s.doc = 1 AND t.doc = 1 AND s.hw <> t.hw) THEN 1 ELSE 0 END AS DS, CASE WHEN s.scheme <> t.scheme THEN 1 ELSE 0 END AS LS,
         s.a0 + s.a1 + s.a2 AS source_age_n, t.a0 + t.a1 + t.a2 AS target_age_n
  FROM demographics s JOIN demographics t ON s.dataset <> t.dataset),
shifts AS (SELECT *, CASE WHEN age_kl + sex_kl > {THRESHOLD} THEN 1 ELSE 0 END AS PS FROM raw_shifts)"""

GAPS = f"""{CELLS}, {SHIFTS},
own AS (SELECT architecture, source_dataset, macro_auroc AS own_score FROM cells WHERE source_dataset = target_dataset),
gaps AS (
  SELECT c.architecture, c.source_dataset, c.target_dataset, c.macro_auroc, own_score, PS, DS, LS, own_score - c.macro_auroc AS delta, PS + 2.0 * DS + 3.0 * LS AS w
  FROM cells c JOIN own USING (architecture, source_dataset) JOIN shifts USING (source_dataset, target_dataset) WHERE c.source_dataset <> c.target_dataset)"""


def records(spark: SparkSession, root: str) -> DataFrame:
    """One listing per record whose five flags are 0 or 1: the one with the smallest id."""
    fine = F.lit(True)
    for x in LABELS:
        fine = fine & F.col(x).isin(0, 1)
    rows = table(spark, root, "week2_manifest").where(fine & F.col("record_id").isNotNull())
    return first_per_key(rows, ["record_id"], [F.col("manifest_id")]).withColumn("dataset", canonical_dataset(F.col("dataset")))


_ALIAS = "CASE lower(regexp_replace(dataset, '[^A-Za-z0-9]', '', 'g')) WHEN 'ptbxl' THEN 'ptbxl' WHEN 'mimicivecg' THEN 'mimic_iv' WHEN 'mimiciv' THEN 'mimic_iv' WHEN 'cpsc2018' THEN 'cpsc2018' WHEN 'georgia12lead' THEN 'georgia' WHEN 'georgia' THEN 'georgia' WHEN 'code15' THEN 'code_ii' WHEN 'codeii' THEN 'code_ii' ELSE trim(dataset) END"
_FINE = " AND ".join(f"{x} IN (0, 1)" for x in LABELS)
RECORDS = f"""records AS (
  SELECT * EXCLUDE (dataset, no), {_ALIAS} AS dataset FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY manifest_id) AS no FROM week2_manifest WHERE {_FINE} AND record_id IS NOT NULL) WHERE no = 1)"""


def predictions(spark: SparkSession, root: str) -> DataFrame:
    """Wide predictions: ``architecture, source_dataset, target_dataset, record_id, y_*, p_*`` of every model trained on every dataset."""
    rows = records(spark, root).select(F.col("dataset").alias("target_dataset"), "record_id", *LABELS)
    many = rows.withColumn("architecture", F.explode(F.array(*[F.lit(m) for m in MODELS]))).withColumn("source_dataset", F.explode(F.array(*[F.lit(d) for d in DATASETS])))

    def p(x: str):
        digest = F.md5(F.concat_ws("|", "architecture", "source_dataset", "record_id", F.lit(x)))
        part = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 1000) / F.lit(1000.0)
        return F.round(F.lit(0.3) * F.col(x).cast("double") + F.lit(0.7) * part, 6)

    keys = ["architecture", "source_dataset", "target_dataset", "record_id"]
    return many.select(*keys, *[F.col(x).cast("int").alias(f"y_{x}") for x in LABELS], *[p(x).alias(f"p_{x}") for x in LABELS])


def _p(x: str) -> str:
    return f"round(0.3 * {x} + 0.7 * ((CAST('0x' || substr(md5(m.architecture || '|' || s.source_dataset || '|' || record_id || '|{x}'), 1, 8) AS BIGINT) % 1000) / 1000.0), 6) AS p_{x}"


PREDICTIONS = f"""{RECORDS},
predictions AS (
  SELECT m.architecture, s.source_dataset, dataset AS target_dataset, record_id, {', '.join(f'CAST({x} AS INT) AS y_{x}' for x in LABELS)}, {', '.join(_p(x) for x in LABELS)}
  FROM records CROSS JOIN (VALUES {', '.join(f"('{m}')" for m in MODELS)}) m(architecture) CROSS JOIN (VALUES {', '.join(f"('{d}')" for d in DATASETS)}) s(source_dataset)),
long AS ({' UNION ALL '.join(f"SELECT architecture, source_dataset, target_dataset, record_id, '{x}' AS label, y_{x} AS y, p_{x} AS p FROM predictions" for x in LABELS)})"""


def long(wide: DataFrame) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(x).alias("label"), F.col(f"y_{x}").alias("y"), F.col(f"p_{x}").alias("p")) for x in LABELS])
    keys = ["architecture", "source_dataset", "target_dataset", "record_id"]
    return wide.select(*keys, F.explode(rows).alias("x")).select(*keys, "x.*")


def auroc_sql(source: str, group: str) -> str:
    """``group, auroc, positives, negatives`` of a table with ``y`` and ``p``, by average ranks."""
    return f"""(SELECT {group}, (sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / nullif(count(*) FILTER (y = 1) * count(*) FILTER (y = 0), 0) AS auroc,
         count(*) FILTER (y = 1) AS positives, count(*) FILTER (y = 0) AS negatives
  FROM (SELECT {group}, y, rank() OVER (PARTITION BY {group} ORDER BY p) + (count(*) OVER (PARTITION BY {group}, p) - 1) / 2.0 AS rk FROM {source}) GROUP BY {group})"""
