"""Queries on predictions: areas, label mappings, collapsed labels, intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import CLASS_NAMES, LABELS
from ..operators.checks import require_same_keys
from ..operators.metrics import auroc, positive_weights, prevalence
from ..operators.ranking import against_baseline
from ..plans import analysis, bootstrap
from ..plans.labels import binary_manifest, mapping_variants
from ..plans.matrix import macro_by_cell, score_cells
from ..session import table
from . import Catalog
from .base import PREDICTIONS, RECORDS, auroc_sql, long, predictions, r6, records, rounded

catalog = Catalog()
CELL = "architecture, source_dataset, target_dataset"
KEYS = ["architecture", "source_dataset", "target_dataset"]


@catalog.query("auroc_by_class", f"WITH {PREDICTIONS} SELECT {CELL}, label, {r6('auroc')} AS auroc, positives, negatives FROM {auroc_sql('long', CELL + ', label')}")
def auroc_by_class(spark: SparkSession, root: str) -> DataFrame:
    """Area under the curve of every cell and class."""
    return rounded(auroc(long(predictions(spark, root)), [*KEYS, "label"], "y", "p"))


@catalog.query("macro_auroc", f"WITH {PREDICTIONS} SELECT {CELL}, {r6('avg(auroc)')} AS macro_auroc, count(auroc) AS defined_classes FROM {auroc_sql('long', CELL + ', label')} GROUP BY ALL")
def macro_auroc(spark: SparkSession, root: str) -> DataFrame:
    """Mean over the defined classes of every cell."""
    return rounded(macro_by_cell(long(predictions(spark, root)), KEYS))


_WIDE = ", ".join(f"{r6(f'''max(auroc) FILTER (label = '{x}')''')} AS auroc_{c}" for x, c in zip(LABELS, CLASS_NAMES))


@catalog.query("auroc_grid", f"WITH {PREDICTIONS} SELECT {CELL}, max(positives + negatives) AS record_count, {r6('avg(auroc)')} AS macro_auroc, {_WIDE} FROM {auroc_sql('long', CELL + ', label')} GROUP BY ALL")
def auroc_grid(spark: SparkSession, root: str) -> DataFrame:
    """Cells with macro and class scores side by side."""
    return rounded(score_cells(long(predictions(spark, root)), KEYS))


@catalog.query("per_class_summary", f"WITH {PREDICTIONS}, a AS (SELECT * FROM {auroc_sql('long', CELL + ', label')}), c AS (SELECT *, CASE label {' '.join(f'''WHEN '{x}' THEN '{n}' ''' for x, n in zip(LABELS, CLASS_NAMES))} END AS class_name FROM a WHERE source_dataset <> target_dataset) SELECT architecture, class_name, count(auroc) AS cells, {r6('avg(auroc)')} AS mean_auroc, {r6('stddev_samp(auroc)')} AS sd_auroc FROM c GROUP BY ALL")
def per_class_summary(spark: SparkSession, root: str) -> DataFrame:
    """Mean score of each class across datasets."""
    return rounded(analysis.per_class(score_cells(long(predictions(spark, root)), KEYS)))


_ILL = "greatest(y_af_afl, y_av_block_1, y_lbbb, y_rbbb)"
_P = "p_af_afl, p_av_block_1, p_lbbb, p_rbbb"
_NOISY = "1 - (1 - p_af_afl) * (1 - p_av_block_1) * (1 - p_lbbb) * (1 - p_rbbb)"
_COLLAPSE = f"""{PREDICTIONS}, chosen AS (SELECT *, {_ILL} AS y FROM predictions WHERE {_ILL} = 1 OR y_normal = 1),
flat AS (SELECT {CELL}, 'max_abnormal' AS aggregation, y, greatest({_P}) AS p FROM chosen UNION ALL SELECT {CELL}, 'noisy_or', y, round({_NOISY}, 9) FROM chosen UNION ALL SELECT {CELL}, 'one_minus_normal', y, round(1 - p_normal, 9) FROM chosen)"""


@catalog.query("posthoc_collapse", f"WITH {_COLLAPSE} SELECT {CELL}, aggregation, positives + negatives AS record_count, {r6('auroc')} AS auroc FROM {auroc_sql('flat', CELL + ', aggregation')}")
def posthoc_collapse(spark: SparkSession, root: str) -> DataFrame:
    """Binary scores from five-label predictions, three ways."""
    return rounded(analysis.collapsed(predictions(spark, root), KEYS))


_VARIANTS = f"""{PREDICTIONS}, variants AS (
  SELECT {CELL}, 'base' AS variant, label, y, p FROM long
  UNION ALL SELECT {CELL}, 'exclusive_normal', label, y, p FROM long WHERE label <> 'normal'
  UNION ALL SELECT {CELL}, 'exclusive_normal', 'normal', CASE WHEN {_ILL} = 1 THEN 0 ELSE y_normal END, p_normal * (1 - greatest({_P})) FROM predictions
  UNION ALL SELECT {CELL}, 'abnormal_only', label, y, p FROM long WHERE label <> 'normal'
  UNION ALL SELECT {CELL}, 'merged_bbb', label, y, p FROM long WHERE label NOT IN ('lbbb', 'rbbb')
  UNION ALL SELECT {CELL}, 'merged_bbb', 'bbb', greatest(y_lbbb, y_rbbb), greatest(p_lbbb, p_rbbb) FROM predictions)"""


@catalog.query("mapping_variants", f"WITH {_VARIANTS} SELECT {CELL}, variant, label, count(*) AS rows, sum(y) AS positives, {r6('avg(p)')} AS mean_p FROM variants GROUP BY ALL")
def mapping_variants_query(spark: SparkSession, root: str) -> DataFrame:
    """Predictions under each label mapping."""
    v = mapping_variants(predictions(spark, root), KEYS)
    return rounded(v.groupBy(*KEYS, "variant", "label").agg(F.count(F.lit(1)).alias("rows"), F.sum("y").alias("positives"), F.avg("p").alias("mean_p")))


@catalog.query(
    "mapping_sensitivity",
    f"""WITH {_VARIANTS}, c AS (SELECT {CELL}, variant, avg(auroc) AS m FROM {auroc_sql('variants', CELL + ', variant, label')} GROUP BY ALL),
g AS (SELECT architecture, variant, avg(m) FILTER (source_dataset = target_dataset) AS i, avg(m) FILTER (source_dataset <> target_dataset) AS x, count(m) FILTER (source_dataset = target_dataset) AS ni, count(m) FILTER (source_dataset <> target_dataset) AS nx FROM c GROUP BY ALL),
r AS (SELECT *, rank() OVER (PARTITION BY variant ORDER BY x DESC) AS rnk FROM g)
SELECT architecture, variant, {r6('i')} AS in_distribution_mean, {r6('x')} AS cross_dataset_mean, ni AS in_distribution_cells, nx AS cross_dataset_cells, {r6('i - x')} AS generalization_gap, CAST(rnk AS INT) AS rank,
       {r6("(i - x) - max(i - x) FILTER (variant = 'base') OVER (PARTITION BY architecture)")} AS gap_change, CAST(rnk - max(rnk) FILTER (variant = 'base') OVER (PARTITION BY architecture) AS INT) AS rank_change FROM r""",
)
def mapping_sensitivity(spark: SparkSession, root: str) -> DataFrame:
    """What each label mapping does to gaps and ranks."""
    return rounded(analysis.mapping_sensitivity(predictions(spark, root)))


@catalog.query(
    "rescored_targets",
    f"""WITH {_VARIANTS}, c AS (SELECT {CELL}, variant, avg(auroc) AS m FROM {auroc_sql('variants', CELL + ', variant, label')} GROUP BY ALL)
SELECT {CELL}, variant, {r6('m')} AS macro_auroc, {r6("m - max(m) FILTER (variant = 'base') OVER (PARTITION BY " + CELL + ")")} AS change FROM c""",
)
def rescored_targets(spark: SparkSession, root: str) -> DataFrame:
    """Every cell's macro score under each label mapping, and the change against the plain one."""
    return rounded(analysis.rescored(predictions(spark, root), KEYS))


@catalog.query("rescored_labels", f"WITH {PREDICTIONS}, relabelled AS (SELECT p.*, CASE WHEN {_ILL} = 1 THEN 0 ELSE y_normal END AS y_new FROM predictions p) SELECT target_dataset, count(DISTINCT record_id) AS records, count(DISTINCT CASE WHEN y_new <> y_normal THEN record_id END) AS changed FROM relabelled GROUP BY target_dataset")
def rescored_labels(spark: SparkSession, root: str) -> DataFrame:
    """Records whose label another mapping changes; both sides must have the same records."""
    base = records(spark, root).select(F.col("dataset").alias("target_dataset"), "record_id", *LABELS)
    other = base.withColumn("normal_new", F.when(F.greatest(*LABELS[1:]) == 1, 0).otherwise(F.col("normal"))).select("record_id", "normal_new")
    require_same_keys(base, other, ["record_id"], "label tables")
    both = base.join(other, "record_id")
    return both.groupBy("target_dataset").agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("normal_new") != F.col("normal")).alias("changed"))


@catalog.query("label_rank_change", f"WITH {PREDICTIONS}, a AS (SELECT * FROM {auroc_sql('long', 'architecture, label')}) SELECT architecture, label, {r6('auroc')} AS auroc, {r6('''auroc - max(auroc) FILTER (label = 'normal') OVER (PARTITION BY architecture)''')} AS against_normal FROM a")
def label_rank_change(spark: SparkSession, root: str) -> DataFrame:
    """Each class against the normal class of the same architecture."""
    per = auroc(long(predictions(spark, root)), ["architecture", "label"], "y", "p").select("architecture", "label", "auroc")
    return rounded(per.withColumn("against_normal", against_baseline(["architecture"], "auroc", F.col("label") == "normal")))


_REPS = 50
_BOOT = f"""{PREDICTIONS}, one AS (SELECT * FROM long WHERE architecture = 'encoder' AND source_dataset = 'ptbxl' AND target_dataset IN ('cpsc2018', 'georgia')),
k AS (SELECT target_dataset, record_id, row_number() OVER (PARTITION BY target_dataset ORDER BY record_id) - 1 AS pos, count(*) OVER (PARTITION BY target_dataset) AS n FROM (SELECT DISTINCT target_dataset, record_id FROM one)),
w AS (SELECT target_dataset, replicate, CAST('0x' || substr(md5('42_' || replicate || '_' || pos), 1, 8) AS BIGINT) % n AS pos FROM (SELECT *, unnest(range(0, {_REPS})) AS replicate FROM k)),
rows AS (SELECT w.target_dataset, replicate, label, y, p FROM w JOIN k USING (target_dataset, pos) JOIN one USING (target_dataset, record_id)),
a AS (SELECT * FROM {auroc_sql('rows', 'target_dataset, replicate, label')}),
b AS (SELECT target_dataset, label AS metric, auroc FROM a WHERE auroc IS NOT NULL UNION ALL SELECT target_dataset, 'macro', avg(auroc) FROM a GROUP BY target_dataset, replicate HAVING count(*) = count(auroc))"""


@catalog.query("bootstrap_auroc_ci", f"WITH {_BOOT} SELECT target_dataset, metric, count(*) AS replicates_used, {r6('quantile_cont(auroc, 0.025)')} AS ci_low, {r6('quantile_cont(auroc, 0.975)')} AS ci_high FROM b GROUP BY ALL")
def bootstrap_auroc_ci(spark: SparkSession, root: str) -> DataFrame:
    """A sample that SQL can check: two cells of fifty, 50 replicates. ``auroc_intervals`` has all."""
    one = long(predictions(spark, root)).where((F.col("architecture") == "encoder") & (F.col("source_dataset") == "ptbxl") & F.col("target_dataset").isin("cpsc2018", "georgia"))
    return rounded(bootstrap.record_intervals(one.select("target_dataset", "record_id", "label", "y", "p"), ["target_dataset"], replicates=_REPS))


@catalog.query("interval_widths", f"WITH {_BOOT}, e AS (SELECT target_dataset, metric, quantile_cont(auroc, 0.975) - quantile_cont(auroc, 0.025) AS w FROM b GROUP BY ALL) SELECT 'encoder' AS architecture, target_dataset, {r6('avg(w)')} AS mean_width, {r6('stddev_samp(w)')} AS sd_width FROM e GROUP BY target_dataset")
def interval_widths(spark: SparkSession, root: str) -> DataFrame:
    """A sample that SQL can check: widths over the labels of two cells. ``auroc_interval_widths`` has all."""
    one = long(predictions(spark, root)).where((F.col("architecture") == "encoder") & (F.col("source_dataset") == "ptbxl") & F.col("target_dataset").isin("cpsc2018", "georgia"))
    ci = bootstrap.record_intervals(one.select("target_dataset", "record_id", "label", "y", "p"), ["target_dataset"], replicates=_REPS)
    return rounded(analysis.interval_widths(ci.withColumn("architecture", F.lit("encoder"))))


def _all_intervals(spark: SparkSession, root: str) -> DataFrame:
    return bootstrap.record_intervals(long(predictions(spark, root)), KEYS)


@catalog.query("auroc_intervals")
def auroc_intervals(spark: SparkSession, root: str) -> DataFrame:
    """Intervals of class and macro scores of every cell, by 1000 resamplings of its records."""
    return rounded(_all_intervals(spark, root))


@catalog.query("auroc_interval_widths")
def auroc_interval_widths(spark: SparkSession, root: str) -> DataFrame:
    """How wide the macro intervals are per architecture and target, over all sources."""
    return rounded(analysis.interval_widths(_all_intervals(spark, root).where(F.col("metric") == "macro")))


_PREV = " UNION ALL ".join(f"SELECT dataset, '{x}' AS label, {x} AS y FROM records" for x in LABELS)


@catalog.query("prevalence_by_dataset", f"WITH {RECORDS}, l AS ({_PREV}) SELECT dataset, label, sum(y) AS positives, count(*) AS rows, {r6('avg(y)')} AS prevalence FROM l GROUP BY ALL")
def prevalence_by_dataset(spark: SparkSession, root: str) -> DataFrame:
    """Positives and their share per dataset and label."""
    return rounded(prevalence(records(spark, root), ["dataset"], LABELS))


@catalog.query("pos_weight", f"WITH {RECORDS}, l AS ({_PREV}) SELECT label, {r6('(count(*) - sum(y)) / sum(y)')} AS weight FROM l GROUP BY label")
def pos_weight(spark: SparkSession, root: str) -> DataFrame:
    """Negatives per positive of each label."""
    return rounded(positive_weights(records(spark, root), LABELS))


@catalog.query("binary_manifest", f"WITH {RECORDS} SELECT record_id, dataset, CAST(greatest(af_afl, av_block_1, lbbb, rbbb) AS TINYINT) AS abnormal FROM records WHERE greatest(af_afl, av_block_1, lbbb, rbbb) = 1 OR normal = 1")
def binary_manifest_query(spark: SparkSession, root: str) -> DataFrame:
    """Listings with one abnormal flag."""
    return binary_manifest(records(spark, root)).select("record_id", "dataset", "abnormal")


@catalog.query("auroc_of_age", f"WITH {RECORDS}, a AS (SELECT ecg_id, min(age) AS age FROM signal_index WHERE age > 0 AND age < 120 GROUP BY ecg_id), j AS (SELECT dataset, af_afl AS y, CAST(age AS DOUBLE) AS p FROM records JOIN a ON record_id = ecg_id) SELECT dataset, {r6('auroc')} AS auroc, positives, negatives FROM {auroc_sql('j', 'dataset')}")
def auroc_of_age(spark: SparkSession, root: str) -> DataFrame:
    """How well age alone tells one label, per dataset; many ties."""
    from ..functions.coerce import plausible_age

    ages = table(spark, root, "signal_index").where(plausible_age(F.col("age"))).groupBy(F.col("ecg_id").alias("record_id")).agg(F.min("age").cast("double").alias("age"))
    return rounded(auroc(records(spark, root).join(ages, "record_id"), ["dataset"], "af_afl", "age"))
