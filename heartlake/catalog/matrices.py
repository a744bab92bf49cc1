"""Queries on transfer matrices, shifts and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import generalization_gap
from ..operators.reshape import matrix, melt
from ..plans import analysis, bootstrap
from ..plans.matrix import completion, consolidated_status, diagonal, grid, with_blocked
from ..plans.shifts import check_datasets, formatted, shift_vectors
from . import Catalog
from .base import ARCHITECTURES, CELLS, GAPS, REGIONS, SHIFTS, THRESHOLD, cells, demographics, r6, rounded

catalog = Catalog()


def _shifts(spark: SparkSession, root: str) -> DataFrame:
    return shift_vectors(demographics(spark, root), threshold=THRESHOLD)


def _gaps(spark: SparkSession, root: str) -> DataFrame:
    return analysis.gaps_and_shifts(cells(spark, root).drop("auroc", "record_count"), _shifts(spark, root))


@catalog.query("transfer_matrix_long", f"WITH {CELLS} SELECT architecture, source_dataset, target_dataset, record_count, macro_auroc FROM cells")
def transfer_matrix_long(spark: SparkSession, root: str) -> DataFrame:
    """Every cell of the matrix."""
    return cells(spark, root).drop("auroc")


@catalog.query(
    "transfer_matrix_pivot",
    f"WITH {CELLS} SELECT source_dataset, {', '.join(f'''max(macro_auroc) FILTER (target_dataset = '{r}') AS "{r}"''' for r in REGIONS)} FROM cells WHERE architecture = 'A' GROUP BY source_dataset",
)
def transfer_matrix_pivot(spark: SparkSession, root: str) -> DataFrame:
    """One architecture's matrix, square and in fixed order."""
    return matrix(cells(spark, root).where(F.col("architecture") == "A"), "source_dataset", "target_dataset", "macro_auroc", REGIONS)


@catalog.query("shift_vectors_kl", f"WITH {SHIFTS} SELECT source_dataset, target_dataset, {r6('age_kl')} AS age_kl_nats, {r6('sex_kl')} AS sex_kl_nats, {r6('age_kl + sex_kl')} AS demographic_kl_nats, PS, DS, LS, source_age_n, target_age_n, CAST(PS + 2 * DS + 3 * LS AS INT) AS weight_w_ij, '(' || PS || ',' || DS || ',' || LS || ')' AS shift_vector FROM shifts")
def shift_vectors_kl(spark: SparkSession, root: str) -> DataFrame:
    """Divergences and flags of all ordered pairs of regions."""
    check_datasets(demographics(spark, root), REGIONS)
    return rounded(_shifts(spark, root)).select("source_dataset", "target_dataset", "age_kl_nats", "sex_kl_nats", "demographic_kl_nats", "PS", "DS", "LS", "source_age_n", "target_age_n", "weight_w_ij", "shift_vector")


@catalog.query("shift_vectors_text", f"WITH {SHIFTS} SELECT source_dataset, target_dataset, printf('%.6f', age_kl) AS age_kl_nats, printf('%.6f', age_kl + sex_kl) AS demographic_kl_nats, printf('%.2f', {THRESHOLD}) AS ps_threshold_nats FROM shifts")
def shift_vectors_text(spark: SparkSession, root: str) -> DataFrame:
    """The divergences as they are written."""
    return formatted(_shifts(spark, root)).select("source_dataset", "target_dataset", "age_kl_nats", "demographic_kl_nats", "ps_threshold_nats")


@catalog.query("transfer_gaps", f"WITH {GAPS} SELECT architecture, source_dataset, target_dataset, {r6('macro_auroc')} AS macro_auroc, {r6('own_score')} AS in_distribution_auroc, PS, DS, LS, {r6('delta')} AS delta_ij, CAST(w AS DOUBLE) AS w_ij FROM gaps")
def transfer_gaps(spark: SparkSession, root: str) -> DataFrame:
    """Off-diagonal cells with gap and shift vector."""
    return rounded(_gaps(spark, root).select("architecture", "source_dataset", "target_dataset", "macro_auroc", "in_distribution_auroc", "PS", "DS", "LS", "delta_ij", "w_ij"))


_SCORE = "greatest(0, least(1, avg(macro_auroc) * (1 - avg(delta / (w + 1)))))"


@catalog.query("composite_score", f"WITH {GAPS} SELECT architecture, {r6('avg(macro_auroc)')} AS mean_cross_dataset_auroc, {r6('avg(delta)')} AS mean_cross_dataset_gap, {r6(_SCORE)} AS composite_score FROM gaps GROUP BY architecture")
def composite_score(spark: SparkSession, root: str) -> DataFrame:
    """One score per architecture."""
    return rounded(analysis.composite_scores(_gaps(spark, root)))


_SWEEP = f"""WITH {GAPS},
v(x) AS (VALUES (0.5), (1.0), (2.0), (3.0)),
grid AS (SELECT row_number() OVER (ORDER BY a.x, b.x, c.x) AS sweep_id, CAST(a.x AS DOUBLE) AS lambda_ps, CAST(b.x AS DOUBLE) AS lambda_ds, CAST(c.x AS DOUBLE) AS lambda_ls FROM v a, v b, v c UNION ALL SELECT 0, 1.0, 2.0, 3.0),
s AS (SELECT sweep_id, lambda_ps, lambda_ds, lambda_ls, architecture, greatest(0, least(1, avg(macro_auroc) * (1 - avg(delta / (lambda_ps * PS + lambda_ds * DS + lambda_ls * LS + 1))))) AS score FROM gaps, grid GROUP BY ALL),
rk AS (SELECT *, rank() OVER (PARTITION BY sweep_id ORDER BY score DESC) + (count(*) OVER (PARTITION BY sweep_id, score) - 1) / 2.0 AS rnk FROM s),
b AS (SELECT r.*, z.rnk AS base FROM rk r JOIN rk z ON z.sweep_id = 0 AND z.architecture = r.architecture WHERE r.sweep_id > 0),
t AS (SELECT x.sweep_id, sum(sign(x.base - y.base) * sign(x.rnk - y.rnk)) / nullif(sqrt(sum(abs(sign(x.base - y.base))) * sum(abs(sign(x.rnk - y.rnk)))), 0) AS tau FROM b x JOIN b y ON x.sweep_id = y.sweep_id AND x.architecture < y.architecture GROUP BY x.sweep_id)
SELECT CAST(b.sweep_id AS INT) AS sweep_id, lambda_ps, lambda_ds, lambda_ls, architecture, {r6('score')} AS composite_score, CAST(rnk AS DOUBLE) AS rank, {r6('tau')} AS kendall_tau FROM b JOIN t USING (sweep_id)"""


@catalog.query("lambda_sweep", _SWEEP)
def lambda_sweep(spark: SparkSession, root: str) -> DataFrame:
    """Scores, ranks and rank agreement for 64 triples of weights."""
    return rounded(analysis.weight_sweep(_gaps(spark, root)))


@catalog.query("shift_group_table", f"WITH {GAPS} SELECT architecture, PS, DS, LS, count(*) AS ordered_pair_count, {r6('avg(delta)')} AS mean_gap, {r6('stddev_samp(delta)')} AS std_gap, {r6('avg(macro_auroc)')} AS mean_cross_dataset_auroc FROM gaps GROUP BY ALL")
def shift_group_table(spark: SparkSession, root: str) -> DataFrame:
    """Mean gaps per shift vector."""
    return rounded(analysis.shift_groups(_gaps(spark, root)))


@catalog.query(
    "shift_attribution",
    f"""WITH {GAPS}, parts AS (
  SELECT architecture, 'PS' AS shift_type, coalesce(delta * PS / nullif(w, 0), 0) AS part FROM gaps UNION ALL SELECT architecture, 'DS', coalesce(delta * 2.0 * DS / nullif(w, 0), 0) FROM gaps UNION ALL SELECT architecture, 'LS', coalesce(delta * 3.0 * LS / nullif(w, 0), 0) FROM gaps),
a AS (SELECT architecture, shift_type, sum(part) AS total, count(*) AS n FROM parts GROUP BY ALL)
SELECT architecture, shift_type, {r6('total')} AS allocated_gap_total, {r6('total / nullif(sum(total) OVER (PARTITION BY architecture), 0)')} AS allocated_gap_share, n AS off_diagonal_cell_count FROM a""",
)
def shift_attribution(spark: SparkSession, root: str) -> DataFrame:
    """Gaps shared out among active shifts."""
    return rounded(analysis.attribution(_gaps(spark, root)))


@catalog.query(
    "paired_vector_tests",
    f"""WITH {GAPS}, g AS (SELECT architecture, '(' || PS || ',' || DS || ',' || LS || ')' AS v, avg(delta) AS m FROM gaps GROUP BY ALL),
d AS (SELECT a.v AS left_vector, b.v AS right_vector, a.m - b.m AS d, row_number() OVER (PARTITION BY a.v, b.v ORDER BY a.architecture) - 1 AS bit, count(*) OVER (PARTITION BY a.v, b.v) AS n FROM g a JOIN g b ON a.architecture = b.architecture AND a.v < b.v),
f AS (SELECT left_vector, right_vector, pattern, n, sum(CASE WHEN (pattern >> bit) & 1 = 1 THEN -d ELSE d END) / max(n) AS m FROM (SELECT *, unnest(range(0, CAST(1 << n AS BIGINT))) AS pattern FROM d) GROUP BY ALL),
o AS (SELECT *, max(m) FILTER (pattern = 0) OVER (PARTITION BY left_vector, right_vector) AS obs FROM f)
SELECT left_vector, right_vector, max(n) AS n_pairs, {r6('max(obs)')} AS mean_difference, {r6('count(*) FILTER (abs(m) >= abs(obs) - 1e-15) / count(*)')} AS p_value FROM o GROUP BY left_vector, right_vector""",
)
def paired_vector_tests(spark: SparkSession, root: str) -> DataFrame:
    """Exact sign-flip tests between shift vectors."""
    return rounded(analysis.paired_vector_tests(analysis.shift_groups(_gaps(spark, root))))


_GAP = "avg({m}) FILTER (source_dataset = target_dataset) - avg({m}) FILTER (source_dataset <> target_dataset)"


@catalog.query("generalization_gap", f"WITH {CELLS} SELECT architecture, {r6('avg(macro_auroc) FILTER (source_dataset = target_dataset)')} AS in_distribution_mean, {r6('avg(macro_auroc) FILTER (source_dataset <> target_dataset)')} AS cross_dataset_mean, count(*) FILTER (source_dataset = target_dataset) AS in_distribution_cells, count(*) FILTER (source_dataset <> target_dataset) AS cross_dataset_cells, {r6(_GAP.format(m='macro_auroc'))} AS generalization_gap FROM cells GROUP BY architecture")
def generalization_gap_query(spark: SparkSession, root: str) -> DataFrame:
    """Mean score on and off the diagonal."""
    return rounded(generalization_gap(cells(spark, root), ["architecture"], "macro_auroc"))


@catalog.query("gap_compare", f"WITH {CELLS}, g AS (SELECT architecture, {_GAP.format(m='macro_auroc')} AS f, {_GAP.format(m='auroc')} AS b FROM cells GROUP BY architecture) SELECT architecture, {r6('f')} AS five_label_gap, {r6('b')} AS binary_gap, {r6('f - b')} AS gap_reduction, {r6('(f - b) / nullif(f, 0) * 100')} AS gap_reduction_percent FROM g")
def gap_compare(spark: SparkSession, root: str) -> DataFrame:
    """What of the gap disappears with binary labels."""
    c = cells(spark, root)
    return rounded(analysis.gap_comparison(c, c))


_CHANGES = f"""{CELLS}, o AS (SELECT architecture, source_dataset, macro_auroc AS of, auroc AS ob FROM cells WHERE source_dataset = target_dataset),
changes AS (SELECT c.architecture, c.source_dataset, c.target_dataset, of - macro_auroc AS fg, ob - auroc AS bg, (of - macro_auroc) - (ob - auroc) AS ch FROM cells c JOIN o USING (architecture, source_dataset) WHERE c.source_dataset <> c.target_dataset)"""


@catalog.query("directional_changes", f"WITH {_CHANGES} SELECT architecture, source_dataset, target_dataset, {r6('fg')} AS five_gap, {r6('bg')} AS binary_gap, {r6('ch')} AS gap_reduction, CASE WHEN ch > 0 THEN 'reduced' WHEN ch < 0 THEN 'increased' ELSE 'unchanged' END AS direction FROM changes")
def directional_changes(spark: SparkSession, root: str) -> DataFrame:
    """Change of the gap per cell."""
    return rounded(analysis.directional_changes(cells(spark, root), "macro_auroc", "auroc"))


@catalog.query("directional_summary", f"WITH {_CHANGES} SELECT source_dataset, target_dataset, count(*) AS architectures, {r6('avg(ch)')} AS mean_gap_reduction, {r6('stddev_samp(ch)')} AS sd_gap_reduction, {r6('min(ch)')} AS min_gap_reduction, {r6('max(ch)')} AS max_gap_reduction, count(*) FILTER (ch > 0) AS reduced, count(*) FILTER (ch < 0) AS increased, CASE WHEN avg(ch) > 0 THEN 'reduced' WHEN avg(ch) < 0 THEN 'increased' ELSE 'unchanged' END AS mean_direction FROM changes GROUP BY ALL")
def directional_summary(spark: SparkSession, root: str) -> DataFrame:
    """Change of the gap per ordered pair."""
    return rounded(analysis.directional_summary(analysis.directional_changes(cells(spark, root), "macro_auroc", "auroc")))


_SEM = "CASE WHEN count(*) > 1 THEN stddev_samp({x}) / sqrt(count(*)) END"


@catalog.query("directional_asymmetry", f"""WITH {CELLS}, d AS (SELECT a.source_dataset AS dataset_a, a.target_dataset AS dataset_b, a.macro_auroc - b.macro_auroc AS d FROM cells a JOIN cells b ON a.architecture = b.architecture AND a.source_dataset = b.target_dataset AND a.target_dataset = b.source_dataset AND a.source_dataset < a.target_dataset)
SELECT dataset_a, dataset_b, count(*) AS architectures, {r6('avg(d)')} AS mean_difference, {r6('stddev_samp(d)')} AS sd_difference, {r6(_SEM.format(x='d'))} AS sem_difference FROM d GROUP BY ALL""")
def directional_asymmetry(spark: SparkSession, root: str) -> DataFrame:
    """Scores there less scores back."""
    return rounded(analysis.asymmetry(cells(spark, root)))


@catalog.query("model_summary", f"""WITH {CELLS}, m AS (SELECT architecture, avg(macro_auroc) FILTER (source_dataset = target_dataset) AS i, avg(macro_auroc) FILTER (source_dataset <> target_dataset) AS c, stddev_samp(macro_auroc) FILTER (source_dataset <> target_dataset) AS sd, count(*) FILTER (source_dataset <> target_dataset) AS n FROM cells GROUP BY architecture)
SELECT architecture, {r6('i')} AS in_distribution_mean, {r6('c')} AS cross_dataset_mean, {r6('sd')} AS cross_dataset_sd, {r6('sd / sqrt(n)')} AS cross_dataset_sem, {r6('i - c')} AS generalization_gap, CAST(rank() OVER (ORDER BY c DESC) AS INT) AS rank FROM m""")
def model_summary(spark: SparkSession, root: str) -> DataFrame:
    """Architectures side by side."""
    return rounded(analysis.model_summary(cells(spark, root)))


@catalog.query("target_difficulty", f"WITH {CELLS} SELECT target_dataset, count(*) AS cells, {r6('avg(macro_auroc)')} AS mean_auroc, {r6('stddev_samp(macro_auroc)')} AS sd_auroc, {r6('avg(macro_auroc) - 1.96 * stddev_samp(macro_auroc) / sqrt(count(*))')} AS low, {r6('avg(macro_auroc) + 1.96 * stddev_samp(macro_auroc) / sqrt(count(*))')} AS high FROM cells WHERE source_dataset <> target_dataset GROUP BY target_dataset")
def target_difficulty(spark: SparkSession, root: str) -> DataFrame:
    """How well models from elsewhere do on each target."""
    return rounded(analysis.target_difficulty(cells(spark, root)))


@catalog.query("matrix_melt", f"WITH {CELLS} SELECT architecture, source_dataset, target_dataset, 'macro_auroc' AS metric, macro_auroc AS value FROM cells UNION ALL SELECT architecture, source_dataset, target_dataset, 'auroc', auroc FROM cells")
def matrix_melt(spark: SparkSession, root: str) -> DataFrame:
    """Both scores of each cell in long form."""
    return melt(cells(spark, root), ["architecture", "source_dataset", "target_dataset"], ["macro_auroc", "auroc"], "metric", "value")


@catalog.query("diagonal_cells", f"WITH {CELLS} SELECT architecture, source_dataset, macro_auroc FROM cells WHERE source_dataset = target_dataset")
def diagonal_cells(spark: SparkSession, root: str) -> DataFrame:
    """Scores of models on their own datasets."""
    return diagonal(cells(spark, root)).select("architecture", "source_dataset", "macro_auroc")


_BLOCKED = f"""{CELLS}, done AS (SELECT * FROM cells WHERE NOT (architecture = 'A' AND source_dataset = 'ASIA') AND target_dataset <> 'EUROPE'),
wanted AS (SELECT a.architecture, s.r AS source_dataset, t.r AS target_dataset FROM (VALUES {', '.join(f"('{a}')" for a in ARCHITECTURES)}) a(architecture), (VALUES {', '.join(f"('{r}')" for r in REGIONS)}) s(r), (VALUES {', '.join(f"('{r}')" for r in REGIONS)}) t(r)),
full_grid AS (SELECT architecture, source_dataset, target_dataset, CASE WHEN d.macro_auroc IS NOT NULL THEN 'COMPLETE' WHEN target_dataset = 'EUROPE' THEN 'BLOCKED_MISSING_DATA' ELSE 'NOT_RUN' END AS status, CASE WHEN target_dataset = 'EUROPE' THEN 'no listing' END AS detail, macro_auroc FROM wanted LEFT JOIN done d USING (architecture, source_dataset, target_dataset))"""


def _grid(spark: SparkSession, root: str) -> DataFrame:
    done = cells(spark, root).where(~((F.col("architecture") == "A") & (F.col("source_dataset") == "ASIA")) & (F.col("target_dataset") != "EUROPE")).drop("auroc", "record_count")
    wanted = grid(spark, ARCHITECTURES, REGIONS)
    blocked = wanted.where(F.col("target_dataset") == "EUROPE").withColumns({"status": F.lit("BLOCKED_MISSING_DATA"), "detail": F.lit("no listing")})
    return with_blocked(done, wanted, blocked)


@catalog.query("blocked_cells", f"WITH {_BLOCKED} SELECT * FROM full_grid")
def blocked_cells(spark: SparkSession, root: str) -> DataFrame:
    """The full grid, with what is missing and why."""
    return _grid(spark, root)


@catalog.query("completion_audit", f"WITH {_BLOCKED} SELECT architecture AS stage, count(*) AS cells, count(*) FILTER (status = 'COMPLETE') AS complete, bool_and(status = 'COMPLETE') AS all_complete FROM full_grid GROUP BY architecture")
def completion_audit(spark: SparkSession, root: str) -> DataFrame:
    """Which stages are complete."""
    g = _grid(spark, root)
    return completion({a: g.where(F.col("architecture") == a) for a in ARCHITECTURES})


@catalog.query("status_by_dataset", f"WITH {CELLS} SELECT r_name AS dataset, CASE WHEN r_name IN (SELECT source_dataset FROM cells WHERE macro_auroc > 0.5) THEN 'COMPLETE' ELSE 'NOT_RUN' END AS status FROM region")
def status_by_dataset(spark: SparkSession, root: str) -> DataFrame:
    """One row per expected dataset, run or not."""
    from ..session import table

    expected = table(spark, root, "region").select(F.col("r_name").alias("dataset"))
    metrics = cells(spark, root).where(F.col("macro_auroc") > 0.5).select(F.col("source_dataset").alias("dataset"))
    return consolidated_status(expected, metrics, "dataset")


def _boot(metric: str, replicates: int) -> str:
    return f"""{CELLS}, k AS (SELECT architecture, source_dataset = target_dataset AS own, row_number() OVER (PARTITION BY architecture, source_dataset = target_dataset ORDER BY source_dataset, target_dataset) - 1 AS pos, count(*) OVER (PARTITION BY architecture, source_dataset = target_dataset) AS n, {metric} AS m FROM cells),
w AS (SELECT architecture, own, replicate, CAST('0x' || substr(md5('42_' || replicate || CASE WHEN own THEN 'd' ELSE 'o' END || '_' || pos), 1, 8) AS BIGINT) % n AS pos FROM (SELECT *, unnest(range(0, {replicates})) AS replicate FROM k)),
means AS (SELECT architecture, own, replicate, avg(m) AS m FROM w JOIN k USING (architecture, own, pos) GROUP BY ALL),
g AS (SELECT architecture, replicate, max(m) FILTER (own) - max(m) FILTER (NOT own) AS gap FROM means GROUP BY ALL)"""


_ENDS = f"SELECT architecture, {r6('quantile_cont(gap, 0.025)')} AS ci_low, {r6('quantile_cont(gap, 0.975)')} AS ci_high FROM g GROUP BY architecture"


@catalog.query("cell_bootstrap_gap_ci", f"WITH {_boot('macro_auroc', 1000)} {_ENDS}")
def cell_bootstrap_gap_ci(spark: SparkSession, root: str) -> DataFrame:
    """Intervals of the gap, by 1000 resamplings of cells. ``gap_intervals`` has 10,000."""
    return rounded(bootstrap.gap_interval(cells(spark, root), ["architecture"], "macro_auroc", 1000))


@catalog.query("paired_bootstrap_ci", f"WITH {_boot('macro_auroc - auroc', 1000)} {_ENDS}")
def paired_bootstrap_ci(spark: SparkSession, root: str) -> DataFrame:
    """Intervals of the five-label gap less the binary one, by 1000 resamplings. ``paired_gap_intervals`` has 10,000."""
    return rounded(bootstrap.paired_gap_interval(cells(spark, root), ["architecture"], "macro_auroc", "auroc", 1000))


@catalog.query("gap_intervals", f"WITH {_boot('macro_auroc', 10_000)} {_ENDS}")
def gap_intervals(spark: SparkSession, root: str) -> DataFrame:
    """Intervals of the gap, by 10,000 resamplings of cells."""
    return rounded(bootstrap.gap_interval(cells(spark, root), ["architecture"], "macro_auroc"))


@catalog.query("paired_gap_intervals", f"WITH {_boot('macro_auroc - auroc', 10_000)} {_ENDS}")
def paired_gap_intervals(spark: SparkSession, root: str) -> DataFrame:
    """Intervals of the five-label gap less the binary one, by 10,000 resamplings of cells."""
    return rounded(bootstrap.paired_gap_interval(cells(spark, root), ["architecture"], "macro_auroc", "auroc"))
