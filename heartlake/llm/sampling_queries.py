"""Problems 4 and 5: samples by category shares, and splits of related listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..session import table
from . import components, reservoirs

catalog = Catalog()

_SPLIT = "CASE WHEN lower(trim(split, E' \\t\\r\\n')) IN ('train', 'training') THEN 'train' WHEN lower(trim(split, E' \\t\\r\\n')) IN ('validation', 'val', 'valid', 'dev') THEN 'validation' WHEN lower(trim(split, E' \\t\\r\\n')) IN ('test', 'testing') THEN 'test' END"

_QUOTAS = f"""
WITH e AS (
  SELECT DISTINCT record_id, af_afl, lbbb, rbbb, av_block_1 FROM week2_manifest
  WHERE {_SPLIT} = 'train' AND af_afl IN (0, 1) AND lbbb IN (0, 1) AND rbbb IN (0, 1) AND av_block_1 IN (0, 1) AND record_id IS NOT NULL),
n AS (SELECT af_afl, lbbb, rbbb, av_block_1, count(*) AS available FROM e GROUP BY ALL),
x AS (
  SELECT p.*, coalesce(n.available, 0) AS available, coalesce(round(target_share * sample_size, 9), 0) AS exact
  FROM sample_plan p LEFT JOIN n USING (af_afl, lbbb, rbbb, av_block_1)),
b AS (
  SELECT *, CAST(least(available, coalesce(min_rows, 0)) AS DOUBLE) AS low, CAST(CASE WHEN exact > 0 THEN available ELSE least(available, coalesce(min_rows, 0)) END AS DOUBLE) AS high,
         coalesce(available < exact OR available < min_rows, false) AS short FROM x),
ends AS (
  SELECT plan_id, pos, sum(slope) AS slope FROM (SELECT plan_id, low / exact AS pos, exact AS slope FROM b WHERE exact > 0 UNION ALL SELECT plan_id, high / exact, -exact FROM b WHERE exact > 0) GROUP BY ALL),
steps AS (
  SELECT plan_id, pos, sum(slope) OVER (PARTITION BY plan_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS slope, lead(pos) OVER (PARTITION BY plan_id ORDER BY pos) AS next FROM ends),
gains AS (SELECT *, coalesce(slope * (next - pos), 0) AS gain FROM steps),
need AS (
  SELECT g.*, f.size - f.lowest - coalesce(sum(gain) OVER (PARTITION BY g.plan_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS need
  FROM gains g JOIN (SELECT plan_id, sum(low) AS lowest, max(sample_size) AS size FROM b GROUP BY plan_id) f ON f.plan_id = g.plan_id),
factor AS (
  SELECT plan_id, coalesce(min(CASE WHEN need <= 0 THEN pos WHEN gain > 0 AND need <= gain THEN pos + need / slope END), max(pos)) AS factor FROM need GROUP BY plan_id),
fair AS (SELECT b.*, round(greatest(low, least(high, coalesce(factor, 0) * exact)), 6) AS fair FROM b LEFT JOIN factor USING (plan_id)),
turns AS (
  SELECT *, floor(fair) AS whole, round(sum(fair) OVER (PARTITION BY plan_id) - sum(floor(fair)) OVER (PARTITION BY plan_id)) AS rest,
         row_number() OVER (PARTITION BY plan_id ORDER BY fair - floor(fair) DESC, cat_id) AS turn FROM fair),
z AS (SELECT *, CAST(whole + CASE WHEN turn <= rest THEN 1 ELSE 0 END AS BIGINT) AS quota FROM turns)
"""


@catalog.query("p4_found", _QUOTAS + "SELECT plan_id, cat_id FROM z WHERE short")
def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Plan categories with too few records."""
    return reservoirs.report(table(spark, root, "week2_manifest"), table(spark, root, "sample_plan")).where("short").select("plan_id", "cat_id")


@catalog.query("p4_report", _QUOTAS + "SELECT plan_id, cat_id, af_afl, lbbb, rbbb, av_block_1, target_share, sample_size, min_rows, available, quota, quota AS drawn, round(quota / nullif(sum(quota) OVER (PARTITION BY plan_id), 0), 6) AS share, short FROM z")
def p4_report(spark: SparkSession, root: str) -> DataFrame:
    """Every plan category with what it has, should get and gets."""
    return reservoirs.report(table(spark, root, "week2_manifest"), table(spark, root, "sample_plan"))


@catalog.query(
    "p4_sample",
    _QUOTAS
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY af_afl, lbbb, rbbb, av_block_1 ORDER BY CAST('0x' || substr(md5('42:' || record_id), 1, 15) AS BIGINT), record_id) AS place FROM e)
SELECT plan_id, cat_id, record_id FROM z JOIN r USING (af_afl, lbbb, rbbb, av_block_1) WHERE place <= quota""",
)
def p4_sample(spark: SparkSession, root: str) -> DataFrame:
    """The drawn records of each plan."""
    return reservoirs.draw(table(spark, root, "week2_manifest"), table(spark, root, "sample_plan"))


_GROUPS = rf"""
WITH RECURSIVE m AS (
  SELECT manifest_id AS id, {_SPLIT} AS split,
         'subject ' || nullif(ltrim(regexp_extract(subject_id, '([0-9]+)', 1), '0'), '') AS subject,
         'study ' || nullif(ltrim(regexp_extract(study_id, '([0-9]+)', 1), '0'), '') AS study FROM week2_manifest),
e AS (SELECT DISTINCT subject AS a, study AS b FROM m WHERE subject IS NOT NULL AND study IS NOT NULL),
d AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, b) AS (
  SELECT node, node FROM (SELECT subject AS node FROM m UNION SELECT study FROM m) WHERE node IS NOT NULL
  UNION SELECT reach.a, d.b FROM reach JOIN d ON reach.b = d.a),
comp AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY a),
r AS (SELECT id, split, coalesce(component, 'listing ' || id) AS component FROM m LEFT JOIN comp ON comp.node = coalesce(subject, study))
"""


@catalog.query(
    "p5_found",
    _GROUPS
    + """, g AS (SELECT component, min(id) AS group_id FROM r GROUP BY component HAVING count(DISTINCT split) > 1)
SELECT id AS manifest_id, group_id FROM r JOIN g USING (component)""",
)
def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """Listings of the groups that the present splits tear apart."""
    torn = components.torn_groups(components.related_rows(table(spark, root, "week2_manifest")))
    return torn.select(F.col("id").alias("manifest_id"), "group_id")


_ASSIGNED = _GROUPS + """, c AS (SELECT component, min(id) AS least FROM r GROUP BY component),
u AS (SELECT least, name, round(-share / ln((CAST('0x' || substr(md5('42:' || name || ':' || least), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0), 9) AS score
      FROM c, (SELECT unnest(['train', 'validation', 'test']) AS name, unnest([0.8, 0.1, 0.1]) AS share)),
b AS (SELECT least, name AS assigned FROM (SELECT *, row_number() OVER (PARTITION BY least ORDER BY score DESC, name DESC) AS no FROM u) WHERE no = 1),
a AS (SELECT id AS manifest_id, least AS component, split AS present, assigned FROM r JOIN c USING (component) JOIN b USING (least))
"""


@catalog.query("p5_splits", _ASSIGNED + "SELECT * FROM a")
def p5_splits(spark: SparkSession, root: str) -> DataFrame:
    """Every listing with its group and the split it is assigned to."""
    rows = components.assigned(components.related_rows(table(spark, root, "week2_manifest")))
    return rows.select(F.col("id").alias("manifest_id"), "component", "present", "assigned")


@catalog.query(
    "p5_report",
    _ASSIGNED
    + """, sizes AS (SELECT assigned, component, count(*) AS n FROM a GROUP BY ALL)
SELECT assigned, CAST(sum(n) AS BIGINT) AS listings, count(*) AS components, max(n) AS largest, round(sum(n) / (SELECT count(*) FROM a), 6) AS share FROM sizes GROUP BY assigned""",
)
def p5_report(spark: SparkSession, root: str) -> DataFrame:
    """Listings and groups per assigned split."""
    return components.split_report(components.related_rows(table(spark, root, "week2_manifest")))
