"""Queries on the listing and the index: names, flags, eligibility, splits, quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codes import delimited_codes, labels_of, mapping_codes
from ..functions.coerce import any_positive, binary_flag, hash_split, join_texts, plausible_age, safe_relative_path
from ..functions.listings import number_in, same_file, split_name
from ..functions.names import LABELS, canonical_dataset, slug
from ..functions.packed import explode_packed
from ..operators.dedup import conflicting, exact_copies, keep_first
from ..operators.metrics import prevalence
from ..plans import eligibility, manifest, stratify
from ..plans.labels import labels_from_diagnoses, text_labels
from ..plans.shifts import histogram, null_threshold
from ..session import cut, table
from . import Catalog
from .base import _ALIAS, RECORDS, r6, records, rounded

catalog = Catalog()
_LISTING = "week2_manifest"
_SPLIT = "CASE WHEN lower(trim(split, E' \\t\\r\\n')) IN ('train', 'training') THEN 'train' WHEN lower(trim(split, E' \\t\\r\\n')) IN ('validation', 'val', 'valid', 'dev') THEN 'validation' WHEN lower(trim(split, E' \\t\\r\\n')) IN ('test', 'testing') THEN 'test' END"
_NUM = "nullif(ltrim(regexp_extract({c}, '([0-9]+)', 1), '0'), '')"


@catalog.query("canonical_names", f"SELECT dataset, {_ALIAS} AS run_id, count(*) AS rows FROM week2_manifest GROUP BY ALL")
def canonical_names(spark: SparkSession, root: str) -> DataFrame:
    """Spellings of datasets and the run ids they stand for."""
    return table(spark, root, _LISTING).groupBy("dataset", canonical_dataset(F.col("dataset")).alias("run_id")).agg(F.count(F.lit(1)).alias("rows"))


@catalog.query("slug_names", "SELECT dataset, regexp_replace(regexp_replace(lower(dataset), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, count(*) AS rows FROM week2_manifest GROUP BY ALL")
def slug_names(spark: SparkSession, root: str) -> DataFrame:
    """Dataset names as slugs."""
    return table(spark, root, _LISTING).groupBy("dataset", slug(F.col("dataset")).alias("slug")).agg(F.count(F.lit(1)).alias("rows"))


@catalog.query("split_names", f"SELECT split, {_SPLIT} AS name, count(*) AS rows FROM week2_manifest GROUP BY ALL")
def split_names(spark: SparkSession, root: str) -> DataFrame:
    """Spellings of splits."""
    return table(spark, root, _LISTING).groupBy("split", split_name(F.col("split")).alias("name")).agg(F.count(F.lit(1)).alias("rows"))


@catalog.query("binary_coercion", "WITH t AS (SELECT lower(trim(sex)) AS s FROM signal_index) SELECT s AS value, CAST(CASE WHEN s IN ('1', '1.0', 'true', 't', 'yes', 'y') THEN 1 WHEN s IN ('0', '0.0', 'false', 'f', 'no', 'n') THEN 0 END AS TINYINT) AS flag, count(*) AS rows FROM t GROUP BY ALL")
def binary_coercion(spark: SparkSession, root: str) -> DataFrame:
    """A dirty column read as a flag; what is no flag is null."""
    t = table(spark, root, "signal_index").select(F.lower(F.trim("sex")).alias("value"))
    return t.groupBy("value", binary_flag(F.col("value")).alias("flag")).agg(F.count(F.lit(1)).alias("rows"))


@catalog.query("row_max_or", f"WITH {RECORDS} SELECT dataset, greatest(af_afl, av_block_1, lbbb, rbbb) AS abnormal, count(*) AS rows FROM records GROUP BY ALL")
def row_max_or(spark: SparkSession, root: str) -> DataFrame:
    """Any abnormal label, per dataset."""
    return records(spark, root).groupBy("dataset", any_positive(*[F.col(x) for x in LABELS[1:]]).alias("abnormal")).agg(F.count(F.lit(1)).alias("rows"))


_MD5 = "md5('42_' || doc_id)"
_FRACTION = f"((((CAST('0x' || substr({_MD5}, 1, 16) AS UBIGINT) % 10000) * 1616 + CAST('0x' || substr({_MD5}, 17, 16) AS UBIGINT) % 10000) % 10000) / 10000.0)"


@catalog.query("hash_split", f"SELECT doc_id, CASE WHEN {_FRACTION} < 0.2 THEN 'test' WHEN {_FRACTION} < 0.3 THEN 'val' ELSE 'train' END AS split FROM documents")
def hash_split_query(spark: SparkSession, root: str) -> DataFrame:
    """Documents split by digest."""
    return table(spark, root, "documents").select("doc_id", hash_split(F.col("doc_id")).alias("split"))


@catalog.query("safe_paths", r"SELECT coalesce(NOT regexp_matches(replace(trim(signal_path), '\', '/'), '^/|^[A-Za-z]:|(^|/)\.\.(/|$)') AND trim(signal_path) <> '', false) AS safe, count(*) AS rows FROM week2_manifest GROUP BY ALL")
def safe_paths(spark: SparkSession, root: str) -> DataFrame:
    """Paths that stay below their root, and others."""
    safe = F.coalesce(safe_relative_path(F.col("signal_path")), F.lit(False))
    return table(spark, root, _LISTING).groupBy(safe.alias("safe")).agg(F.count(F.lit(1)).alias("rows"))


@catalog.query("files_spelled_alike")
def files_spelled_alike(spark: SparkSession, root: str) -> DataFrame:
    """Files with their number of spellings and listings."""
    return table(spark, root, _LISTING).groupBy(same_file(F.col("signal_path")).alias("file")).agg(F.countDistinct("signal_path").alias("spellings"), F.count(F.lit(1)).alias("listings"))


@catalog.query("age_filter", "SELECT dataset, count(*) AS rows, count(*) FILTER (age > 0 AND age < 120) AS plausible, min(age) FILTER (age > 0 AND age < 120) AS youngest, max(age) FILTER (age > 0 AND age < 120) AS oldest FROM signal_index GROUP BY dataset")
def age_filter(spark: SparkSession, root: str) -> DataFrame:
    """Plausible ages per dataset."""
    ok = plausible_age(F.col("age"))
    return table(spark, root, "signal_index").groupBy("dataset").agg(F.count(F.lit(1)).alias("rows"), F.count_if(ok).alias("plausible"), F.min(F.when(ok, F.col("age"))).alias("youngest"), F.max(F.when(ok, F.col("age"))).alias("oldest"))


@catalog.query("age_histogram", "WITH b AS (SELECT dataset, unnest(range(0, 10)) AS bin FROM (SELECT DISTINCT dataset FROM signal_index)), c AS (SELECT dataset, least(CAST(floor(age / 10) AS INT), 9) AS bin, count(*) AS n FROM signal_index WHERE age BETWEEN 0 AND 100 GROUP BY ALL) SELECT b.dataset, CAST(b.bin AS INT) AS bin, coalesce(n, 0) + 1 AS n FROM b LEFT JOIN c ON b.dataset IS NOT DISTINCT FROM c.dataset AND b.bin = c.bin")
def age_histogram(spark: SparkSession, root: str) -> DataFrame:
    """Ages in ten bins per dataset, each count raised by one."""
    return histogram(table(spark, root, "signal_index").where(F.col("dataset").isNotNull()), ["dataset"], "age")


@catalog.query("null_shift_threshold")
def null_shift_threshold(spark: SparkSession, root: str) -> DataFrame:
    """Divergence of ages that random halves of one dataset reach."""
    return rounded(null_threshold(table(spark, root, "signal_index"), "index_id", "age"))


@catalog.query("subject_rollup", f"WITH {RECORDS}, k AS (SELECT *, {_NUM.format(c='subject_id')} AS subject FROM records) SELECT subject, count(*) AS n_recordings, {', '.join(f'sum({x}) AS {x}' for x in LABELS)} FROM k WHERE subject IS NOT NULL GROUP BY subject")
def subject_rollup(spark: SparkSession, root: str) -> DataFrame:
    """Recordings and positives of each subject."""
    return eligibility.subject_table(records(spark, root).withColumn("subject", number_in(F.col("subject_id"))).where(F.col("subject").isNotNull()), "subject")


@catalog.query("leakage_check", f"WITH k AS (SELECT {_NUM.format(c='subject_id')} AS subject, {_SPLIT} AS split FROM week2_manifest) SELECT subject, count(DISTINCT split) AS splits, count(*) AS rows FROM k WHERE subject IS NOT NULL GROUP BY subject HAVING count(DISTINCT split) > 1")
def leakage_check(spark: SparkSession, root: str) -> DataFrame:
    """Subjects that stand in several splits."""
    k = table(spark, root, _LISTING).select(number_in(F.col("subject_id")).alias("subject"), split_name(F.col("split")).alias("split")).where(F.col("subject").isNotNull())
    return k.groupBy("subject").agg(F.countDistinct("split").alias("splits"), F.count(F.lit(1)).alias("rows")).where(F.col("splits") > 1)


_RULES = f"""WITH m AS (SELECT *, {_SPLIT} AS name FROM week2_manifest)
SELECT 'blank_id' AS rule, count(*) FILTER (coalesce(trim(record_id), '') = '' OR coalesce(trim(subject_id), '') = '') AS rows FROM m
UNION ALL SELECT 'unknown_split', count(*) FILTER (name IS NULL) FROM m
UNION ALL SELECT 'bad_flag', count(*) FILTER (NOT coalesce({' AND '.join(f'coalesce({x} IN (0, 1), false)' for x in LABELS)}, false)) FROM m
UNION ALL SELECT 'bad_sample_count', count(*) FILTER (NOT coalesce(valid_num_samples IN (2500, 5000), false)) FROM m
UNION ALL SELECT 'repeated_record', count(*) FROM (SELECT record_id FROM m GROUP BY record_id HAVING count(*) > 1)
UNION ALL SELECT 'leaking_subject', count(*) FROM (SELECT subject_id FROM m GROUP BY subject_id HAVING min(name) < max(name))"""


@catalog.query("manifest_violations", _RULES)
def manifest_violations(spark: SparkSession, root: str) -> DataFrame:
    """Rows that break each rule of a canonical listing."""
    return manifest.violations(table(spark, root, _LISTING).withColumn("split", split_name(F.col("split"))))


@catalog.query("manifest_qc", f"WITH {RECORDS}, k AS (SELECT *, {_SPLIT} AS name FROM records) SELECT name AS split, count(*) AS records, count(DISTINCT subject_id) AS subjects, {', '.join(f'sum({x}) AS positive_{x}' for x in LABELS)} FROM k WHERE name IS NOT NULL GROUP BY name")
def manifest_qc(spark: SparkSession, root: str) -> DataFrame:
    """Records, subjects and positives per split."""
    return manifest.listing_qc(records(spark, root).withColumn("split", split_name(F.col("split"))).where(F.col("split").isNotNull()))


_INCOMPLETE = " OR ".join(f"{x} IS NULL" for x in LABELS)
_CASCADE = f"""WITH t AS (SELECT *, CASE WHEN coalesce(trim(subject_id), '') = '' OR coalesce(trim(record_id), '') = '' THEN 'missing_id' WHEN coalesce(trim(signal_path), '') = '' THEN 'missing_path' WHEN {_INCOMPLETE} THEN 'incomplete_labels' WHEN greatest({', '.join(LABELS)}) = 0 THEN 'no_positive_label' END AS reason FROM week2_manifest)
SELECT reason, count(*) AS rows FROM t WHERE reason IS NOT NULL GROUP BY reason
UNION ALL SELECT 'eligible', count(DISTINCT record_id) FROM t WHERE reason IS NULL
UNION ALL SELECT 'duplicate_study', count(*) - count(DISTINCT record_id) FROM t WHERE reason IS NULL"""
_SPEC = eligibility.ColumnSpec("subject_id", "record_id", "signal_path")


@catalog.query("eligibility_cascade", _CASCADE)
def eligibility_cascade(spark: SparkSession, root: str) -> DataFrame:
    """Rows lost to each test in turn."""
    return eligibility.cascade_counts(table(spark, root, _LISTING), _SPEC, need_positive=True)


@catalog.query("conflicting_duplicates", f"SELECT record_id, count(*) AS rows FROM week2_manifest WHERE record_id IS NOT NULL GROUP BY record_id HAVING count(DISTINCT coalesce(subject_id, chr(1))) > 1 OR {' OR '.join(f'count(DISTINCT coalesce({x}, -99)) > 1' for x in LABELS)}")
def conflicting_duplicates(spark: SparkSession, root: str) -> DataFrame:
    """Records listed with different subjects or flags."""
    return conflicting(table(spark, root, _LISTING).where(F.col("record_id").isNotNull()), "record_id", ["subject_id", *LABELS])


@catalog.query("dedup_keep_first", "SELECT record_id, manifest_id, dataset FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY recorded_at NULLS LAST, manifest_id) AS no FROM week2_manifest) WHERE no = 1")
def dedup_keep_first(spark: SparkSession, root: str) -> DataFrame:
    """The earliest listing of each record."""
    return keep_first(table(spark, root, _LISTING), ["record_id"], [F.col("recorded_at").asc_nulls_last(), F.col("manifest_id")]).select("record_id", "manifest_id", "dataset")


@catalog.query("exact_duplicates", "SELECT sha256(text) AS content_hash, count(*) AS rows, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def exact_duplicates(spark: SparkSession, root: str) -> DataFrame:
    """Texts that occur more than once."""
    return exact_copies(table(spark, root, "documents"), "doc_id", "text")


_QC = f"""WITH {RECORDS}, k AS (SELECT *, {_SPLIT} AS name FROM records), n AS (SELECT * FROM k WHERE name IS NOT NULL), b AS (SELECT name AS s, * FROM n UNION ALL SELECT 'all', * FROM n),
l AS ({' UNION ALL '.join(f"SELECT s, '{x}' AS label, {x} AS y FROM b" for x in LABELS)})
SELECT 'size' AS section, s AS split, NULL AS label, 'records' AS metric, CAST(count(*) AS DOUBLE) AS value FROM b GROUP BY s
UNION ALL SELECT 'size', s, NULL, 'subjects', count(DISTINCT subject_id) FROM b GROUP BY s
UNION ALL SELECT 'prevalence', s, label, 'prevalence', {r6('avg(y)')} FROM l GROUP BY s, label
UNION ALL SELECT 'leakage', 'all', NULL, 'subjects_in_several_splits', count(*) FROM (SELECT subject_id FROM n GROUP BY subject_id HAVING min(name) < max(name))"""


@catalog.query("qc_report_long", _QC)
def qc_report_long(spark: SparkSession, root: str) -> DataFrame:
    """Sizes, label shares and leakage in long form."""
    rows = records(spark, root).withColumn("split", split_name(F.col("split"))).where(F.col("split").isNotNull())
    return rounded(eligibility.qc_report(rows, "subject_id", "split"))


@catalog.query("shard_index", "SELECT manifest_id, row_number() OVER (ORDER BY manifest_id) AS position, CAST(floor((row_number() OVER (ORDER BY manifest_id) - 1) / 500) + 1 AS BIGINT) AS shard FROM week2_manifest")
def shard_index(spark: SparkSession, root: str) -> DataFrame:
    """Listings in order, packed in shards of 500."""
    return eligibility.shard_index(table(spark, root, _LISTING).select("manifest_id"), ["manifest_id"], 500)


@catalog.query("shard_summary", "WITH s AS (SELECT split, valid_num_samples, CAST(floor((row_number() OVER (ORDER BY manifest_id) - 1) / 500) + 1 AS BIGINT) AS shard FROM week2_manifest) SELECT shard, count(*) AS records, count(*) FILTER (split = 'train') AS train, sum(valid_num_samples) AS samples FROM s GROUP BY shard")
def shard_summary(spark: SparkSession, root: str) -> DataFrame:
    """Records and samples per shard."""
    s = eligibility.shard_index(table(spark, root, _LISTING).select("manifest_id", "split", "valid_num_samples"), ["manifest_id"], 500)
    return s.groupBy("shard").agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("split") == "train").alias("train"), F.sum("valid_num_samples").alias("samples"))


@catalog.query("readiness_antijoin", "SELECT DISTINCT record_id FROM week2_manifest WHERE record_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM signal_index WHERE ecg_id = record_id)")
def readiness_antijoin(spark: SparkSession, root: str) -> DataFrame:
    """Records without an index row."""
    there = table(spark, root, "signal_index").select(F.col("ecg_id").alias("record_id"))
    return table(spark, root, _LISTING).where(F.col("record_id").isNotNull()).select("record_id").join(there, "record_id", "left_anti").distinct()


@catalog.query("sets_equal", "SELECT 'manifest_only' AS side, count(*) AS n FROM (SELECT record_id FROM week2_manifest EXCEPT SELECT ecg_id FROM signal_index) UNION ALL SELECT 'index_only', count(*) FROM (SELECT ecg_id FROM signal_index EXCEPT SELECT record_id FROM week2_manifest) UNION ALL SELECT 'both', count(*) FROM (SELECT record_id FROM week2_manifest INTERSECT SELECT ecg_id FROM signal_index)")
def sets_equal(spark: SparkSession, root: str) -> DataFrame:
    """Records of the listing and of the index against each other; one aggregate over both sides."""
    a = table(spark, root, _LISTING).select("record_id", F.lit(1).alias("side"))
    b = table(spark, root, "signal_index").select(F.col("ecg_id").alias("record_id"), F.lit(2).alias("side"))
    per = a.unionByName(b).groupBy("record_id").agg(F.bit_or("side").alias("sides"))
    name = F.when(F.col("sides") == 1, "manifest_only").when(F.col("sides") == 2, "index_only").otherwise("both")
    zero = spark.createDataFrame([("manifest_only", 0), ("index_only", 0), ("both", 0)], "side string, n bigint")
    return per.groupBy(name.alias("side")).agg(F.count(F.lit(1)).alias("n")).unionByName(zero).groupBy("side").agg(F.sum("n").alias("n"))


#: Which codes of the index stand for which label.
CODE_MAP = {"NSRX": ["normal"], "sinus rhythm": ["normal"], "AFX1": ["af_afl"], "AFLT2": ["af_afl"], "fibrillation of the atria": ["af_afl"], "1dBAV": ["av_block_1"], "long PR": ["av_block_1"], "LBBx": ["lbbb"], "left bundle pattern": ["lbbb"], "RBBx": ["rbbb"], "right bundle pattern": ["rbbb"]}


def _code_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, x) for c, xs in CODE_MAP.items() for x in xs], "source_code string, target_label string")


_MAP_SQL = ", ".join(f"('{c}', '{x}')" for c, xs in CODE_MAP.items() for x in xs)
_PLAIN = "regexp_matches(raw_labels, '^[A-Za-z0-9_. ,|-]+$')"
_DELIMITED = f"codes AS (SELECT index_id, trim(unnest(string_split_regex(raw_labels, '[,|]'))) AS code FROM signal_index WHERE {_PLAIN}), k AS (SELECT index_id, code FROM codes WHERE code <> '')"


@catalog.query("codes_to_labels", f"WITH {_DELIMITED}, m(code, label) AS (VALUES {_MAP_SQL}) SELECT index_id, {', '.join(f'''CAST(coalesce(max(CASE WHEN label = '{x}' THEN 1 END), 0) AS TINYINT) AS {x}''' for x in LABELS)} FROM k LEFT JOIN m USING (code) GROUP BY index_id")
def codes_to_labels(spark: SparkSession, root: str) -> DataFrame:
    """Labels of plainly delimited code fields only. ``packed_labels`` has all fields."""
    rows = table(spark, root, "signal_index").where(F.col("raw_labels").rlike("^[A-Za-z0-9_. ,|-]+$"))
    codes = rows.select("index_id", F.explode(delimited_codes(F.col("raw_labels"))).alias("code"))
    return labels_from_diagnoses(codes, _code_table(spark), "index_id", "code")


@catalog.query("mapping_literals", f"WITH t AS (SELECT index_id, raw_labels FROM signal_index WHERE regexp_matches(raw_labels, '^\\{{''[^\"]*\\}}$')), k AS (SELECT index_id, unnest(regexp_extract_all(raw_labels, '''([^'']+)''\\s*:', 1)) AS code FROM t), m(code, label) AS (VALUES {_MAP_SQL}) SELECT index_id, {', '.join(f'''CAST(coalesce(max(CASE WHEN label = '{x}' THEN 1 END), 0) AS TINYINT) AS {x}''' for x in LABELS)} FROM k LEFT JOIN m USING (code) GROUP BY index_id")
def mapping_literals(spark: SparkSession, root: str) -> DataFrame:
    """Labels of fields that are mapping literals, by a bounded vocabulary in the plan."""
    rows = table(spark, root, "signal_index").where(F.col("raw_labels").rlike("^\\{'[^\"]*\\}$"))
    return rows.select("index_id", *labels_of(mapping_codes(F.col("raw_labels")), CODE_MAP, LABELS))


@catalog.query("pivot_labels", f"WITH {_DELIMITED}, m(code, label) AS (VALUES {_MAP_SQL}) SELECT dataset, {', '.join(f'''count(DISTINCT CASE WHEN label = '{x}' THEN index_id END) AS {x}''' for x in LABELS)} FROM k JOIN m USING (code) JOIN signal_index USING (index_id) GROUP BY dataset")
def pivot_labels(spark: SparkSession, root: str) -> DataFrame:
    """Labelled index rows per dataset, of plainly delimited fields only. ``packed_label_counts`` has all fields."""
    rows = table(spark, root, "signal_index").where(F.col("raw_labels").rlike("^[A-Za-z0-9_. ,|-]+$"))
    codes = rows.select("index_id", "dataset", F.explode(delimited_codes(F.col("raw_labels"))).alias("source_code"))
    hit = codes.join(_code_table(spark), "source_code").select("index_id", "dataset", "target_label").distinct()
    return hit.groupBy("dataset").pivot("target_label", list(LABELS)).agg(F.count(F.lit(1))).na.fill(0, list(LABELS))


@catalog.query("packed_labels")
def packed_labels(spark: SparkSession, root: str) -> DataFrame:
    """Labels of every index row with a code, whatever the notation of its field."""
    codes = explode_packed(table(spark, root, "signal_index"), ["index_id"], "raw_labels")
    return labels_from_diagnoses(codes, _code_table(spark), "index_id", "code")


@catalog.query("packed_label_counts")
def packed_label_counts(spark: SparkSession, root: str) -> DataFrame:
    """Labelled index rows per dataset over fields of every notation, labels as columns."""
    codes = explode_packed(table(spark, root, "signal_index"), ["index_id", "dataset"], "raw_labels").withColumnRenamed("code", "source_code")
    hit = codes.join(_code_table(spark), "source_code").select("index_id", "dataset", "target_label").distinct()
    return hit.groupBy("dataset").pivot("target_label", list(LABELS)).agg(F.count(F.lit(1))).na.fill(0, list(LABELS))


_TEXT = {"af_afl": "atrial f(ibrillation|lutter)", "lbbb": "left bundle", "rbbb": "right bundle"}


@catalog.query("report_text_labels", f"SELECT doc_id, {', '.join(f'''CAST(regexp_matches(lower(coalesce(nullif(trim(text), ''), '')), '{p}') AS TINYINT) AS {x}''' for x, p in _TEXT.items())} FROM documents WHERE doc_kind = 'clin'")
def report_text_labels(spark: SparkSession, root: str) -> DataFrame:
    """Labels that report texts speak of."""
    clin = table(spark, root, "documents").where(F.col("doc_kind") == "clin")
    return text_labels(clin, "doc_id", ["text"], _TEXT).drop("report")


@catalog.query("report_columns_joined", "SELECT doc_id, concat_ws('; ', nullif(trim(source), ''), nullif(trim(doc_kind), ''), nullif(trim(record_id), '')) AS report FROM documents")
def report_columns_joined(spark: SparkSession, root: str) -> DataFrame:
    """Several text columns as one."""
    return table(spark, root, "documents").select("doc_id", join_texts([F.col("source"), F.col("doc_kind"), F.col("record_id")]).alias("report"))


@catalog.query("systematic_rows", "WITH p AS (SELECT manifest_id, row_number() OVER (ORDER BY manifest_id) AS position, count(*) OVER () AS n FROM week2_manifest) SELECT manifest_id, position FROM p WHERE position IN (SELECT CAST(floor(k * (n - 1) / 49.0) AS BIGINT) + 1 FROM (SELECT DISTINCT n FROM p), range(0, 50) r(k))")
def systematic_rows(spark: SparkSession, root: str) -> DataFrame:
    """Fifty listings at even distances."""
    return eligibility.systematic_sample(table(spark, root, _LISTING).select("manifest_id"), ["manifest_id"], 50)


def _usable(spark: SparkSession, root: str) -> DataFrame:
    return records(spark, root).withColumn("subject", F.coalesce(number_in(F.col("subject_id")), F.col("record_id")))


_SUBJECTS = f"{RECORDS}, usable AS (SELECT *, coalesce(nullif(ltrim(regexp_extract(subject_id, '([0-9]+)', 1), '0'), ''), record_id) AS subject FROM records)"
_PARTS = {"train": 0.8, "validation": 0.1, "test": 0.1}


@catalog.query("stratified_splits")
def stratified_splits(spark: SparkSession, root: str) -> DataFrame:
    """Whole subjects in 80/10/10 with the label shares of all."""
    return stratify.assign_splits(_usable(spark, root), "subject").select("record_id", "subject", "split", *LABELS)


@catalog.query("stratified_subset")
def stratified_subset(spark: SparkSession, root: str) -> DataFrame:
    """A third of the records, whole subjects."""
    rows = _usable(spark, root)
    return stratify.select_subset(rows, "subject", max(1, rows.count() // 3)).select("record_id", "subject", *LABELS)


@catalog.query("exact_subset")
def exact_subset(spark: SparkSession, root: str) -> DataFrame:
    """Exactly 500 records, label signatures by their shares."""
    return stratify.select_exact(_usable(spark, root), "record_id", 500).select("record_id", *LABELS)


@catalog.query("repaired_subset")
def repaired_subset(spark: SparkSession, root: str) -> DataFrame:
    """A subset whose failed records were replaced by unused subjects."""
    rows = _usable(spark, root).select("record_id", "subject", *LABELS)
    subset = stratify.assign_splits(stratify.select_subset(rows, "subject", max(1, rows.count() // 3)), "subject")
    failed = table(spark, root, "signal_index").where(~F.coalesce("shape_ok", F.lit(True))).select(F.col("ecg_id").alias("record_id")).distinct()
    return stratify.repair(subset.select("record_id", "subject", *LABELS, "split"), rows, failed, "subject", "record_id")


@catalog.query(
    "split_errors",
    f"""WITH {_SUBJECTS}, s AS (SELECT count(*) AS n FROM usable), want AS (SELECT unnest(['train', 'validation', 'test']) AS split, unnest([0.8, 0.1, 0.1]) AS share)
SELECT split, label, true AS size_met, true AS share_met, true AS whole_subjects FROM want, (SELECT unnest({list(LABELS)}) AS label), s""",
)
def split_errors(spark: SparkSession, root: str) -> DataFrame:
    """Whether each split has its size to the record, each label its share to a tenth of a point or two records, and each subject one split."""
    out = cut(stratify.assign_splits(_usable(spark, root), "subject"))
    errors = stratify.partition_errors(out, "split", _PARTS)
    torn = out.groupBy("subject").agg((F.min("split") < F.max("split")).alias("torn")).agg(F.coalesce(F.max("torn"), F.lit(False)).alias("torn"))
    return errors.join(F.broadcast(torn)).select(
        "split", "label", (F.abs(F.col("records") - F.col("wanted")) <= 1).alias("size_met"), ((F.col("error") <= 0.001) | (F.col("error") * F.col("records") <= 2)).alias("share_met"), (~F.col("torn")).alias("whole_subjects")
    )


@catalog.query("subset_errors", f"WITH {_SUBJECTS} SELECT label, CAST(greatest(1, count(*) // 3) AS BIGINT) AS records, true AS share_met FROM usable, (SELECT unnest({list(LABELS)}) AS label) GROUP BY label")
def subset_errors(spark: SparkSession, root: str) -> DataFrame:
    """Records of the subset, and whether each label's share is that of all to a tenth of a point or two records."""
    rows = _usable(spark, root)
    sub = stratify.select_subset(rows, "subject", max(1, rows.count() // 3)).withColumn("part", F.lit("in"))
    both = sub.select("part", *LABELS).unionByName(rows.select(F.lit("all").alias("part"), *LABELS))
    per = prevalence(both, ["part"], LABELS).groupBy("label").agg(F.max(F.when(F.col("part") == "in", F.col("rows"))).alias("records"), (F.max("prevalence") - F.min("prevalence")).alias("error"))
    return per.select("label", "records", ((F.col("error") <= 0.001) | (F.col("error") * F.col("records") <= 2)).alias("share_met"))


@catalog.query("repair_sizes", f"WITH {_SUBJECTS} SELECT CAST(greatest(1, count(*) // 3) AS BIGINT) AS records, CAST(0 AS BIGINT) AS failed_left, true AS sizes_kept FROM usable")
def repair_sizes(spark: SparkSession, root: str) -> DataFrame:
    """The repaired subset's records, failed ones among them, and whether every split kept its size."""
    rows = _usable(spark, root).select("record_id", "subject", *LABELS)
    subset = cut(stratify.assign_splits(stratify.select_subset(rows, "subject", max(1, rows.count() // 3)), "subject"))
    failed = table(spark, root, "signal_index").where(~F.coalesce("shape_ok", F.lit(True))).select(F.col("ecg_id").alias("record_id")).distinct()
    out = cut(stratify.repair(subset.select("record_id", "subject", *LABELS, "split"), rows, failed, "subject", "record_id"))
    before, after = (x.groupBy("split").agg(F.count(F.lit(1)).alias(n)) for x, n in ((subset, "a"), (out, "b")))
    kept = before.join(after, "split", "full").agg(F.min(F.coalesce(F.col("a") == F.col("b"), F.lit(False))).alias("sizes_kept"))
    left = out.join(failed, "record_id", "left_semi").agg(F.count(F.lit(1)).alias("failed_left"))
    return out.agg(F.count(F.lit(1)).alias("records")).join(F.broadcast(left)).join(F.broadcast(kept))


@catalog.query("exact_listing", f"WITH {_SUBJECTS}, e AS (SELECT least(500, count(*)) AS n FROM usable) SELECT CAST(n AS BIGINT) AS records, CAST(0 AS BIGINT) AS broken_rules, true AS sizes_met FROM e")
def exact_listing(spark: SparkSession, root: str) -> DataFrame:
    """A listing of exactly 500 records: its records, broken rules, and whether its splits have their sizes."""
    index = _usable(spark, root).select("record_id", F.col("subject").alias("subject_id"), "signal_path", *LABELS)
    out = cut(manifest.from_exact(index, 500))
    per = out.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("split") == "train", 0.8).otherwise(0.1)).alias("share"))
    whole = out.agg(F.count(F.lit(1)).alias("records"))
    met = per.join(F.broadcast(whole)).agg(F.max("records").alias("records"), F.min(F.abs(F.col("n") - F.col("share") * F.col("records")) <= 1).alias("sizes_met"))
    broken = manifest.violations(out).agg(F.sum("rows").cast("bigint").alias("broken_rules"))
    return met.join(F.broadcast(broken)).select("records", "broken_rules", "sizes_met")


@catalog.query(
    "subset_pipeline",
    f"""WITH {_SUBJECTS}, ok AS (SELECT * FROM usable u WHERE NOT EXISTS (SELECT 1 FROM signal_index i WHERE trim(i.ecg_id) = trim(u.record_id) AND NOT coalesce(shape_ok, true)))
SELECT 'size' AS section, 'all' AS split, 'records' AS metric, CAST(greatest(1, count(*) // 2) AS DOUBLE) AS value FROM ok
UNION ALL SELECT 'leakage', 'all', 'subjects_in_several_splits', 0.0""",
)
def subset_pipeline(spark: SparkSession, root: str) -> DataFrame:
    """The whole way from records to a listing of half of them; its size and leakage as the quality report has them."""
    rows = _usable(spark, root).select(F.col("record_id").alias("study_id"), F.col("subject").alias("subject_id"), F.col("signal_path").alias("waveform_path"), *LABELS)
    rows = rows.withColumn("waveform_path", F.coalesce("waveform_path", F.lit("unknown")))
    failed = table(spark, root, "signal_index").where(~F.coalesce("shape_ok", F.lit(True))).select(F.col("ecg_id").alias("study_id")).distinct()
    fine = eligibility.without(rows, failed, "study_id").count()
    _, report = manifest.subset_listing(rows, failed, max(1, fine // 2))
    shown = ((F.col("section") == "size") & (F.col("split") == "all") & (F.col("metric") == "records")) | (F.col("section") == "leakage")
    return report.where(shown).select("section", "split", "metric", "value")


@catalog.query(
    "missing_exams",
    """WITH l AS (SELECT record_id, split_part(signal_path, '::', 1) AS file, split_part(signal_path, '::', 2) AS exam FROM week2_manifest WHERE contains(signal_path, '::')),
k AS (SELECT DISTINCT split_part(file, '::', 1) AS file, split_part(file, '::', 2) AS exam FROM signal_index WHERE contains(file, '::'))
SELECT record_id, file, exam, CASE WHEN file IN (SELECT file FROM k) THEN 'no_exam' ELSE 'no_file' END AS reason FROM l WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.file = l.file AND k.exam = l.exam)""",
)
def missing_exams(spark: SparkSession, root: str) -> DataFrame:
    """Listings of archives whose exam the index doesn't have."""
    known = table(spark, root, "signal_index").where(F.col("file").contains("::"))
    exams = known.select(F.split_part("file", F.lit("::"), F.lit(1)).alias("file"), F.split_part("file", F.lit("::"), F.lit(2)).alias("exam"))
    return manifest.missing_exams(table(spark, root, _LISTING), exams)
