import random

import pytest
from pyspark.sql import functions as F

from heartlake.functions.names import DATASETS, LABELS
from heartlake.operators.checks import TableError
from heartlake.plans import analysis, bootstrap, eligibility, labels, manifest, matrix, shifts, stratify

DEMOGRAPHICS = [
    ("PTB-XL", 3948, 13262, 4298, 11356, 10445, 500, "Schiller devices", 1, "SCP-ECG"),
    ("MIMIC-IV-ECG", 106386, 445507, 243652, 389334, 406211, 500, "undisclosed", 0, "machine-report text"),
    ("CPSC2018", 1409, 3638, 1821, 3178, 3699, 500, "not documented", 0, "CPSC custom 9-class"),
    ("Georgia 12-Lead", 1668, 6677, 1922, 4793, 5551, 500, "not documented", 0, "SNOMED-CT"),
    ("CODE-15%", 123385, 159486, 62908, 206576, 139203, 400, "other devices", 1, "CODE custom binary labels"),
]
SCHEMA = "dataset string, age_0_44_count int, age_45_74_count int, age_75_plus_count int, sex_female_count int, sex_male_count int, sampling_rate_hz int, hardware_group string, hardware_documented int, label_schema string"


def subjects(spark, n=400, seed=7):
    r = random.Random(seed)
    rows, record = [], 0
    for s in range(n):
        for _ in range(r.randint(1, 5)):
            record += 1
            rows.append((str(s), f"r{record}", *[int(r.random() < p) for p in (0.58, 0.16, 0.09, 0.055, 0.075)]))
    return spark.createDataFrame(rows, "subject string, record_id string, " + ", ".join(f"{x} int" for x in LABELS)), rows


def test_shift_vectors_of_published_counts(spark):
    got = {(r.source_dataset, r.target_dataset): r for r in shifts.shift_vectors(spark.createDataFrame(DEMOGRAPHICS, SCHEMA)).collect()}
    assert len(got) == 20
    for pair, age, sex in ((("PTB-XL", "MIMIC-IV-ECG"), 0.032186, 0.001985), (("PTB-XL", "CPSC2018"), 0.016754, 0.006922), (("PTB-XL", "Georgia 12-Lead"), 0.002617, 0.006632)):
        assert (round(got[pair].age_kl_nats, 6), round(got[pair].sex_kl_nats, 6), got[pair].shift_vector, got[pair].weight_w_ij) == (age, sex, "(0,0,1)", 3)
    vectors = [r.shift_vector for r in got.values()]
    assert {v: vectors.count(v) for v in set(vectors)} == {"(0,0,1)": 12, "(0,1,1)": 3, "(1,1,1)": 5}
    assert shifts.formatted(shifts.shift_vectors(spark.createDataFrame(DEMOGRAPHICS, SCHEMA))).first().ps_threshold_nats == "0.10"
    with pytest.raises(TableError):
        shifts.check_datasets(spark.createDataFrame(DEMOGRAPHICS[:4], SCHEMA), [d[0] for d in DEMOGRAPHICS])


def grid(spark, f, names=("aa", "bb"), models=("m",)):
    return spark.createDataFrame([(a, s, t, f(a, s, t)) for a in models for s in names for t in names], "architecture string, source_dataset string, target_dataset string, macro_auroc double")


def test_composite_by_hand(spark):
    cells = grid(spark, lambda a, s, t: {"aaaa": 0.9, "aabb": 0.7, "bbaa": 0.6, "bbbb": 0.8}[s + t])
    sh = spark.createDataFrame([("aa", "bb", 1, 0, 0), ("bb", "aa", 0, 1, 1)], "source_dataset string, target_dataset string, PS int, DS int, LS int")
    off = analysis.gaps_and_shifts(cells, sh)
    assert sorted((round(r.delta_ij, 9), r.w_ij) for r in off.collect()) == [(0.2, 1.0), (0.2, 5.0)]
    assert analysis.composite_scores(off).first().composite_score == pytest.approx(0.65 * (1 - (0.1 + 0.2 / 6) / 2))
    parts = analysis.attribution(off).collect()
    assert sum(r.allocated_gap_share for r in parts) == pytest.approx(1) and sum(r.allocated_gap_total for r in parts) == pytest.approx(0.4)
    sweep = analysis.weight_sweep(off).collect()
    assert len(sweep) == 64 and all(0 <= r.composite_score <= 1 for r in sweep)
    with pytest.raises(TableError):
        analysis.gaps_and_shifts(cells, sh.limit(1))
    with pytest.raises(TableError):
        analysis.gaps_and_shifts(cells.union(cells), sh)
    with pytest.raises(ValueError):
        analysis.composite_scores(off, (-1, 0, 0))


def test_matrices_hide_nothing(spark):
    cells = grid(spark, lambda a, s, t: None if s == "aa" else 0.5)
    wanted = matrix.grid(spark, ["m", "n"], ["aa", "bb"])
    out = matrix.with_blocked(cells, wanted)
    assert {r.status for r in out.where("architecture = 'n'").collect()} == {"NOT_RUN"} and out.count() == 8
    with pytest.raises(TableError, match="missing"):
        matrix.read_matrices({"m": cells.drop("architecture").limit(3)}, ["aa", "bb"])
    assert matrix.read_matrices({"m": cells.drop("architecture")}, ["aa", "bb"]).count() == 4
    old = spark.createDataFrame([("r", 5), ("s", 9)], "name string, modified_at int")
    assert [r.name for r in matrix.stale(old, spark.createDataFrame([("i", 7)], "name string, modified_at int")).collect()] == ["r"]


def test_splits_keep_subjects_and_shares(spark):
    df, rows = subjects(spark)
    out = stratify.assign_splits(df, "subject").collect()
    again = {(r.record_id, r.split) for r in stratify.assign_splits(df.repartition(5), "subject").collect()}
    assert {(r.record_id, r.split) for r in out} == again and len(out) == len(rows)
    by_subject = {}
    for r in out:
        by_subject.setdefault(r.subject, set()).add(r.split)
    assert all(len(s) == 1 for s in by_subject.values())
    size = {s: sum(r.split == s for r in out) for s in ("train", "validation", "test")}
    assert abs(size["train"] / len(out) - 0.8) < 0.03 and abs(size["test"] / len(out) - 0.1) < 0.03
    for x in LABELS:
        whole = sum(r[x] for r in out) / len(out)
        for s in size:
            assert abs(sum(r[x] for r in out if r.split == s) / size[s] - whole) < 0.08


def test_subsets(spark):
    df, rows = subjects(spark)
    sub = stratify.select_subset(df, "subject", 400).collect()
    assert abs(len(sub) - 400) < 40
    subjects_in = {r.subject for r in sub}
    assert sum(r[0] in subjects_in for r in rows) == len(sub)
    assert stratify.select_subset(df, "subject", 10**6).count() == len(rows)
    exact = stratify.select_exact(df, "record_id", 333).collect()
    assert len(exact) == 333 == len({r.record_id for r in exact})
    assert stratify.select_exact(df.limit(5), "record_id", 333).count() == 5
    with pytest.raises(ValueError):
        stratify.select_subset(df, "subject", 0)
    with pytest.raises(ValueError):
        stratify.partition_subjects(df, "subject", {"a": 0.5, "b": 0.4})


def test_subsets_and_splits_meet_their_sizes(spark):
    df, rows = subjects(spark)
    for target in (3, 400):
        sub = stratify.select_subset(df, "subject", target).collect()
        assert len(sub) == target
        assert sum(r[0] in {x.subject for x in sub} for r in rows) == target  # whole subjects
    out = stratify.assign_splits(df, "subject")
    size = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    assert all(abs(size[k] - v * len(rows)) <= 1 for k, v in {"train": 0.8, "validation": 0.1, "test": 0.1}.items()) and sum(size.values()) == len(rows)
    errors = stratify.partition_errors(out, "split", {"train": 0.8, "validation": 0.1, "test": 0.1}).collect()
    assert len(errors) == 3 * len(LABELS) and all(e.error * e.records <= 2 for e in errors)
    wanted = [0.5, 0.2, 0.2, 0.1, 0.1]
    sub = stratify.select_subset(df, "subject", 60, prevalence=wanted).collect()
    plain = stratify.select_subset(df, "subject", 60).collect()
    off = lambda found: sum(abs(sum(r[x] for r in found) / 60 - w) for x, w in zip(LABELS, wanted))
    assert len(sub) == 60 and off(sub) < off(plain)


def test_moves_on_counts():
    import numpy as np

    from heartlake.plans.refine import Tally

    kinds = np.array([[1, 0], [1, 1], [2, 1], [5, 0]])
    t = Tally(["a", "b"], kinds, np.array([[0, 0, 0, 1], [9, 9, 9, 0]]), np.array([[2, 0], [-2, 0]]))
    t.fit_sizes()  # the five go, three single ones or fewer larger come back
    assert t.over[:, 0].tolist() == [0, 0] and t.counts[1, 3] == 1 and t.counts[0] @ kinds[:, 0] == 3
    t = Tally(["a", "b"], kinds, np.array([[5, 0, 0, 0], [0, 5, 0, 0]]), np.array([[0, -3], [0, 3]]))
    t.fit_labels()
    assert t.over.tolist() == [[0, 0], [0, 0]] and sorted(t.net()) == [("a", "b", 0, 3), ("b", "a", 1, 3)]
    t = Tally(["a", "b"], kinds, np.array([[0, 0, 0, 1], [0, 0, 0, 3]]), np.array([[2, 0], [-2, 0]]))
    t.fit_sizes()
    assert t.net() == []  # nothing comes closer


def test_repair_keeps_sizes_or_raises(spark):
    df, _ = subjects(spark)
    start = stratify.assign_splits(stratify.select_subset(df, "subject", 500), "subject").select("record_id", "subject", *LABELS, "split")
    failed = start.where(F.crc32("record_id") % 9 == 0).select("record_id")
    out = stratify.repair(start, df, failed, "subject", "record_id")
    count = lambda x: {r.split: r["count"] for r in x.groupBy("split").count().collect()}
    assert failed.count() > 20 and count(out) == count(start) and out.join(failed, "record_id", "left_semi").count() == 0
    with pytest.raises(TableError, match="needs"):
        stratify.repair(start, start.drop("split"), failed, "subject", "record_id")


def test_repair_fills_up(spark):
    df, _ = subjects(spark)
    start = stratify.assign_splits(stratify.select_subset(df, "subject", 500), "subject").select("record_id", "subject", *LABELS, "split")
    failed = start.groupBy("split").agg(F.min("record_id").alias("record_id")).select("record_id")
    out = stratify.repair(start, df, failed, "subject", "record_id")
    assert out.join(failed, "record_id", "left_semi").count() == 0 and abs(out.count() - start.count()) <= 15
    assert out.groupBy("subject").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0


def test_eligibility(spark):
    rows = [("1", "s1", "p1", 1, 0, 0, 0, 0), ("1", "s2", " ", 1, 0, 0, 0, 0), ("1", "s3", "p3", None, 0, 0, 0, 0), (None, "s4", "p4", 1, 0, 0, 0, 0), ("2", "s5", "p5", 0, 0, 0, 0, 0), ("2", "s5", "p5", 0, 0, 0, 0, 0)]
    df = spark.createDataFrame(rows, "subject_id string, study_id string, waveform_path string, " + ", ".join(f"{x} int" for x in LABELS))
    assert {r.study_id for r in eligibility.eligible(df).collect()} == {"s1", "s5"}
    counts = {r.reason: r.rows for r in eligibility.cascade_counts(df).collect()}
    assert counts == {"missing_path": 1, "incomplete_labels": 1, "missing_id": 1, "eligible": 2, "duplicate_study": 1}
    clash = df.union(spark.createDataFrame([("2", "s5", "other", 0, 0, 0, 0, 0)], df.schema))
    with pytest.raises(TableError, match="conflicting"):
        eligibility.eligible(clash)
    assert {r.study_id for r in eligibility.without(df, spark.createDataFrame([(" s1 ",)], "study_id string"), "study_id").collect()} == {"s2", "s3", "s4", "s5"}


def test_positions_and_samples(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    got = eligibility.shard_index(df, ["k"], 300).collect()
    assert all(r.position == r.k + 1 and r.shard == r.k // 300 + 1 for r in got) and len(got) == 1000
    assert sorted(r.k for r in eligibility.systematic_sample(df, ["k"], 5).collect()) == [0, 249, 499, 749, 999]


def test_labels(spark):
    codes = spark.createDataFrame([(1, "N"), (1, "AF"), (2, "R"), (3, "?"), (4, " "), (4, None)], "study_id int, code string")
    m = spark.createDataFrame([("N", "normal", "v1"), ("AF", "af_afl", "v1"), ("R", "rbbb", "v1")], "source_code string, target_label string, mapping_version string")
    got = {r.study_id: (r.normal, r.af_afl, r.rbbb) for r in labels.labels_from_diagnoses(codes, m, "study_id", "code").collect()}
    assert got == {1: (1, 1, 0), 2: (0, 0, 1), 3: (0, 0, 0)}
    assert labels.load_code_map(m) == ({"N": ["normal"], "AF": ["af_afl"], "R": ["rbbb"]}, "v1")
    with pytest.raises(TableError, match="version"):
        labels.load_code_map(m.union(spark.createDataFrame([("Z", "lbbb", "v2")], m.schema)))
    meta = spark.createDataFrame([(1, "x"), (2, "y"), (4, "z")], "study_id int, path string")
    wide = labels.prepare_labels(meta, "study_id", label_table=codes, code_map=m, code="code").orderBy("study_id").collect()
    assert [(r.normal, r.rbbb) for r in wide] == [(1, 0), (0, 1), (None, None)]
    own = spark.createDataFrame([(1, *["yes"] * 5), (2, *["0"] * 4, "perhaps")], "study_id int, " + ", ".join(f"{x} string" for x in LABELS))
    with pytest.raises(TableError):
        labels.prepare_labels(own, "study_id")
    assert labels.prepare_labels(own.limit(1), "study_id").first().rbbb == 1
    with pytest.raises(ValueError):
        labels.collapse_probability("mean", F.lit(0), [F.lit(1)])
    rows = spark.createDataFrame([(1, 0, 0, 0, 0), (1, 1, 0, 0, 0), (0, 0, 0, 0, 0)], ", ".join(f"{x} int" for x in LABELS))
    assert [r.abnormal for r in labels.binary_manifest(rows).collect()] == [0, 1]


def canonical(spark, **change):
    rows = []
    for i, s in enumerate(["train"] * 2 + ["validation"] * 2 + ["test"] * 2):
        row = {"dataset": "d", "record_id": f"r{i}", "subject_id": f"s{i}", "split": s, "signal_path": f"a/{i}.npy", "storage": "npy", **{x: i % 2 for x in LABELS}, "valid_num_samples": 5000, "mapping_version": "v", "split_version": "w", "more": 1}
        rows.append(row | (change if i == 3 else {}))
    kinds = {"valid_num_samples": "int", "more": "int"} | {x: "int" for x in LABELS}
    return spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{c} {kinds.get(c, 'string')}" for c in rows[0]))


@pytest.mark.parametrize("change", [{"record_id": " "}, {"record_id": "r0"}, {"subject_id": "s0"}, {"split": "dev"}, {"normal": 2}, {"normal": 0}, {"valid_num_samples": 4000}, {"signal_path": "../x"}])
def test_listing_rules(spark, change):
    assert manifest.validate(canonical(spark)).columns[:4] == list(manifest.KEYS)
    with pytest.raises(TableError):
        manifest.validate(canonical(spark, **change)).count()


def test_listing_builders(spark):
    index = spark.createDataFrame([(i, "{'NORM': 100.0}" if i % 2 else "{'X': 0.0}") for i in range(1, 21)], "ecg_id int, raw_labels string")
    base = spark.createDataFrame([(i, f"p{i}", (i - 1) % 10 + 1) for i in range(1, 21)], "ecg_id int, patient_id string, strat_fold int")
    from heartlake.functions.codes import mapping_codes

    got = manifest.from_folds(index, base, mapping_codes(F.col("raw_labels")), {"NORM": ["normal"]})
    assert {r.record_id: r.split for r in got.collect() if r.split != "train"} == {"9": "validation", "19": "validation", "10": "test", "20": "test"}
    with pytest.raises(TableError):
        manifest.from_folds(index, base.limit(5), mapping_codes(F.col("raw_labels")), {})
    by_record = manifest.from_records(index, mapping_codes(F.col("raw_labels")), {"NORM": ["normal"]}, "cpsc2018", F.lit("x.npy"))
    assert by_record.count() == 20 and by_record.where("subject_id <> record_id").count() == 0
    moved = got.withColumn("signal_path", F.lit("new"))
    assert manifest.only_paths_changed(got, moved) and not manifest.only_paths_changed(got, got.withColumn("normal", F.lit(1)))


def test_bootstrap(spark):
    perfect = [("c", f"r{i:02d}", x, i % 2, 0.9 if i % 2 else 0.1) for i in range(20) for x in ("u", "v")]
    ci = bootstrap.record_intervals(spark.createDataFrame(perfect, "cell string, record_id string, label string, y int, p double"), ["cell"], replicates=30).collect()
    assert {r.metric for r in ci} == {"u", "v", "macro"} and all(r.ci_low == r.ci_high == 1 for r in ci)
    cells = grid(spark, lambda a, s, t: 0.9 if s == t else 0.6 + 0.01 * len(t), DATASETS)
    g = bootstrap.gap_interval(cells, ["architecture"], "macro_auroc", 200).first()
    assert 0 < g.ci_low <= g.ci_high < 0.3


def test_null_threshold_is_small_for_one_population(spark):
    df = spark.range(4000).select("id", (F.pmod(F.xxhash64("id"), F.lit(100))).cast("double").alias("age"))
    t = shifts.null_threshold(df, "id", "age", replicates=40).first().threshold
    assert 0 < t < 0.05
