import io
import lzma
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from heartlake.plans import filters, overlap, signals
from heartlake.sources import predictions as pred
from heartlake.sources import signals as src
from heartlake.sources import tables
from heartlake.streaming import readings as live


def sines(rate, seconds=10):
    t = np.arange(int(rate * seconds)) / rate
    return np.stack([0.1 * (i + 1) * np.sin(2 * np.pi * (1 + i / 20 * 2) * t) for i in range(12)])


def test_form_from_shuffled_transposed_microvolts():
    order = np.random.default_rng(1).permutation(12)
    x = sines(250)
    got = signals.in_form((x[order] * 1000).T, 250, [signals.LEADS[i].lower() for i in order], "uV")
    assert got.dtype == np.float32 and got.shape == (12, 5000)
    np.testing.assert_allclose(got, sines(500), atol=2e-4)
    assert signals.quality(got)["passed"]


def test_form_pads_cuts_and_refuses():
    short = signals.in_form(sines(500, 5), 500, signals.LEADS, "mV")
    assert not short[:, 2500:].any() and signals.in_form(sines(500, 12), 500, signals.LEADS, ["mV"] * 12).shape == (12, 5000)
    for bad in (dict(leads=["I"] * 12), dict(units="bar"), dict(rate=0), dict(signal=np.zeros((12, 12))), dict(units=["mV"])):
        kw = {"signal": sines(500), "rate": 500, "leads": signals.LEADS, "units": "mV"} | bad
        with pytest.raises(ValueError):
            signals.in_form(kw["signal"], kw["rate"], kw["leads"], kw["units"])


@pytest.mark.parametrize("m,n", [(500, 200), (200, 500), (9, 5), (10, 4), (7, 7), (8, 16)])
def test_resampling_keeps_slow_sines(m, n):
    k = 1
    a = np.sin(2 * np.pi * k * np.arange(m) / m)[None]
    np.testing.assert_allclose(signals.fourier_resample(a, n), np.sin(2 * np.pi * k * np.arange(n) / n)[None], atol=1e-12)


def test_quality_flags():
    x = sines(500).astype(np.float32)
    one_flat = x.copy()
    one_flat[3] = 0
    q = signals.quality(one_flat)
    assert q["passed"] and not q["no_flat_leads"]
    assert not signals.quality(np.zeros((12, 5000), np.float32))["passed"] and not signals.quality(x * 1000)["passed"] and not signals.quality(x.astype(float))["passed"]
    bad = x.copy()
    bad[0, 0] = np.nan
    assert not signals.quality(bad)["finite_ok"]


def test_fingerprints_and_similarity():
    rng = np.random.default_rng(0)
    a = np.cumsum(rng.normal(size=(12, 2500)), axis=1)
    corr, err, lag = signals.similarity(a, a * 1.02 + 0.03)
    assert corr > 0.999 and err < 0.01 and lag == 0
    assert signals.similarity(a, np.roll(a, 25, axis=1))[2] == 5
    assert signals.fingerprint(a) @ signals.fingerprint(a * 3 + 1) == pytest.approx(1, abs=1e-5) and signals.fingerprint(a).shape == (768,)
    whole = np.round(a, 3)
    assert signals.window_hash(whole) == signals.window_hash(whole + 1e-4) != signals.window_hash(whole + 0.01)
    with pytest.raises(ValueError):
        signals.fingerprint(np.ones((12, 2500)))
    assert np.isnan(signals.similarity(np.ones((12, 2500)), a)[0])
    w = signals.model_windows(np.concatenate([sines(500, 5), np.full((12, 2500), 99999.0)], 1), 2500)
    assert w.shape == (1, 12, 2500) and np.abs(w).max() < 5


def test_audit_finds_the_planted_copy(spark):
    rng = np.random.default_rng(3)
    make = lambda: np.cumsum(rng.normal(size=(12, 5000)), axis=1).astype(np.float32) / 20
    source = {f"s{i}": make() for i in range(4)}
    target = {f"t{i}": make() for i in range(4)}
    target["t1"] = source["s2"].copy()
    target["t3"] = source["s0"] * 1.02 + 0.03
    frame = lambda d: spark.createDataFrame([(k, v.ravel().tolist(), 5000) for k, v in d.items()], "record_id string, signal array<float>, valid_num_samples int")
    win = lambda d: signals.windows(frame(d)).withColumn("window_id", F.concat_ws("#", "record_id", "window_index"))
    s, t = win(source), win(target)
    assert s.count() == 8
    cand = overlap.candidates(s, t)
    cut = {f"{k}#{i}": v[:, i * 2500 : (i + 1) * 2500] for d in (source, target) for k, v in d.items() for i in range(2)}
    rows = [(r.source_id, r.target_id, r.exact, r.candidate_cosine, cut[r.source_id].ravel().tolist(), cut[r.target_id].ravel().tolist()) for r in cand.collect()]
    pairs = spark.createDataFrame(rows, "source_id string, target_id string, exact boolean, candidate_cosine double, left array<float>, right array<float>")
    named = signals.verified(pairs).select("*", F.split_part("source_id", F.lit("#"), F.lit(1)).alias("source_record_id"), F.split_part("target_id", F.lit("#"), F.lit(1)).alias("target_record_id"), F.split_part("source_id", F.lit("#"), F.lit(2)).alias("source_window_index"), F.split_part("target_id", F.lit("#"), F.lit(2)).alias("target_window_index"))
    best = {r.target_record_id: (r.source_record_id, r.match_type) for r in overlap.best_matches(named).collect()}
    assert best == {"t1": ("s2", "exact"), "t3": ("s0", "near")}
    with pytest.raises(ValueError):
        overlap.AuditThresholds(k=0)


def test_standardised_table(spark):
    good = ("a", 500.0, list(signals.LEADS), ["mV"] * 12, sines(500).tolist())
    bad = ("b", 500.0, ["I"] * 12, ["mV"] * 12, sines(500).tolist())
    out = signals.standardized(spark.createDataFrame([good, bad], "record_id string, rate double, leads array<string>, units array<string>, samples array<array<double>>"))
    rows = {r.record_id: r for r in out.collect()}
    assert rows["a"].passed and len(rows["a"].signal) == 60000 and rows["b"].signal is None and "ValueError" in rows["b"].error
    assert rows["a"].basic_passed and not rows["a"].leads_reordered and not rows["b"].basic_passed
    assert signals.quality_totals(out).first().errors == 1
    assert signals.patterns(spark.createDataFrame([good, bad], "record_id string, rate double, leads array<string>, units array<string>, samples array<array<double>>")).count() == 2


def response(b, a, hz, rate=500.0):
    z = np.exp(-2j * np.pi * hz / rate * np.arange(max(len(a), len(b))))
    return abs((b @ z[: len(b)]) / (a @ z[: len(a)]))


def test_filters():
    b, a = filters.notch(50, 30, 500)
    assert response(b, a, 50) < 1e-9 and response(b, a, 20) == pytest.approx(1, abs=0.01) and response(b, a, 50 - 50 / 60) == pytest.approx(2**-0.5, abs=0.02)
    b, a = filters.bandpass(4, 0.67, 40, 500)
    assert len(a) == 9 and response(b, a, 0.67) == pytest.approx(2**-0.5, abs=1e-4) and response(b, a, 40) == pytest.approx(2**-0.5, abs=1e-4)
    assert response(b, a, 10) == pytest.approx(1, abs=1e-3) and response(b, a, 0.05) < 1e-3 and response(b, a, 200) < 1e-3
    t = np.arange(5000) / 500
    pure = np.sin(2 * np.pi * 8 * t)[None].repeat(12, 0)
    out = filters.both_ways(b, a, pure + 3)
    np.testing.assert_allclose(out[:, 1500:-1500], pure[:, 1500:-1500], atol=0.02)
    x = filters.cleaned(pure + 5 * np.sin(2 * np.pi * 50 * t) + 4 + 0.2 * t)
    assert x.dtype == np.float32 and abs(x.mean()) < 1e-3 and x.std() == pytest.approx(1, abs=1e-3)
    assert np.corrcoef(x[0, 500:-500], pure[0, 500:-500])[0, 1] > 0.99
    assert filters.running_median(np.array([[5.0, 1, 9, 1, 1]]), 3).tolist() == [[1, 5, 1, 1, 1]]
    for bad in (np.zeros((12, 5000)), np.zeros((3, 5000)), np.full((12, 5000), np.nan)):
        with pytest.raises(ValueError):
            filters.cleaned(bad)


HEADER = "rec 2 500/1000 4\nrec.mat 16+24 1000(10)/mV 16 0 0 0 0 I\nrec.mat 16+24 200/uV 16 5 0 0 0 II\n# Age: 61\n#Sex: Male\n#Dx: 426783006, 59118001\n"


def mat4(x):
    return struct.pack("<5i", 30, x.shape[0], x.shape[1], 0, 4) + b"val\0" + x.T.astype("<i2").tobytes()


def test_headers_and_arrays(spark, tmp_path):
    h = src.parse_header(HEADER)
    assert (h["rate"], h["baselines"], h["units"], h["age"], h["codes"]) == (500.0, [10.0, 5.0], ["mV", "uV"], "61", ["426783006", "59118001"])
    for bad in ("", "rec 3 500 4\n", HEADER.replace("1000(10)", "0")):
        with pytest.raises(ValueError):
            src.parse_header(bad)
    os.makedirs(tmp_path / "d/e")
    (tmp_path / "d/rec.hea").write_text(HEADER)
    (tmp_path / "d/rec.mat").write_bytes(mat4(np.array([[10, 1010, 10, 10], [5, 205, 5, 5]])))
    (tmp_path / "d/lone.hea").write_text(HEADER)
    rows = {r.record_id: r for r in src.read_headers(spark, str(tmp_path)).collect()}
    assert [list(x) for x in rows["rec"].samples] == [[0, 1, 0, 0], [0, 1, 0, 0]] and rows["lone"].error
    buf = io.BytesIO()
    np.save(buf, sines(500))
    (tmp_path / "d/e/x.npy").write_bytes(buf.getvalue())
    (tmp_path / "d/e/broken.npy").write_bytes(b"nothing")
    arrays = {r.record_id: r for r in src.read_arrays(spark, str(tmp_path)).collect()}
    assert len(arrays["x"].samples) == 12 and arrays["broken"].samples is None
    files = src.list_files(spark, str(tmp_path), "*.npy")
    listing = spark.createDataFrame([("x", "d/e/x.npy"), ("y", "d/e/y.npy")], "record_id string, signal_path string")
    assert [r.record_id for r in src.missing_files(listing, files, str(tmp_path)).collect()] == ["y"]
    assert src.paths_of_records(listing.where("record_id = 'x'"), files).first().path.endswith("x.npy")
    with pytest.raises(tables.TableError):
        src.paths_of_records(listing, files)
    import hashlib

    binary = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path))
    wanted = spark.createDataFrame([("x.npy", hashlib.sha256(buf.getvalue()).hexdigest()), ("gone", "0")], "name string, sha256 string")
    assert {r.name: r.ok for r in src.verify_checksums(binary, wanted).collect()} == {"x.npy": True, "gone": False}


def test_gated_readers_say_what_they_need(spark):
    listing = spark.createDataFrame([("x", "a::1")], "record_id string, signal_path string")
    for reader, package in ((src.read_records, "wfdb"), (src.read_archives, "h5py")):
        try:
            __import__(package)
        except ImportError:
            with pytest.raises(NotImplementedError, match=package):
                reader(listing, "/")


def test_tables_by_suffix(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "i int, s string")
    path = str(tmp_path / "t.parquet")
    tables.write_table(df, path)
    with pytest.raises(Exception, match="exists"):
        tables.write_table(df, path)
    tables.write_table(df, path, overwrite=True)
    assert tables.read_table(spark, path, ["s"]).columns == ["s"]
    (tmp_path / "t.csv.xz").write_bytes(lzma.compress(b"i,s\n1,a\n2,b\n"))
    assert tables.read_table(spark, str(tmp_path / "t.csv.xz")).count() == 2
    tables.write_single_csv(df, str(tmp_path / "one.csv"), ["i"])
    assert (tmp_path / "one.csv").read_text() == "i,s\n1,a\n2,b\n"
    assert tables.read_table(spark, str(tmp_path / "one.csv"), schema="i int, s string").first().i == 1
    tables.write_json(df.limit(1), str(tmp_path / "o.json"), more=1)
    assert tables.columns_like(df, "s") == ["s"] and [r.i for r in tables.row_slice(df, ["i"], 1).collect()] == [2]
    for bad in (lambda: tables.columns_like(df, "report_"), lambda: tables.read_table(spark, "x.txt"), lambda: tables.named_paths(["a"]), lambda: tables.named_paths(["a=b", "a=c"]), lambda: tables.distinct_outputs("a/b", "a/./b"), lambda: tables.write_table(df, "x.txt"), lambda: tables.keyed(df, "s", ["a"]), lambda: tables.write_json(df, "x")):
        with pytest.raises(ValueError):
            bad()


def test_predictions_by_folder(spark, tmp_path):
    head = "record_id,target_normal,probability_normal\n"
    for layout in ("m/predictions/a__to__b", "n/a__to__a"):
        os.makedirs(tmp_path / layout)
        (tmp_path / layout / "test_predictions.csv").write_text(head + "007,1,0.5\n")
    wide = pred.read_predictions(spark, [str(tmp_path / "m/predictions/*"), str(tmp_path / "n/*")])
    assert {(r.architecture, r.source_dataset, r.target_dataset) for r in wide.collect()} == {("m", "a", "b"), ("n", "a", "a")}
    long = pred.long_predictions(wide, ["normal"])
    pred.write_predictions(long, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 2 and back.first().record_id == "007"


def test_streams(spark, tmp_path):
    rows = [(i, "f", "d", "I", i, 1.0 + i / 100, "mV", f"2024-01-01 00:{i:02d}:00") for i in range(20)] + [(99, "f", "d", "I", 3, 50.0, "mV", "2024-01-01 00:30:00"), (100, "f", "d", "I", 3, -1.0, "mV", "2024-01-01 00:31:00")]
    df = spark.createDataFrame(rows, "reading_id bigint, signal_path string, device string, lead string, second_no int, amp double, unit string, t string").withColumn("received_at", F.to_timestamp("t"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    profile = spark.createDataFrame([("d", 1.1, 0.1)], "device string, median double, spread double")

    def run(s, name, mode="append"):
        q = s.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    assert {(r.reading_id, r.kind) for r in run(live.spikes_of(stream, profile), "spikes")} == {(99, "spike"), (100, "impossible")}
    assert len(run(live.once(stream), "once")) == 20
    assert sum(r.readings for r in run(live.per_window(stream), "win", "complete")) == 22
    texts = spark.createDataFrame([(1, "Atrial flutter"), (2, None)], "k int, a string")
    texts.write.parquet(str(tmp_path / "texts"))
    q = live.label_as_it_comes(spark.readStream.schema(texts.schema).parquet(str(tmp_path / "texts")), "k", ["a"], {"af": "flutter"}, str(tmp_path / "lab"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert {(r.k, r.af) for r in spark.read.parquet(str(tmp_path / "lab")).collect()} == {(1, 1), (2, 0)}


def test_audit_finds_exact_and_near_matches(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(6, 768))
    rows = [(i, "a", f"s{i}", 0, f"h{i}", "train", v.tolist()) for i, v in enumerate(base)]
    near = base[0] * 2 + 0.01 * rng.normal(size=768)
    turned = base[1] + 0.15 * rng.normal(size=768)  # near by cosine, not by its leads
    rows += [(10, "b", "t0", 0, None, "test", near.tolist()), (11, "b", "t1", 0, "x", "test", turned.tolist()), (12, "b", "t2", 1, "h2", "test", None), (13, "b", "t2", 0, "y", "test", base[2].tolist()), (14, "b", "t3", 0, "z", "test", rng.normal(size=768).tolist()), (15, "b", None, 0, "h3", "test", None)]
    w = spark.createDataFrame(rows, "window_id bigint, dataset string, record_id string, window_index int, exact_hash string, part string, features array<double>")
    got = {r.target_record_id: (r.source_record_id, r.match_type) for r in overlap.audit(w, "part").collect()}
    assert got == {"t0": ("s0", "near"), "t2": ("s2", "exact")}
    summary = overlap.removal_summary(overlap.audit(w, "part"), w.where("part = 'test' and record_id is not null")).collect()
    assert [(r.exact_removed, r.near_removed, r.removed, r.audited) for r in summary] == [(1, 1, 2, 4)]
    assert overlap.audit(w.limit(0), "part").count() == 0


def test_overwriting_leaves_no_gap(spark, tmp_path):
    from heartlake.sources.tables import write_single_csv, write_table

    path = str(tmp_path / "t.parquet")
    write_table(spark.range(3), path)
    with pytest.raises(Exception):
        write_table(spark.range(5), path)
    broken = spark.range(5).select(F.when(F.col("id") == 4, F.raise_error(F.lit("stop")).cast("bigint")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception):
        write_table(broken, path, overwrite=True)
    assert spark.read.parquet(path).count() == 3
    write_table(spark.read.parquet(path).union(spark.range(4)), path, overwrite=True)  # even of itself
    assert spark.read.parquet(path).count() == 7 and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["t.parquet"]
    write_single_csv(spark.range(3), str(tmp_path / "s.csv"), ["id"])
    assert (tmp_path / "s.csv").read_text() == "id\n0\n1\n2\n"
