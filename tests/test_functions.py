import hashlib
import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from heartlake.functions import coerce, divergence, names
from heartlake.functions.codes import delimited_codes, labels_of, mapping_codes
from heartlake.functions.listings import dataset_name, number_in, same_file, split_name


def one(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_flags(spark):
    assert one(spark, [" Yes", "0.0", "F", "1", "maybe", "", None], coerce.binary_flag) == [1, 0, 0, 1, None, None, None]
    assert one(spark, ["maybe", "", None, "y"], coerce.bad_flag) == [True, False, False, False]
    assert one(spark, ["TRUE", "0"], coerce.strict_boolean) == [True, False]
    for bad in ("yes", None):
        with pytest.raises(PySparkException):
            one(spark, [bad], coerce.strict_boolean)


def test_numbers(spark):
    assert one(spark, ["1.5", "x", "nan", "inf", None], coerce.number) == [1.5, None, None, None, None]
    with pytest.raises(PySparkException):
        one(spark, ["x"], coerce.number_or_raise)
    assert one(spark, [float("nan"), 2.0, None, float("inf")], coerce.finite, "double") == [False, True, False, False]
    assert one(spark, [-1.0, 0.5, 9.0, None], lambda c: coerce.clip(c, 0, 1), "double") == [0.0, 0.5, 1.0, None]
    assert one(spark, [0.0, 2.0, None], lambda c: coerce.ratio(F.lit(1), c), "double") == [None, 0.5, None]
    assert one(spark, [0, 1, 119, 120, None], coerce.plausible_age, "int") == [False, True, True, False, False]


def test_names(spark):
    assert one(spark, ["PTB-XL", " mimic_IV ", "CODE-15%", "Other ", None], names.canonical_dataset) == ["ptbxl", "mimic_iv", "code_ii", "Other", None]
    assert one(spark, ["Res-Net!", "__a b__"], names.slug) == ["res_net", "a_b"]
    assert one(spark, ["Train ", "VAL", "valid\t", "TEST", "x", None], split_name) == ["train", "validation", "validation", "test", None, None]
    assert one(spark, ["Mimic IV", "--"], dataset_name) == ["mimiciv", None]


def test_paths(spark):
    alike = ["a/b/c.npy", " A\\b\\C.npy ", "./a//b/./c.npy", "a/x/../b/c.npy", "/a/b/c.npy", ".\\a\\b\\c.NPY"]
    assert set(one(spark, alike, same_file)) == {"a/b/c.npy"}
    assert one(spark, ["../a", "a/../../b", "", None, "a/b"], same_file) == ["../a", "../b", None, None, "a/b"]
    assert one(spark, ["a/b", "/a", "a/../b", "C:\\x", " ", None, "a..b"], lambda c: F.coalesce(coerce.safe_relative_path(c), F.lit(False))) == [True, False, False, False, False, False, True]


def test_identifiers(spark):
    given = ["P-0012", "subj_12", "#12", "000", "unknown", "", None, "１２"]
    assert one(spark, given, number_in) == ["12", "12", "12", None, None, None, None, "12"]


def test_md5_fraction_is_the_whole_digest(spark):
    keys = ["1", "abc", "x" * 50]
    want = [int(hashlib.md5(f"42_{k}".encode()).hexdigest(), 16) % 10000 / 10000 for k in keys]
    assert one(spark, keys, lambda c: coerce.md5_fraction(c, 42)) == want


def test_codes(spark):
    assert one(spark, ["a, b|c,,", None], delimited_codes) == [["a", "b", "c"], []]
    assert one(spark, ["{'NORM': 100.0, 'X': None}", "", None], mapping_codes) == [["NORM", "X"], [], []]
    with pytest.raises(PySparkException):
        one(spark, ["NORM"], mapping_codes)
    df = spark.createDataFrame([(["N", "?"],), ([],), (None,)], "c array<string>").select(*labels_of(F.col("c"), {"N": ["normal"]}, ["normal", "lbbb"]))
    assert [tuple(r) for r in df.collect()] == [(1, 0), (0, 0), (0, 0)]


def test_divergence(spark):
    df = spark.createDataFrame([([3948.0, 13262.0, 4298.0], [106386.0, 445507.0, 243652.0])], "a array<double>, b array<double>")
    r = df.select(divergence.kl_nats(F.col("a"), F.col("b")).alias("ab"), divergence.kl_nats(F.col("b"), F.col("a")).alias("ba"), divergence.kl_nats(F.col("a"), F.col("a")).alias("aa")).first()
    assert round(r.ab, 6) == 0.032186 and r.aa == 0 and r.ab != r.ba
    with pytest.raises(PySparkException):
        spark.createDataFrame([([0.0, 0.0],)], "a array<double>").select(divergence.smoothed(F.col("a"))).collect()


def test_combinations(spark):
    df = spark.createDataFrame([(0.5, 0.5, None, " a ", "")], "p double, q double, n double, s string, t string")
    r = df.select(coerce.noisy_or(F.col("p"), F.col("q")).alias("o"), coerce.any_positive(F.col("p"), F.col("n")).alias("m"), coerce.join_texts([F.col("s"), F.col("t"), F.col("s")]).alias("j"), coerce.no_nan(F.lit(math.nan)).alias("x")).first()
    assert (r.o, r.m, r.j, r.x) == (0.75, 0.5, "a; a", None)
