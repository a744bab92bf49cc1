import itertools
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from heartlake.operators import checks, dedup, metrics, ranking, reshape
from heartlake.operators.joins import salted_join


def area(y, p, w=None):
    w = w or [1] * len(y)
    num = sum(a * b * (1.0 if s > t else 0.5 if s == t else 0.0) for (i, s, a), (j, t, b) in itertools.product(zip(y, p, w), repeat=2) if i == 1 and j == 0)
    den = sum(a for i, a in zip(y, w) if i) * sum(a for i, a in zip(y, w) if not i)
    return num / den if den else None


@pytest.mark.parametrize("seed", range(3))
def test_auroc_against_pairs(spark, seed):
    r = random.Random(seed)
    rows = [(g, r.randint(0, 1), r.randint(0, 6) / 6, r.randint(0, 3)) for g in "ab" for _ in range(60)] + [("one", 1, 0.3, 1), ("one", 1, 0.4, 1)]
    df = spark.createDataFrame([*rows, ("a", None, 0.5, 1), ("a", 1, float("nan"), 1)], "g string, y int, p double, w int")
    got = {x.g: x.auroc for x in metrics.auroc(df, ["g"], "y", "p").collect()}
    weighted = {x.g: x.auroc for x in metrics.auroc(df, ["g"], "y", "p", "w").collect()}
    flipped = {x.g: x.auroc for x in metrics.auroc(df.withColumn("p", 1 - F.col("p")), ["g"], "y", "p").collect()}
    for g in "ab":
        y, p, w = zip(*[x[1:] for x in rows if x[0] == g])
        assert got[g] == pytest.approx(area(y, p)) and weighted[g] == pytest.approx(area(y, p, w)) and flipped[g] == pytest.approx(1 - got[g])
    assert got["one"] is None
    assert metrics.macro_auroc(metrics.auroc(df, ["g"], "y", "p"), []).first().defined_classes == 2


def test_gaps(spark):
    rows = [("m", "a", "a", 0.9, "COMPLETE"), ("m", "b", "b", 0.8, "COMPLETE"), ("m", "a", "b", 0.6, "COMPLETE"), ("m", "b", "a", None, "BLOCKED")]
    g = metrics.generalization_gap(spark.createDataFrame(rows, "architecture string, source_dataset string, target_dataset string, x double, status string"), ["architecture"], "x").first()
    assert (g.in_distribution_mean, g.cross_dataset_mean, g.cross_dataset_cells) == (pytest.approx(0.85), 0.6, 1) and g.generalization_gap == pytest.approx(0.25)
    r = spark.range(1).select(*metrics.compare_gaps(F.lit(0.2), F.lit(0.05)), *[c.alias(n) for c, n in zip(metrics.compare_gaps(F.lit(0.0), F.lit(0.1)), "ab")]).first()
    assert r.gap_reduction_percent == pytest.approx(75) and r.b is None


def test_sign_flips_and_tau(spark):
    d = [0.3, -0.1, 0.2, 0.4]
    want = np.mean([abs(np.mean(np.array(s) * d)) >= abs(np.mean(d)) - 1e-15 for s in itertools.product([1, -1], repeat=4)])
    df = spark.createDataFrame([("g", i, x) for i, x in enumerate(d)], "g string, i int, d double")
    assert metrics.sign_flip_p(df, ["g"], "i", "d").first().p_value == pytest.approx(want)
    with pytest.raises(PySparkException):
        metrics.sign_flip_p(spark.range(21).selectExpr("'g' as g", "id as i", "cast(id as double) as d"), ["g"], "i", "d").collect()
    ties = spark.createDataFrame([("g", "a", 1.0, 1.0), ("g", "b", 2.0, 1.0), ("g", "c", 3.0, 2.0), ("h", "a", 1.0, 1.0), ("h", "b", 1.0, 2.0)], "g string, i string, x double, y double")
    got = {r.g: r.kendall_tau for r in metrics.kendall_tau(ties, ["g"], "i", "x", "y").collect()}
    assert got["g"] == pytest.approx(2 / np.sqrt(6)) and got["h"] is None


def test_places_are_a_permutation_and_repeat(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, None).otherwise("g").alias("g"))
    a = {(r.g, r.place): r.id for r in ranking.place_by_hash(df, ["g"], "id").collect()}
    b = {(r.g, r.place): r.id for r in ranking.place_by_hash(df.repartition(7), ["g"], "id").collect()}
    assert a == b and {p for g, p in a if g is None} == set(range(1, 668)) and len(a) == 2000


def test_salted_join_is_a_join(spark):
    left = spark.range(3000).select(F.when(F.col("id") < 2000, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("a"))
    right = spark.createDataFrame([(1, "x"), (1, "y"), (2500, "z"), (None, "n")], "k bigint, b string")
    got = salted_join(left, right, ["k"], rows_per_task=100)
    assert got.count() == 4001 and got.columns == ["k", "a", "b"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, left.join(right, "k").collect()))


def test_checks(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "k int, v string")
    with pytest.raises(checks.TableError, match="missing"):
        checks.require_columns(df, ["z"])
    with pytest.raises(checks.TableError, match="set"):
        checks.require_rows(df, {"set": F.col("v").isNotNull()})
    with pytest.raises(checks.TableError, match="empty"):
        checks.require_rows(df.limit(0), {})
    with pytest.raises(checks.TableError):
        checks.require_unique(df, ["k"])
    with pytest.raises(checks.TableError):
        checks.require_one_value(df, "k", "v")
    with pytest.raises(checks.TableError, match="right only"):
        checks.require_same_keys(df.limit(1), df, ["k"])
    one = spark.createDataFrame([(1, 10)], "k int, w int")
    assert checks.join_checked(df, one, ["k"], "left").count() == 3
    with pytest.raises(checks.TableError):
        checks.join_checked(df, one, ["k"], "left", complete=["w"])
    with pytest.raises(checks.TableError):
        checks.join_checked(one, df, ["k"])


def test_matrix_and_shape(spark):
    cells = spark.createDataFrame([("b", "a", 1.0), ("a", "a", 2.0)], "s string, t string, v double")
    m = reshape.matrix(cells, "s", "t", "v", ["a", "b", "c"])
    assert [tuple(r) for r in m.collect()] == [("a", 2.0, None, None), ("b", 1.0, None, None), ("c", None, None, None)]
    with pytest.raises(checks.TableError):
        reshape.matrix(cells.union(cells), "s", "t", "v", ["a"])
    assert reshape.drop_empty_rows(m, ["a", "b", "c"]).count() == 2
    assert reshape.with_columns_of(cells, {"v": "double", "z": "int"}).columns == ["v", "z"]


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (2, "b", 1), (2, None, 1), (3, None, 1), (3, None, 1)], "k int, v string, o int")
    assert {r.k for r in dedup.conflicting(df, "k", ["v"]).collect()} == {2}
    assert {(r.k, r.o) for r in dedup.keep_first(df, ["k"], [F.col("o").desc()]).collect()} == {(1, 2), (2, 1), (3, 1)}
    assert dedup.exact_copies(df, "k", "v").first().rows == 2


def test_weights_need_positives(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (0, 0)], "a int, b int")
    assert metrics.positive_weights(df, ["a"]).first().weight == 2
    with pytest.raises(PySparkException):
        metrics.positive_weights(df, ["a", "b"]).collect()


def test_near_join_against_all_pairs(spark):
    import numpy as np

    from heartlake.operators.vector_join import near_join

    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 24))
    other = np.concatenate([base[:30] + rng.normal(size=(30, 24)) * 0.18, rng.normal(size=(40, 24)), base[:2] * 3, [np.zeros(24)]])
    rows = lambda m, at: [(at + i, v.tolist(), 7) for i, v in enumerate(m)]
    odd = [(900, None, 7), (901, [], 7), (902, [1.0] * 23, 7), (903, [float("nan")] * 24, 7), (904, [None] * 24, 7)]
    schema = "k int, v array<double>, key int"
    left, right = spark.createDataFrame(rows(base, 0) + odd, schema), spark.createDataFrame(rows(other, 50) + odd, schema)
    got = {(r.left_id, r.right_id): r.cosine for r in near_join(left, right, "k", "v", 0.97).collect()}
    want = {}
    for i, a in enumerate(base):
        for j, b in enumerate(other[:-1]):
            c = round(float(a @ b / np.sqrt((a @ a) * (b @ b))), 9)
            if c >= 0.97 and i != 50 + j:
                want[i, 50 + j] = c
    want[902, 902] = None
    del want[902, 902]  # a row is no match of itself
    assert got == pytest.approx(want, abs=1e-8) and len(want) > 15
    assert near_join(left.limit(0), right, "k", "v", 0.97).count() == 0


def test_running_total(spark):
    from heartlake.operators.ranking import running_total

    df = spark.createDataFrame([((i * 37) % 101, i % 5) for i in range(101)], "k int, n int").repartition(7)
    got = running_total(df, [F.col("k").desc()], "n", "before").collect()
    assert all(r.before == sum(x.n for x in got if x.k > r.k) for r in got) and len(got) == 101


@pytest.mark.parametrize("average", [False, True])
@pytest.mark.parametrize("descending", [False, True])
def test_ranks_in_buckets_are_the_windows(spark, average, descending):
    from heartlake.operators.ranking import rank_average, rank_min, ranked

    rows = [(i, i % 3 if i % 7 else None, None if i % 11 == 0 else float((i * 37) % 50) - 20 + (1e-9 if i % 5 == 0 else 0)) for i in range(400)] + [(900, 1, float("inf")), (901, 1, float("-inf")), (902, 1, 0.0), (903, 1, float("nan"))]
    df = spark.createDataFrame(rows, "id int, g int, x double")
    want = rank_average(["g"], "x", descending) if average else rank_min(["g"], F.col("x"), descending)
    got = {r.id: float(r["rank"]) for r in ranked(df, ["g"], "x", average=average, descending=descending).collect()}
    assert got == {r.id: float(r["rank"]) for r in df.withColumn("rank", want).collect()}
