import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from heartlake.llm import components, cross_split, reservoirs
from heartlake.llm.catalog import catalog
from heartlake.llm.passages import covered_length, fenced, matched_passages
from tests.oracle import differences

MANIFEST = "manifest_id bigint, dataset string, record_id string, signal_path string, split string"


def test_queries_agree_with_sql(spark, small):
    assert differences(catalog, spark, small) == {}


def test_other_queries_run(spark, small):
    for name in ("p2_found", "p2_report", "p2_coverage", "p3_neighbours", "p5_splits", "p5_report", "p8_items", "p9_clean"):
        assert catalog.queries[name](spark, small).count() > 0, name


def test_passages(spark):
    one = lambda xs: spark.createDataFrame([(x,) for x in xs], "text string")
    e = one(["a", "ab", "zz", None, "a"]).select(fenced("k", F.col("text")).alias("text"))
    t = one(["ab", "a", "abc", None, "ab"]).select(fenced("k", F.col("text")).alias("text"))
    assert {r.text[2:-1] for r in matched_passages(e, t).collect()} == {"a", "ab"}
    assert matched_passages(e.limit(0), t).count() == 0 and matched_passages(e, t.limit(0)).count() == 0
    spans = spark.createDataFrame([([(0, 4), (2, 6), (10, 12)],), ([],)], "s array<struct<a:int,b:int>>")
    assert [r.n for r in spans.select(covered_length(F.col("s")).alias("n")).collect()] == [8, 0]


def test_partial_coverage(spark):
    rows = [(1, "d", "r1", "a/b/x.npy", "train"), (2, "d", "r2", "A/c/x.npy", "test"), (3, "d", "r1", "q/b/y", "val"), (4, "d", None, "zz", "test"), (5, "d", "r5", None, "test"), (6, "d", "new", "a/b/x.npy", "test"), (7, "d", "r9", "x.npy/q", "test")]
    m = spark.createDataFrame([(*x, 1) for x in rows], MANIFEST + ", steps int")
    got = {r.id: (r.covered, r.n_chars) for r in cross_split.coverage(m).collect()}
    # /a/ and /x.npy; r1 and /b/; nothing; nothing; the whole path; nothing, as a folder is no file
    assert got == {2: (3 + 6, 2 + 10), 3: (2 + 3, 2 + 6), 4: (0, 3), 5: (0, 2), 6: (10, 13), 7: (0, 10)}


@pytest.mark.parametrize("rows_per_task", [1, 200_000])
def test_anchored_passages_against_all_texts(spark, rows_per_task):
    r = random.Random(2)
    texts = ["/".join(["", *(r.choice("abcd") for _ in range(r.randint(1, 5))), ""]) for _ in range(60)]
    passages = ["/".join(["", *(r.choice("abcdx") for _ in range(r.randint(1, 3))), ""]) for _ in range(60)]
    e = spark.createDataFrame([(p, f"/{p.split('/')[1]}/") for p in passages], "text string, anchor string")
    t = spark.createDataFrame([(x, [f"/{s}/" for s in x.split("/") if s]) for x in texts], "text string, anchors array<string>")
    got = {x.text for x in matched_passages(e, t, anchor="anchor", anchors="anchors", rows_per_task=rows_per_task).collect()}
    assert got == {p for p in passages if any(p in x for x in texts)} and 0 < len(got) < len(set(passages))


def test_overlaps_against_all_pairs(spark):
    rng, r = np.random.default_rng(0), random.Random(0)
    rows = []
    for i in range(160):
        rec = f"r{r.randint(0, 60)}" if r.random() < 0.95 else r.choice([None, "", " "])
        path = r.choice(["a/{}", "./A/{}", "a//{} ", "a\\{}", "a/x/../{}"]).format(r.randint(0, 60)) if r.random() < 0.95 else None
        rows.append((i, "d", rec, path, r.choice(["train", "TRAIN ", "val", "test", None, "?"])))
    base = {f"r{k}": rng.normal(size=768) for k in range(61)}
    base["r5"] = base["r4"] + rng.normal(size=768) * 0.01
    base["r7"] = base["r6"] * 2
    cache = [(k + 1, rec, v.astype(np.float32).tolist()) for k, (rec, v) in enumerate(base.items())] + [(900, "r8", None), (901, "r8", [0.0] * 768), (902, "r9", [0.0] * 768), (903, None, base["r1"].tolist())]
    got = cross_split.overlaps(spark.createDataFrame(rows, MANIFEST), spark.createDataFrame(cache, "vec_id bigint, record_id string, features array<float>")).collect()

    side = {"train": "t", "val": "e", "test": "e"}
    same = lambda p: None if p is None else re.sub(r"x/\.\./", "", re.sub(r"/+", "/", p.strip().lower().replace("\\", "/"))).removeprefix("./")
    near = {("r4", "r5"), ("r5", "r4"), ("r6", "r7"), ("r7", "r6")}
    want = set()
    for a, b in itertools.permutations(rows, 2):
        if side.get((a[4] or "").strip().lower()) != "t" or side.get((b[4] or "").strip().lower()) != "e":
            continue
        if a[2] and a[2].strip() and a[2] == b[2]:
            want.add((a[0], b[0], "record"))
        if a[3] and same(a[3]) == same(b[3]):
            want.add((a[0], b[0], "file"))
        if (a[2], b[2]) in near:
            want.add((a[0], b[0], "window"))
    assert {tuple(x) for x in got} == want and {x[2] for x in want} == {"record", "file", "window"}


def test_overlaps_of_empty_tables(spark):
    m = spark.createDataFrame([], MANIFEST)
    c = spark.createDataFrame([], "vec_id bigint, record_id string, features array<float>")
    assert cross_split.overlaps(m, c).count() == 0 and cross_split.coverage(m).count() == 0


def union_find(pairs):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


@pytest.mark.parametrize("seed", range(3))
def test_components_against_union_find(spark, seed):
    r = random.Random(seed)
    pairs = [(f"n{r.randint(0, 80):03d}", f"n{r.randint(0, 80):03d}") for _ in range(50)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(40)] + [("star", f"s{i}") for i in range(50)]
    df = spark.createDataFrame([*pairs, (None, "x"), ("y", None)], "a string, b string")
    assert {x.node: x.component for x in components.hash_to_min(df, "a", "b").collect()} == union_find(pairs)


def test_related_rows(spark):
    rows = [(1, "P-001", "s7", "train"), (2, "1", None, "TEST"), (3, None, "study 7 ", None), (4, "0", "unknown", "train"), (5, "unknown", "7", "val"), (6, "7", None, "test"), (7, None, None, "train"), (8, "7", "", "test")]
    df = spark.createDataFrame([(*x, 9) for x in rows], "manifest_id bigint, subject_id string, study_id string, split string, component int")
    got = components.related_rows(df)
    groups = {}
    for r in got.collect():
        groups.setdefault(r.component, set()).add(r.id)
    assert sorted(map(sorted, groups.values())) == [[1, 2, 3, 5], [4], [6, 8], [7]]
    assert {tuple(r) for r in components.torn_groups(got).collect()} == {(i, 1) for i in (1, 2, 3, 5)}
    out = components.assigned(got).collect()
    assert all(len({r.assigned for r in out if r.component == c}) == 1 for c in groups)
    assert components.related_rows(df.limit(0)).count() == 0


def test_rendezvous_shares_and_stability(spark):
    df = spark.range(20_000).select(F.col("id").cast("string").alias("k"))
    a = {"train": 0.8, "validation": 0.1, "test": 0.1}
    out = df.select("k", components.rendezvous(F.col("k"), a).alias("x"), components.rendezvous(F.col("k"), a | {"more": 0.1}).alias("y")).collect()
    assert abs(sum(r.x == "train" for r in out) / 20_000 - 0.8) < 0.01
    assert all(r.x == r.y or r.y == "more" for r in out)


def test_reservoirs(spark):
    r = random.Random(1)
    rows = [(f"r{i}", r.choice(["train", " Train", "test", None]), *[r.choice([0, 0, 0, 1, 1, None, 2]) for _ in range(4)]) for i in range(900)]
    rows += rows[:50] + [(None, "train", 0, 0, 0, 0)]
    m = spark.createDataFrame(rows, "record_id string, split string, af_afl int, lbbb int, rbbb int, av_block_1 int")
    cats = list(itertools.product((0, 1), repeat=4))
    plan = spark.createDataFrame([(p, i + 1, *c, 1 / 16, (5, 0, 40)[i % 3], 160) for p in (1, 2) for i, c in enumerate(cats)], "plan_id bigint, cat_id bigint, af_afl int, lbbb int, rbbb int, av_block_1 int, target_share double, min_rows int, sample_size int")
    have = {c: {x[0] for x in rows if x[0] and (x[1] or "").strip().lower() == "train" and tuple(x[2:]) == c} for c in cats}
    rep = reservoirs.report(m, plan).collect()
    for x in rep:
        c = (x.af_afl, x.lbbb, x.rbbb, x.av_block_1)
        assert x.available == len(have[c]) and x.short == (len(have[c]) < max(10, x.min_rows)) and x.drawn == min(x.quota, len(have[c]))
    got = reservoirs.draw(m, plan).collect()
    for x in rep:
        mine = [y.record_id for y in got if (y.plan_id, y.cat_id) == (x.plan_id, x.cat_id)]
        assert len(mine) == len(set(mine)) == x.drawn and set(mine) <= have[(x.af_afl, x.lbbb, x.rbbb, x.av_block_1)]
    assert {tuple(x) for x in got} == {tuple(x) for x in reservoirs.draw(m.repartition(3), plan).collect()}
    assert reservoirs.draw(m.limit(0), plan).count() == 0 and {x.drawn for x in reservoirs.report(m.limit(0), plan).collect()} == {0}


def test_draws_are_uniform(spark):
    m = spark.range(400).select(F.concat(F.lit("r"), "id").alias("record_id"), F.lit("train").alias("split"), *[F.lit(0).alias(f) for f in reservoirs.FLAGS])
    plan = spark.createDataFrame([(1, 1, 0, 0, 0, 0, 1.0, 0, 100)], "plan_id bigint, cat_id bigint, af_afl int, lbbb int, rbbb int, av_block_1 int, target_share double, min_rows int, sample_size int")
    low = [sum(int(x.record_id[1:]) < 200 for x in reservoirs.draw(m, plan, seed).collect()) for seed in range(5)]
    assert all(30 < n < 70 for n in low) and len(set(low)) > 1


PLAN = "plan_id bigint, cat_id bigint, af_afl int, lbbb int, rbbb int, av_block_1 int, target_share double, min_rows int, sample_size int"


def test_quotas_add_up_to_the_sample(spark):
    have = {(0, 0, 0, 0): 500, (0, 0, 0, 1): 30, (0, 0, 1, 0): 400, (0, 1, 0, 0): 12}
    rows = [(f"r{c}{i}", "train", *c) for c, n in have.items() for i in range(n)]
    m = spark.createDataFrame(rows, "record_id string, split string, af_afl int, lbbb int, rbbb int, av_block_1 int")
    plans = {1: (200, [(0.4, 0), (0.3, 0), (0.2, 0), (0.1, 0)]), 2: (100, [(0.5, 0), (0.01, 10), (0.49, 0), (0.0, 5)]), 3: (5000, [(0.25, 0)] * 4), 4: (10, [(0.25, 20)] * 4)}
    plan = spark.createDataFrame([(p, i, *c, x[0], x[1], size) for p, (size, shares) in plans.items() for i, (c, x) in enumerate(zip(have, shares))], PLAN)
    got = {}
    for x in reservoirs.report(m, plan).orderBy("cat_id").collect():
        got.setdefault(x.plan_id, []).append((x.drawn, x.short))
    assert [d for d, _ in got[1]] == [105, 30, 53, 12] and sum(d for d, _ in got[1]) == 200  # what 2 and 4 lack is shared 2 to 1
    assert [d for d, _ in got[2]] == [43, 10, 42, 5]
    assert [d for d, _ in got[3]] == list(have.values()) and all(s for _, s in got[3])
    assert [d for d, _ in got[4]] == [20, 20, 20, 12]
    assert [s for _, s in got[1]] == [False, True, False, True]
    drawn = reservoirs.draw(m, plan).groupBy("plan_id").count().collect()
    assert {x.plan_id: x["count"] for x in drawn} == {1: 200, 2: 100, 3: 942, 4: 72}


def test_shortage_comes_from_the_reservoirs(spark, monkeypatch):
    m = spark.createDataFrame([(f"r{i}", "train", 0, 0, 0, 0) for i in range(50)], "record_id string, split string, af_afl int, lbbb int, rbbb int, av_block_1 int")
    plan = spark.createDataFrame([(1, 1, 0, 0, 0, 0, 1.0, 0, 40)], PLAN)
    assert [x.short for x in reservoirs.report(m, plan).collect()] == [False]
    parts = reservoirs.reservoirs(m, plan).where("record_id is not null and priority % 2 = 0 or seen > 0")
    assert [x.short for x in reservoirs.quotas(plan, reservoirs.fill(parts)).collect()] == [True]


def test_reservoirs_merge():
    r = np.random.default_rng(3)
    p, names = r.integers(0, 50, 400), np.array([f"r{i}" for i in range(400)], object)
    whole = reservoirs.Reservoir(30)
    whole.offer(p, names)
    whole.trim()
    merged = reservoirs.Reservoir(30)
    for a in range(0, 400, 37):
        part = reservoirs.Reservoir(30)
        part.offer(p[a : a + 37], names[a : a + 37])
        part.trim()
        merged.offer(part.priority, part.record)
    merged.trim()
    assert set(merged.record) == set(whole.record) and len(whole.record) == 30
