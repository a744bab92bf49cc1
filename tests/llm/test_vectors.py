import itertools

import numpy as np
import pyarrow as pa
import pytest

from heartlake.llm import vectors
from heartlake.llm.near_vectors import SignHashes, near_pairs
from heartlake.llm.neighbours import GraphIndex, fit_centres, nearest, neighbour_pairs
from heartlake.llm.vamana import ShardGraph, orthonormal

SCHEMA = "vec_id bigint, features array<float>"


def families(seed, n, dim, size=12, spread=0.45):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(max(1, n // size), dim))
    m = base[rng.integers(0, len(base), n)] + spread * rng.normal(size=(n, dim))
    return np.round(m * 64) / 1024


def exact(ids, m, k):
    m = np.asarray(m, np.float32).astype(float)
    u = m / np.sqrt((m * m).sum(1))[:, None]
    cos = np.round(u @ u.T, 6)
    out = {}
    for i, v in enumerate(ids):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-cos[i, j], ids[j]))
        out[v] = [(ids[j], cos[i, j]) for j in order[:k]]
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], SCHEMA)


def test_matrix_and_packing():
    column = pa.array([[1.0, 2.0], None, [0.0, 0.0], [1.0, None], [float("nan"), 1.0], [3.0], [0.5, -0.25]], pa.list_(pa.float32()))
    at, m = vectors.matrix(column, 2)
    assert at.tolist() == [0, 6] and m.tolist() == [[1, 2], [0.5, -0.25]]
    assert vectors.matrix(column.slice(5), 2)[0].tolist() == [1] and len(vectors.matrix(column.slice(7), 2)[0]) == 0
    x = np.random.default_rng(0).normal(size=(9, 33)).astype(np.float32)
    assert (vectors.unpack(vectors.pack(x), 33) == x).all()
    q = orthonormal(20, 8, 3)
    np.testing.assert_allclose(q.T @ q, np.eye(8), atol=1e-5)


def test_graph_recall_and_degree():
    m = vectors.unit(families(1, 1500, 64).astype(np.float32))
    g = ShardGraph(m, degree=24, pool=48, expand=20, relax=1.05)
    assert (g.edges >= 0).sum(1).max() <= 24 and (g.edges == np.arange(1500)[:, None]).sum() == 0
    found, dist = g.search(m)
    assert (np.diff(np.where(np.isfinite(dist), dist, 9e9), axis=1) >= -1e-6).all()
    cos = m @ m.T
    top = np.argsort(-cos, axis=1)[:, :6]
    assert np.mean([len(set(t) & set(f)) / 6 for t, f in zip(top, found)]) > 0.95
    assert ShardGraph(m[:1]).search(m[:1])[0][0][0] == 0 and len(ShardGraph(m[:2]).search(m[:2])[0]) == 2


@pytest.mark.parametrize("index", [GraphIndex(dim=48, shard_rows=200, width=32), GraphIndex(dim=48, shard_rows=60, per_centre=400, width=48)])
def test_recall_against_brute_force(spark, index):
    m = families(2, 1200, 48)
    ids = [10 * i + 3 for i in range(len(m))]
    got = {}
    for r in nearest(table(spark, zip(ids, m)), index=index).collect():
        got.setdefault(r.vec_id, {})[r.rank] = (r.other_id, r.cosine)
    want = exact(ids, m, 5)
    assert set(got) == set(ids) and all(sorted(v) == [1, 2, 3, 4, 5] for v in got.values())
    hits = [len({o for o, _ in want[i]} & {o for o, _ in got[i].values()}) for i in ids]
    assert sum(hits) / (5 * len(ids)) >= 0.9


def test_recall_in_a_skewed_family(spark):
    rng = np.random.default_rng(31)
    hub = rng.normal(size=64)
    m = np.concatenate([hub + 0.2 * rng.normal(size=(900, 64)), rng.normal(size=(1500, 64)), 0.6 * hub + rng.normal(size=(300, 64))])
    ids = list(range(len(m)))
    got = {}
    for r in nearest(table(spark, zip(ids, m)), index=GraphIndex(dim=64, shard_rows=300, width=64)).collect():
        got.setdefault(r.vec_id, set()).add(r.other_id)
    want = exact(ids, m, 5)
    hits = [len({o for o, _ in want[i]} & got[i]) / 5 for i in range(900)]
    assert np.mean(hits) >= 0.95


def test_no_neighbour_is_lost_however_many_shards(spark):
    m = families(41, 2000, 48, spread=0.65)
    got = {}
    for r in nearest(table(spark, enumerate(m)), index=GraphIndex(dim=48, shard_rows=64, width=48, margin=0.3)).collect():
        got.setdefault(r.vec_id, set()).add(r.other_id)
    want = exact(list(range(len(m))), m, 5)
    assert np.mean([len({o for o, _ in want[i]} & got[i]) / 5 for i in want]) >= 0.99


def test_many_centres_are_fitted_in_two_levels():
    m = vectors.unit(np.random.default_rng(3).normal(size=(6000, 16)).astype(np.float32))
    c = fit_centres(m, 400, 1)
    assert 380 <= len(c) <= 420 and np.allclose(np.linalg.norm(c, axis=1), 1, atol=1e-4)
    assert np.bincount((m @ c.T).argmax(1), minlength=len(c)).max() < 90


def test_copies_ties_and_unusable(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=8).round(2), rng.normal(size=8).round(2)
    rows = [(i, a) for i in range(20, 0, -1)] + [(100, b), (101, b)]
    rows += [(200, None), (201, [0.0] * 8), (202, [float("nan")] * 8), (203, [1.0] * 7), (204, [None] * 8), (205, [-0.0] * 8), (206, [0.0] * 8)]
    got = {}
    for r in nearest(table(spark, rows), index=GraphIndex(dim=8, width=8, copies_per_task=4)).orderBy("rank").collect():
        got.setdefault(r.vec_id, []).append((r.other_id, r.cosine))
    usable = [(i, v) for i, v in rows if i < 200]
    assert got == exact([i for i, _ in usable], [v for _, v in usable], 5)
    assert sum(len(v) for v in got.values()) == 22 * 5


def test_large_families_of_differing_gain(spark):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(3, 768)).astype(np.float32)
    rows = [(int(i), (base[f] * np.float32(g)).astype(np.float32)) for f, size in ((0, 150), (1, 40), (2, 4)) for i, g in zip(1000 * f + rng.permutation(size) + 1, rng.uniform(0.2, 5, size))]
    got = {}
    for r in nearest(table(spark, rows)).orderBy("rank").collect():
        got.setdefault(r.vec_id, []).append((r.other_id, r.cosine))
    want = exact([i for i, _ in rows], [v for _, v in rows], 5)
    big = [i for i, _ in rows if i < 2000]
    assert set(got) == set(want) and {i: got[i] for i in big} == {i: want[i] for i in big}
    assert all(got[i][:3] == want[i][:3] for i in want if i > 2000)


def test_few_vectors_and_clashing_columns(spark):
    empty = nearest(table(spark, []), index=GraphIndex(dim=4))
    assert empty.count() == 0 and empty.columns == ["vec_id", "rank", "other_id", "cosine"]
    assert nearest(table(spark, [(1, [1.0, 0, 0, 0])]), index=GraphIndex(dim=4)).count() == 0
    assert nearest(table(spark, [(1, [1.0, 0, 0, 0]), (2, [1.0, 0, 0, 0]), (None, [1.0, 0, 0, 0])]), index=GraphIndex(dim=4)).count() == 2
    df = spark.createDataFrame([(1, [1.0, 0.0], 5, 6), (2, [1.0, 0.1], 5, 6), (3, [0.0, 1.0], 5, 6)], SCHEMA + ", rep int, shard int")
    pairs = neighbour_pairs(nearest(df, index=GraphIndex(dim=2, k=1))).collect()
    assert {(r.vec_id_a, r.vec_id_b) for r in pairs} == {(1, 2), (2, 3)}


@pytest.mark.parametrize("hot", [1000, 3])
def test_near_pairs_against_all_pairs(spark, hot):
    rng = np.random.default_rng(7)
    base = families(8, 150, 768)
    near = base[:60] + rng.normal(size=(60, 768)) * 0.002
    far = base[60:120] + rng.normal(size=(60, 768)) * 0.012
    m = np.concatenate([base, near, far, base[:5], base[:5] * 3]).astype(np.float32)
    rows = [(i + 1, f"o{i % 90}", v) for i, v in enumerate(m)] + [(9001, "x", None), (9002, "x", np.zeros(768))]
    df = spark.createDataFrame([(i, o, None if v is None else v.tolist()) for i, o, v in rows], "vec_id bigint, owner string, features array<float>")
    pairs, owners = near_pairs(df, "vec_id", "owner", "features", SignHashes(hot=hot))
    rep, names = {}, {}
    for i, o, v in rows[:-2]:
        rep[i] = min(j for j, _, w in rows[:-2] if np.array_equal(v, w))
        names.setdefault(rep[i], set()).add(o)
    u = m.astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    cos = np.round(u @ u.T, 6)
    want = {(rep[a], rep[b]) for a, b in itertools.permutations(rep, 2) if rep[a] < rep[b] and cos[a - 1, b - 1] >= 0.99 and len(names[rep[a]] | names[rep[b]]) > 1}
    got = {(r.id_a, r.id_b) for r in pairs.collect()}
    assert got == want and len(want) >= 60
    back = {}
    for r in owners.collect():
        back.setdefault(r.id, set()).add(r.owner)
    assert back == names


def test_table_count_follows_the_size():
    small, large = SignHashes().shape(1000), SignHashes().shape(10**8)
    assert small[0] < large[0] and (1 - (1 - np.arccos(0.99) / np.pi) ** large[0]) ** large[1] <= 3e-6


def test_no_pair_at_the_threshold_is_lost_in_hot_buckets(spark):
    rng = np.random.default_rng(21)
    a = vectors.unit(rng.normal(size=(500, 768)).astype(np.float32)).astype(float)
    side = rng.normal(size=a.shape)
    side -= (side * a).sum(1)[:, None] * a
    side /= np.linalg.norm(side, axis=1)[:, None]
    b = 0.9901 * a + np.sqrt(1 - 0.9901**2) * side
    rows = [(i, f"o{i}", v.astype(np.float32).tolist()) for i, v in enumerate(np.concatenate([a, b]))]
    df = spark.createDataFrame(rows, "vec_id bigint, owner string, features array<float>")
    pairs, _ = near_pairs(df, "vec_id", "owner", "features", SignHashes(hot=1))
    assert {(r.id_a, r.id_b) for r in pairs.collect()} == {(i, i + 500) for i in range(500)}


def test_a_tight_family_in_one_bucket(spark):
    rng = np.random.default_rng(22)
    m = rng.normal(size=768) + 0.001 * rng.normal(size=(90, 768))
    df = spark.createDataFrame([(i, f"o{i % 3}", v.astype(np.float32).tolist()) for i, v in enumerate(m)], "vec_id bigint, owner string, features array<float>")
    pairs, _ = near_pairs(df, "vec_id", "owner", "features", SignHashes(hot=10))
    assert {(r.id_a, r.id_b) for r in pairs.collect()} == {(a, b) for a in range(90) for b in range(a + 1, 90) if a % 3 != b % 3}
