"""The most similar vectors of every vector, by groups of near ones.

Small codes of the vectors are routed to a few large regions of near
directions, so that their borders part few neighbours however large the
collection is.  In each region every code meets the cells nearest to it, and
what is near takes one label; a vector's groups are the labels of what is near
it in any region.  Only then do whole vectors travel, each to its groups, where
all pairs are ranked in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import salted_join
from ..session import cut, width
from .vamana import orthonormal
from .vectors import matrix, pack, unit, unpack


@dataclass(frozen=True)
class GraphIndex:
    """Parameters of the index.

    ``sample``: bound of the vectors the region centres are fitted on, as many
    numbers each as ``width``; every vector is indexed and searched.
    ``per_centre``: sampled vectors a centre needs at least.  ``region_rows``:
    vectors wanted in a region; with fewer than ``regions`` such regions they
    are smaller.  A region of more than twice as many, as one that no centres can
    part, is split at random, and a code then searches all its parts.
    ``visits``: regions a code is searched in.  ``margin``: how much less similar
    than the nearest centre another may be to be visited.  ``width``: dimensions
    of a code, a byte each.  ``cell_rows``: codes wanted in a region's cell;
    ``probes``: cells that a code meets there.  ``near``: codes kept of them, and
    of these those that are at most ``slack`` less similar than the ``k``-th.
    ``rounds``: steps that a label is handed on at most.  ``shard_rows``: vectors wanted in
    a task that ranks groups; a group of more than twice as many is split, and
    each of its vectors goes to all parts.
    ``copies_per_task``: exact copies of one vector that one task expands.
    ``broadcast_ids``: ids that may be broadcast (8 bytes each).  ``tasks``:
    shuffle partitions that the shards are spread over at most.
    """

    dim: int = 768
    k: int = 5
    sample: int = 65_536
    per_centre: int = 8
    region_rows: int = 131_072
    regions: int = 16
    visits: int = 8
    margin: float = 0.05
    width: int = 160
    cell_rows: int = 256
    probes: int = 24
    near: int = 10
    slack: float = 0.08
    rounds: int = 3
    shard_rows: int = 2048
    copies_per_task: int = 200_000
    broadcast_ids: int = 500_000
    tasks: int = 20_000
    seed: int = 7


def _nearest_centre(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    step = max(1, 8_000_000 // len(centres))
    return np.concatenate([(points[at : at + step] @ centres.T).argmax(1) for at in range(0, len(points), step)])


def _k_means(points: np.ndarray, wanted: int, rng: np.random.Generator, rounds: int) -> np.ndarray:
    """Spherical k-means centres of unit vectors."""
    wanted = max(1, min(wanted, len(points)))
    centres = points[rng.choice(len(points), wanted, replace=False)]
    for _ in range(rounds):
        near = _nearest_centre(points, centres)
        by = np.argsort(near, kind="stable")
        ids, first = np.unique(near[by], return_index=True)
        total = np.zeros_like(centres)
        total[ids] = np.add.reduceat(points[by], first, axis=0)
        length = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(length > 1e-9, total / np.maximum(length, 1e-9), points[rng.choice(len(points), wanted)])
    return centres


def fit_centres(points: np.ndarray, wanted: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means centres of unit vectors; many are fitted in two levels, within the cells of few."""
    rng = np.random.default_rng(seed)
    if wanted <= 128:
        return np.ascontiguousarray(_k_means(points, wanted, rng, rounds), dtype=np.float32)
    coarse = _k_means(points, round(wanted**0.5), rng, rounds)
    cell = _nearest_centre(points, coarse)
    fine = [_k_means(points[cell == c], round(wanted * n / len(points)), rng, rounds) for c, n in zip(*np.unique(cell, return_counts=True))]
    return np.ascontiguousarray(np.concatenate(fine), dtype=np.float32)


def _narrow(u: np.ndarray, index: GraphIndex) -> np.ndarray:
    """Unit vectors in the dimensions used to route, as unit vectors."""
    low = u @ orthonormal(index.dim, index.width, index.seed)
    return low / np.maximum(np.linalg.norm(low, axis=1, keepdims=True), 1e-9)


_FIRST_PASS = "vec_id bigint, h1 bigint, h2 bigint, d1 bigint, d2 bigint, low binary"


def _first_pass(index: GraphIndex, share: float):
    """Batches of ``(vec_id, features)`` to hashes of each usable vector and of its direction, and the sampled ones in few dimensions.

    The direction's hash is of 16 random projections in steps of 1e-5: it holds
    whatever the gain, bar one vector in about a thousand at the edge of a step.
    Vectors that agree in all 16 are within about 1e-5 of each other, so their
    cosine is 1 at six decimals; that two farther ones agree has chance 1e-30.
    """
    limit = int(share * (1 << 32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes = np.random.default_rng(index.seed).normal(size=(index.dim, 16))
        for batch in batches:
            at, m = matrix(batch.column(1), index.dim)
            if not len(at):
                continue
            m = m + np.float32(0)
            length = np.sqrt(np.einsum("ij,ij->i", m, m, dtype=np.float64))
            steps = np.round((m.astype(np.float64) @ axes) / length[:, None] * 1e5).astype(np.int64)
            cols = [[xxhash.xxh3_64_intdigest(r, seed) for r in rows] for rows in (m, steps) for seed in (index.seed, index.seed + 1)]
            ids = batch.column(0).take(pa.array(at))
            picked = np.array([xxhash.xxh3_64_intdigest(i.tobytes(), index.seed) & 0xFFFFFFFF for i in ids.to_numpy().astype("<i8")]) < limit
            low = np.full(len(at), None, object)
            low[picked] = [r.tobytes() for r in _narrow(unit(m[picked]), index).astype("<f4")]
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(np.array(c, np.uint64).view(np.int64)) for c in cols], pa.array(low.tolist(), pa.binary())], names=["vec_id", "h1", "h2", "d1", "d2", "low"])

    return run


def _copies(hashed: DataFrame, index: GraphIndex) -> DataFrame:
    """``(vec_id, rep, n)`` of the usable vectors that have copies; ``rep`` is the smallest id of the ``n``.

    Copies are equal vectors, and vectors of equal direction where these are more than ``k``.
    """
    aligned = hashed.groupBy("d1", "d2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")).where(F.col("n") > index.k)
    equal = hashed.join(aligned, ["d1", "d2"], "left_anti")
    classes = equal.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return salted_join(hashed, aligned, ["d1", "d2"]).select("vec_id", "rep", "n").unionByName(salted_join(equal, classes, ["h1", "h2"]).select("vec_id", "rep", "n"))


def _codes(low: np.ndarray) -> np.ndarray:
    """Each row in steps of its largest number's 127th, a byte a number."""
    return np.round(low / np.maximum(np.abs(low).max(1, keepdims=True), 1e-9) * 127).astype(np.int8)


def _decoded(codes: np.ndarray) -> np.ndarray:
    """Unit vectors of codes."""
    low = codes.astype(np.float32)
    return low / np.maximum(np.linalg.norm(low, axis=1, keepdims=True), 1e-9)


def _route(index: GraphIndex, centres: np.ndarray, parts: np.ndarray):
    """Batches of ``(vec_id, features)`` to codes for the regions: one at home, the others as visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(64, min(4096, 8_000_000 // len(centres)))
        visits = min(index.visits, len(centres))
        for whole in batches:
            for begin in range(0, whole.num_rows, step):
                batch = whole.slice(begin, step)
                at, m = matrix(batch.column(1), index.dim)
                if not len(at):
                    continue
                ids = batch.column(0).to_numpy(zero_copy_only=False)[at].astype(np.int64)
                low = _narrow(unit(m), index)
                near = low @ centres.T
                order = np.argpartition(-near, visits - 1, axis=1)[:, :visits]
                score = np.take_along_axis(near, order, 1)
                by = np.argsort(-score, axis=1, kind="stable")
                order, score = np.take_along_axis(order, by, 1), np.take_along_axis(score, by, 1)
                codes = np.array([r.tobytes() for r in _codes(low)], dtype=object)
                home_part = (ids * 2654435761 % 4294967291) % parts[order[:, 0]]
                cols: list[list] = [[], [], [], [], []]
                for v in range(visits):
                    goes = score[:, v] >= score[:, 0] - index.margin
                    for part in range(int(parts[order[goes, v]].max(initial=0))):
                        rows = np.nonzero(goes & (part < parts[order[:, v]]))[0]
                        home = np.full(len(rows), v == 0) & (home_part[rows] == part)
                        for c, x in zip(cols, (order[rows, v], np.full(len(rows), part), home, ids[rows], codes[rows])):
                            c.append(x)
                region, part, home, vec, code = (np.concatenate(c) for c in cols)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(region, pa.int32()), pa.array(part, pa.int32()), pa.array(home, pa.bool_()), pa.array(vec, pa.int64()), pa.array(list(code), pa.binary())],
                    names=["region", "part", "home", "vec_id", "code"],
                )

    return run


def _nearest_codes(codes: np.ndarray, index: GraphIndex) -> tuple[np.ndarray, np.ndarray]:
    """Positions and similarities of the ``near`` nearest others of each code; -1 and -9 fill the rest."""
    wanted = max(1, len(codes) // index.cell_rows)
    some = np.random.default_rng(index.seed).permutation(len(codes))[: 64 * wanted]
    centres = fit_centres(_decoded(codes[some]), wanted, index.seed, 4)
    cell = np.concatenate([_nearest_centre(_decoded(codes[at : at + 32_768]), centres) for at in range(0, len(codes), 32_768)])
    by = np.argsort(cell, kind="stable")
    bounds = np.searchsorted(cell[by], np.arange(len(centres) + 1))
    probes = min(index.probes, len(centres))
    ids = np.full((len(codes), index.near), -1, np.int32)
    sims = np.full((len(codes), index.near), -9, np.float32)
    for at in range(0, len(codes), 32_768):
        q = _decoded(codes[at : at + 32_768])
        own = at + np.arange(len(q), dtype=np.int32)
        i, s = ids[at : at + 32_768], sims[at : at + 32_768]
        to = np.empty((len(q), probes), np.int32)
        for c in range(0, len(q), 4096):
            d = q[c : c + 4096] @ centres.T
            first = np.argpartition(-d, probes - 1, axis=1)[:, :probes]
            to[c : c + 4096] = np.take_along_axis(first, np.argsort(-np.take_along_axis(d, first, 1), axis=1), 1)
        for rank in range(probes):
            order = np.argsort(to[:, rank], kind="stable")
            edge = np.searchsorted(to[order, rank], np.arange(len(centres) + 1))
            for c in np.nonzero(np.diff(edge) * np.diff(bounds))[0]:
                there = by[bounds[c] : bounds[c + 1]].astype(np.int32)
                cell_codes = _decoded(codes[there]).T
                asked = order[edge[c] : edge[c + 1]]
                for begin in range(0, len(asked), 2048):
                    rows = asked[begin : begin + 2048]
                    d = q[rows] @ cell_codes
                    d[there[None, :] == own[rows, None]] = -9
                    better = (d > s[rows].min(1)[:, None]).any(1)
                    rows, d = rows[better], np.concatenate([s[rows[better]], d[better]], 1)
                    if not len(rows):
                        continue
                    top = np.argpartition(-d, index.near - 1, axis=1)[:, : index.near]
                    both = np.concatenate([i[rows], np.broadcast_to(there, (len(rows), len(there)))], 1)
                    i[rows], s[rows] = np.take_along_axis(both, top, 1), np.take_along_axis(d, top, 1)
    ids[sims <= -9] = -1
    return ids, sims


_LABELS = "vec_id bigint, label bigint, sim float, kth float"


def _label_region(index: GraphIndex):
    """One region's codes to ``(vec_id, label, sim, kth)``: the labels of what is near each code, the most similar that has it, and the ``k``-th similarity."""

    def run(region: pa.Table) -> pa.Table:
        home = region.column("home").to_numpy()
        ids = region.column("vec_id").to_numpy()
        order = np.lexsort((ids, ~home))
        ids, members = ids[order], int(home.sum())
        if members == 0:
            return pa.table({"vec_id": pa.array([], pa.int64()), "label": pa.array([], pa.int64()), "sim": pa.array([], pa.float32()), "kth": pa.array([], pa.float32())})
        column = region.column("code").combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
        flat = np.frombuffer(column.buffers()[2], np.int8)
        start = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
        codes = flat[start:][: len(ids) * min(index.dim, index.width)].reshape(len(ids), -1)[order]
        near, sim = _nearest_codes(codes, index)
        kth = np.partition(sim, index.near - index.k, axis=1)[:, index.near - index.k] if index.near > index.k else sim.min(1)
        keep = (near >= 0) & (near < members) & (sim >= kth[:, None] - index.slack)
        # a label is handed on among those at home only, and where both are about as near as the other's best:
        # what has its near ones across a border would else tie strangers together
        label = (ids[:members].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
        r, c = np.nonzero(keep[:members])
        n = near[r, c]
        mutual = sim[r, c] >= kth[n] - index.slack
        r, n = r[mutual], n[mutual]
        last = label.copy()
        for _ in range(index.rounds):
            step = last.copy()
            np.minimum.at(step, r, last[n])
            np.minimum.at(step, n, last[r])
            last = step
            # where all hangs together a label is handed on less far, so that groups stay small
            _, back, count = np.unique(step, return_inverse=True, return_counts=True)
            label = np.where(count[back] <= index.shard_rows, step, label)
        r, c = np.nonzero(keep)
        rows = np.concatenate([r, np.arange(members)])
        labels = np.concatenate([label[near[r, c]], label])
        sims = np.concatenate([sim[r, c], np.ones(members, np.float32)])
        by = np.lexsort((-sims, labels, rows))
        rows, labels, sims = rows[by], labels[by], sims[by]
        first = np.ones(len(rows), bool)
        first[1:] = (rows[1:] != rows[:-1]) | (labels[1:] != labels[:-1])
        rows, labels, sims = rows[first], labels[first], sims[first]
        return pa.table({"vec_id": pa.array(ids[rows], pa.int64()), "label": pa.array(labels, pa.int64()), "sim": pa.array(sims, pa.float32()), "kth": pa.array(kth[rows], pa.float32())})

    return run


def _groups(labelled: DataFrame, index: GraphIndex) -> DataFrame:
    """``(vec_id, group)`` of each code: the labels of what is about as near it as the best ``k`` of all its regions.

    A label becomes the smallest that goes with it in some vector, so what a region's border parts is together again,
    unless that would make a group too large for a shard.
    """
    each = labelled.groupBy("vec_id").agg(F.max("kth").alias("kth"), F.collect_list(F.struct("label", "sim")).alias("seen"))
    kept = F.array_distinct(F.transform(F.filter("seen", lambda x: x["sim"] >= F.col("kth") - F.lit(index.slack)), lambda x: x["label"]))
    each = cut(each.select("vec_id", kept.alias("labels")))
    pairs = each.select("vec_id", F.explode("labels").alias("label"), F.array_min("labels").alias("least"))
    least = pairs.groupBy("label").agg(F.min("least").alias("group"), F.count(F.lit(1)).alias("n"))
    too_large = least.groupBy("group").agg(F.sum("n").alias("all")).where(F.col("all") > index.shard_rows).select("group", F.lit(True).alias("too_large"))
    least = least.join(too_large, "group", "left").select("label", F.when(F.col("too_large"), F.col("label")).otherwise(F.col("group")).alias("group"))
    return cut(pairs.select("vec_id", "label").join(least, "label").select("vec_id", "group").distinct())


_PACKED = "vec_id bigint, data binary"


def _packed(index: GraphIndex):
    """Batches of ``(vec_id, features)`` to the usable vectors as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, m = matrix(batch.column(1), index.dim)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(pack(m), pa.binary())], names=["vec_id", "data"])

    return run


def _best(q: np.ndarray, n: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best rows of each ``q``: highest ``c``, then smallest ``n``; repeats once."""
    order = np.lexsort((n, -c, q))
    q, n = q[order], n[order]
    fresh = np.ones(len(q), bool)
    fresh[1:] = (q[1:] != q[:-1]) | (n[1:] != n[:-1])
    order, q = order[fresh], q[fresh]
    first = np.concatenate([[0], np.nonzero(np.diff(q))[0] + 1]) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return order[rank < k]


def _search_shard(index: GraphIndex):
    """One shard to ``(vec_id, other_id, cosine)``: the best ``k`` seen from each vector."""

    def run(shard: pa.Table) -> pa.Table:
        home = shard.column("home").to_numpy()
        ids = shard.column("vec_id").to_numpy()
        order = np.lexsort((ids, ~home))
        ids, members = ids[order], int(home.sum())
        full = unpack([x for x in shard.column("data").take(pa.array(order)).to_pylist()], index.dim)
        none = pa.table({"vec_id": pa.array([], pa.int64()), "other_id": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())})
        if members == 0 or len(ids) < 2:
            return none
        u = unit(full)
        length = np.sqrt(np.einsum("ij,ij->i", full, full, dtype=np.float64))
        keep = index.k + 3
        qs, ns = [], []
        for at in range(0, len(u), 512):
            near = u[at : at + 512] @ u[:members].T
            own = np.arange(at, min(at + len(near), members))
            near[own - at, own] = -9
            take, last = min(keep, members), min(index.k, members)
            top = -np.partition(-near, sorted({last - 1, take - 1}), axis=1)
            # whatever may tie with the k-th once rounded goes to the exact ranking too
            least = np.minimum(top[:, take - 1], top[:, last - 1] - 2e-6)
            r, c = np.nonzero((near >= least[:, None]) & (near > -9))
            qs.append(at + r)
            ns.append(c)
        q, n = np.concatenate(qs), np.concatenate(ns)
        cos = np.empty(len(q))
        for at in range(0, len(q), 8192):
            a, b = q[at : at + 8192], n[at : at + 8192]
            cos[at : at + 8192] = np.einsum("ij,ij->i", full[a].astype(np.float64), full[b].astype(np.float64)) / (length[a] * length[b])
        cos = np.round(cos, 6)
        # what one side finds serves the other too
        q, n, cos = np.concatenate([ids[q], ids[n]]), np.concatenate([ids[n], ids[q]]), np.concatenate([cos, cos])
        best = _best(q, n, cos, index.k)
        return pa.table({"vec_id": pa.array(q[best], pa.int64()), "other_id": pa.array(n[best], pa.int64()), "cosine": pa.array(cos[best], pa.float64())})

    return run


def nearest(df: DataFrame, id_col: str = "vec_id", features: str = "features", index: GraphIndex = GraphIndex()) -> DataFrame:
    """``vec_id, rank, other_id, cosine``: the ``k`` most similar other vectors of each usable vector.

    Cosine is rounded to six decimals; of equals the smaller id goes first.
    Exact copies enter the index once, and so do more than ``k`` vectors that
    differ in gain only, so a vector copied a million times neither fills a
    shard nor hides its neighbours; each copy gets its own rows.  A family that
    differs in gain is ranked by the cosine of its smallest id towards others.  Vectors that aren't usable (null, wrong length, not finite, all
    zero) have no rows and are nobody's neighbour; a collection of one has
    none either.  Ids must be unique and not null.
    """
    spark, k = df.sparkSession, index.k
    df = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(features).alias("features"))
    rows = df.count()  # of the files' metadata
    hashed = cut(df.mapInArrow(_first_pass(index, min(1.0, index.sample / max(rows, 1))), _FIRST_PASS))
    drawn = hashed.where(F.col("low").isNotNull()).select("low").toArrow().column("low").to_pylist()
    if not drawn:
        return spark.createDataFrame([], "vec_id bigint, rank int, other_id bigint, cosine double")
    sample = np.frombuffer(b"".join(drawn), "<f4").reshape(len(drawn), -1)
    regions = max(-(-rows // index.region_rows), min(index.regions, -(-rows // (2 * index.shard_rows))))
    centres = fit_centres(sample, min(regions, max(1, len(sample) // index.per_centre)), index.seed)
    share = np.bincount(_nearest_centre(sample, centres), minlength=len(centres)) / len(sample)
    parts = np.maximum(1, np.ceil(share * regions / 2)).astype(np.int64)

    copies = cut(_copies(hashed.drop("low"), index))
    extra = copies.where(F.col("vec_id") != F.col("rep")).select("vec_id")
    # the ids that stay out go to every task only if few; else both sides are shuffled by id
    few_extra = extra.count() <= index.broadcast_ids
    routed = df.mapInArrow(_route(index, centres, parts), "region int, part int, home boolean, vec_id bigint, code binary")
    routed = routed.join(F.broadcast(extra) if few_extra else extra, "vec_id", "left_anti")
    # a task per region or shard or so, however many there are
    routed = routed.repartition(int(min(index.tasks, max(width(spark), 2 * parts.sum()))), "region", "part")
    groups = _groups(routed.groupBy("region", "part").applyInArrow(_label_region(index), _LABELS), index)
    sizes = groups.groupBy("group").count()
    total = sizes.agg(F.sum("count")).first()[0] or 0
    many = -(-total // index.shard_rows)
    # small groups share shards; a large one has shards of its own, numbered on
    large_groups = sizes.where(F.col("count") > 2 * index.shard_rows).select("group", F.ceil(F.col("count") / index.shard_rows).cast("int").alias("pieces"))
    placed = groups.join(large_groups, "group", "left")
    own_piece = F.pmod(F.xxhash64("vec_id"), F.coalesce("pieces", F.lit(1))).cast("int")
    placed = placed.select(
        "vec_id",
        F.when(F.col("pieces").isNull(), F.pmod(F.xxhash64("group"), F.lit(max(1, many)))).otherwise(F.col("group")).alias("shard"),
        own_piece.alias("own"),
        F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1)).alias("part"),
        F.col("pieces").isNotNull().alias("large"),
    )
    placed = placed.groupBy("vec_id", "shard", "part", "large").agg(F.max(F.col("own") == F.col("part")).alias("home"))
    shards = df.mapInArrow(_packed(index), _PACKED).join(placed, "vec_id").repartition(int(min(index.tasks, max(width(spark), 2 * many))), "shard", "part", "large")
    found = shards.groupBy("shard", "part", "large").applyInArrow(_search_shard(index), "vec_id bigint, other_id bigint, cosine double")

    # copies: each class stands for its k + 1 smallest ids
    few = copies.withColumn("no", F.row_number().over(Window.partitionBy("rep").orderBy("vec_id"))).where(F.col("no") <= k + 1).select("rep", F.col("vec_id").alias("copy_id"))
    others = (
        found.join(few.withColumnRenamed("rep", "other_id"), "other_id", "left")
        .select(F.col("vec_id").alias("rep"), F.coalesce("copy_id", "other_id").alias("other_id"), "cosine")
        .unionByName(few.select("rep", F.col("copy_id").alias("other_id"), F.lit(1.0).alias("cosine")))
    )
    # the set has at most k * (k + 1) rows of each shard part a vector was searched in
    lists = others.groupBy("rep").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("cosine")).alias("far"), F.col("other_id").alias("id")))), 1, k + 1).alias("near"))
    # each copy takes the list of its class, large classes by salts; all others are their own class
    salts = F.ceil(F.col("n") / index.copies_per_task).cast("bigint")
    salted = copies.select("rep", F.col("vec_id").alias("copy_id"), F.pmod(F.xxhash64("vec_id"), salts).alias("salt"))
    large = copies.where(F.col("vec_id") == F.col("rep")).select("rep", salts.alias("salts"))
    spread = lists.join(large, "rep", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("salts", F.lit(1)) - 1)))
    everyone = spread.join(salted, ["rep", "salt"], "left").select(F.when(F.col("salts").isNull(), F.col("rep")).otherwise(F.col("copy_id")).alias("vec_id"), "near").where(F.col("vec_id").isNotNull())
    own = F.slice(F.filter("near", lambda x: x["id"] != F.col("vec_id")), 1, k)
    out = everyone.select("vec_id", F.posexplode(own).alias("rank", "x"))
    return out.select("vec_id", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias("other_id"), (-F.col("x.far")).alias("cosine"))


def neighbour_pairs(near: DataFrame) -> DataFrame:
    """Pairs, smaller id first, of which at least one names the other."""
    return near.select(F.least("vec_id", "other_id").alias("vec_id_a"), F.greatest("vec_id", "other_id").alias("vec_id_b")).distinct()
