"""Robust-pruned directed graph over one shard of vectors, in NumPy batches.

Everything here works on one shard that fits one task.  Points are inserted in
doubling batches: the batch searches the graph built so far, the proposals of
these greedy searches are pruned by the relaxed distance rule, and the edges
are mirrored (and pruned again where a list overflows).  Searches run in lock
step over all queries of a batch, so NumPy and not the interpreter does the
work.  Navigation uses a low-dimensional orthonormal projection of the unit
vectors; the caller re-ranks the proposals with the full vectors.
"""

from __future__ import annotations

import numpy as np


def orthonormal(dim: int, width: int, seed: int) -> np.ndarray:
    """``dim x width`` matrix of orthonormal columns, equal for equal seeds."""
    width = min(dim, width)
    g = np.random.default_rng(seed).standard_normal((dim, width))
    q, _ = np.linalg.qr(g)
    return np.ascontiguousarray(q, dtype=np.float32)


class ShardGraph:
    """Directed graph with at most ``degree`` out-edges per point.

    ``relax`` is the pruning slack: a proposal is dropped when a kept
    neighbour is nearer to it than the point is, by that factor.
    """

    def __init__(self, points: np.ndarray, degree: int = 16, pool: int = 32, expand: int = 12, relax: float = 1.1, again: bool = False, seed: int = 1):
        self.points = np.ascontiguousarray(points, dtype=np.float32)
        self.sq = np.einsum("ij,ij->i", self.points, self.points)
        self.degree, self.pool, self.expand, self.relax, self.again = degree, pool, expand, relax, again
        n = len(self.points)
        self.edges = np.full((n, degree), -1, dtype=np.int32)
        self.order = np.random.default_rng(seed).permutation(n).astype(np.int32)
        self.entries = self.order[: min(n, 64)]
        self._build()

    # -- distances are half squared ones, up to the query's own norm: |p|^2/2 - p.q

    def _build(self) -> None:
        n = len(self.points)
        done = min(n, 192)
        first = self.order[:done]
        p = self.points[first]
        d = self.sq[first][None, :] / 2 - p @ p.T
        np.fill_diagonal(d, np.inf)
        k = min(done - 1, 48)
        if k < 1:
            return
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        self._link(first, first[near], np.take_along_axis(d, near, 1))
        while done < n:
            size = min(done, n - done, 2048)
            batch = self.order[done : done + size]
            ids, dist = self.search(self.points[batch])
            self._link(batch, ids, dist)
            done += size
        for at in range(0, n if self.again else 0, 2048):
            batch = self.order[at : at + 2048]
            ids, dist = self.search(self.points[batch], start=batch)
            old = self.edges[batch]
            more = np.where(old < 0, 0, old)
            far = self.sq[more] / 2 - np.matmul(self.points[more], self.points[batch][:, :, None])[:, :, 0]
            far[(old < 0) | (old[:, :, None] == ids[:, None, :]).any(2)] = np.inf
            self._link(batch, np.concatenate([ids, old], 1), np.concatenate([dist, far], 1))

    def _link(self, own: np.ndarray, cand: np.ndarray, dist: np.ndarray) -> None:
        """Prune the proposals of ``own``, store them and mirror the edges."""
        for at in range(0, len(own), 1024):
            o = own[at : at + 1024]
            self.edges[o] = self._prune(o, cand[at : at + 1024], dist[at : at + 1024])
        kept = self.edges[own]
        src = np.repeat(own, kept.shape[1])
        dst = kept.ravel()
        good = dst >= 0
        src, dst = src[good], dst[good]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        nodes, start, count = np.unique(dst, return_index=True, return_counts=True)
        width = int(min(count.max(initial=0), 2 * self.degree))
        slot = np.arange(len(dst)) - np.repeat(start, count)
        # a point that is near to very many keeps the mirror edges of a random
        # 2 * degree of them; the others still hold their edge to it
        inside = slot < width
        more = np.full((len(nodes), width), -1, dtype=np.int32)
        more[np.repeat(np.arange(len(nodes)), count)[inside], slot[inside]] = src[inside]
        both = np.concatenate([self.edges[nodes], more], axis=1)
        for at in range(0, len(nodes), 1024):
            o, b = nodes[at : at + 1024], both[at : at + 1024]
            b = _without_repeats(b)
            fits = (b >= 0).sum(1) <= self.degree
            if fits.any():
                left = np.sort(b[fits], axis=1)[:, ::-1][:, : self.degree]
                self.edges[o[fits]] = left
            if (~fits).any():
                o, b = o[~fits], b[~fits]
                q = self.points[o]
                dd = self.sq[b] / 2 - np.matmul(self.points[b], q[:, :, None])[:, :, 0]
                dd[b < 0] = np.inf
                self.edges[o] = self._prune(o, b, dd)

    def _prune(self, own: np.ndarray, cand: np.ndarray, dist: np.ndarray) -> np.ndarray:
        """The relaxed rule over all of ``own`` at once; -1 fills short lists."""
        dist = np.where((cand < 0) | (cand == own[:, None]), np.inf, dist)
        order = np.argsort(dist, axis=1)
        cand, dist = np.take_along_axis(cand, order, 1), np.take_along_axis(dist, order, 1)
        v = self.points[cand]
        gram = np.matmul(v, v.transpose(0, 2, 1))
        sq = self.sq[cand]
        to_own = np.maximum(2 * dist + self.sq[own][:, None], 0)
        alive = np.isfinite(dist)
        out = np.full((len(own), self.degree), -1, dtype=np.int32)
        rows = np.arange(len(own))
        slack = self.relax * self.relax
        for k in range(self.degree):
            pick = alive.argmax(1)
            some = alive[rows, pick]
            if not some.any():
                break
            out[some, k] = cand[rows, pick][some]
            apart = np.maximum(sq + sq[rows, pick][:, None] - 2 * gram[rows, pick], 0)
            alive &= slack * apart > to_own
            alive[rows, pick] = False
        return out

    def search(self, queries: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of all ``queries`` in lock step.

        Returns the pool of each query, nearest first, as ids and distances;
        -1 and infinity fill the rest.  ``start`` gives each query an entry point of its own.
        """
        out_i, out_d = [], []
        step = max(64, min(2048, 32_000_000 // max(1, len(self.points))))
        for at in range(0, len(queries), step):
            i, d = self._search(queries[at : at + step], None if start is None else start[at : at + step])
            out_i.append(i)
            out_d.append(d)
        return np.concatenate(out_i), np.concatenate(out_d)

    def _search(self, q: np.ndarray, start: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        m, n, pool = len(q), len(self.points), self.pool
        seen = np.zeros((m, n), dtype=bool)
        rows = np.arange(m)
        d0 = self.sq[self.entries] / 2 - q @ self.points[self.entries].T
        k = min(4, len(self.entries))
        near = np.argpartition(d0, k - 1, axis=1)[:, :k]
        ids = self.entries[near]
        dist = np.take_along_axis(d0, near, 1)
        if start is not None:
            ids = np.where(ids == start[:, None], -1, ids)
            dist = np.where(ids < 0, np.inf, dist)
            own = self.sq[start] / 2 - np.einsum("ij,ij->i", q, self.points[start])
            ids, dist = np.concatenate([start[:, None], ids], 1), np.concatenate([own[:, None], dist], 1)
            k += 1
        fill = pool - k
        ids = np.concatenate([ids, np.full((m, fill), -1, np.int32)], 1).astype(np.int32)
        dist = np.concatenate([dist, np.full((m, fill), np.inf, np.float32)], 1).astype(np.float32)
        fresh = ids >= 0
        seen[rows[:, None], np.where(fresh, ids, ids[:, :1])] = True
        order = np.argsort(dist, axis=1)
        ids, dist, fresh = (np.take_along_axis(x, order, 1) for x in (ids, dist, fresh))
        live = rows
        while len(live):
            top = fresh[live, : self.expand]
            first = top.argmax(1)
            has = top[np.arange(len(live)), first]
            live, first, top = live[has], first[has], top[has]
            if not len(live):
                break
            a = np.arange(len(live))
            top[a, first] = False
            second = top.argmax(1)
            two = top[a, second]
            node = ids[live, first]
            fresh[live, first] = False
            other = np.where(two, ids[live, second], -1)
            fresh[live[two], second[two]] = False
            nb = np.concatenate([self.edges[node], np.where(other[:, None] >= 0, self.edges[other], -1)], 1)
            bad = nb < 0
            nb0 = np.where(bad, 0, nb)
            bad |= seen[live[:, None], nb0]
            seen[live[:, None], nb0] |= ~bad
            # the distances of the new neighbours only, in one flat gather
            r, c = np.nonzero(~bad)
            flat = nb0[r, c]
            nd = np.full(nb.shape, np.inf, np.float32)
            nd[r, c] = self.sq[flat] / 2 - np.einsum("ij,ij->i", self.points[flat], q[live[r]])
            # a neighbour that both expanded points have is new only once
            all_i = np.concatenate([ids[live], nb0.astype(np.int32)], 1)
            all_d = np.concatenate([dist[live], nd], 1)
            all_f = np.concatenate([fresh[live], ~bad], 1)
            order = np.argsort(all_d, axis=1)
            all_i, all_d, all_f = (np.take_along_axis(x, order, 1) for x in (all_i, all_d, all_f))
            twice = np.zeros(all_i.shape, bool)
            twice[:, 1:] = (all_i[:, 1:] == all_i[:, :-1]) & np.isfinite(all_d[:, 1:])
            if twice.any():
                all_d[twice] = np.inf
                all_f[twice] = False
                order = np.argsort(all_d, axis=1, kind="stable")
                all_i, all_d, all_f = (np.take_along_axis(x, order, 1) for x in (all_i, all_d, all_f))
            all_f &= np.isfinite(all_d)
            ids[live], dist[live], fresh[live] = all_i[:, :pool], all_d[:, :pool], all_f[:, :pool]
        return np.where(np.isfinite(dist), ids, -1), dist


def _without_repeats(lists: np.ndarray) -> np.ndarray:
    """Each row's ids once; repeats become -1."""
    s = np.sort(lists, axis=1)
    s[:, 1:][s[:, 1:] == s[:, :-1]] = -1
    return s
