"""Exact sizes and closer label shares of subsets and splits, by moving few whole subjects.

Subjects of one signature, the number of their recordings and the positives of
each label, are interchangeable, so moves are planned on counts per part and
signature.  Only signatures of few recordings are needed: they are a bounded
table, whatever the number of subjects.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import salted_join
from ..operators.ranking import place_by_hash

#: Recordings of the subjects that may move; with five labels there are at most
#: 4,424 signatures of up to four recordings.
MOVABLE = 4
#: In a part of so few subjects all may move.
SMALL = 1000


@dataclass(frozen=True)
class Goal:
    """Records and positives of each label that a part should have."""

    records: int
    labels: tuple[float, ...]


class Tally:
    """Movable subjects per part and signature, and what the parts hold beyond their goals."""

    def __init__(self, parts: Sequence[str], signatures: np.ndarray, counts: np.ndarray, over: np.ndarray):
        """``signatures``: recordings and positives, a row each.  ``counts``: subjects,
        part by signature.  ``over``: records and positives beyond the goals, a row a part."""
        self.parts, self.signatures, self.counts, self.over = list(parts), signatures, counts.copy(), over.astype(float)
        self.moves: dict[tuple[int, int, int], int] = {}

    def _move(self, a: int, b: int, s: int, n: int = 1) -> None:
        self.counts[a, s] -= n
        self.counts[b, s] += n
        self.over[a] -= n * self.signatures[s]
        self.over[b] += n * self.signatures[s]
        self.moves[a, b, s] = self.moves.get((a, b, s), 0) + n

    def _after(self, a: int, b: int, change: np.ndarray) -> np.ndarray:
        """Label errors of two parts if ``change`` (rows of positives) went from one to the other."""
        return np.abs(self.over[a, 1:] - change).sum(1) + np.abs(self.over[b, 1:] + change).sum(1)

    def fit_sizes(self) -> None:
        """Move subjects from the part furthest above its goal to the one furthest below, never past either.

        Where only larger ones are left, one goes and single ones come back for
        what it is too large.
        """
        exchanges = 64 * len(self.parts)
        while True:
            a, b = int(self.over[:, 0].argmax()), int(self.over[:, 0].argmin())
            room = min(self.over[a, 0], -self.over[b, 0])
            able = np.nonzero((self.counts[a] > 0) & (self.signatures[:, 0] <= room))[0]
            if room <= 0:
                return
            if not len(able):
                back = self.counts[b][self.signatures[:, 0] == 1].sum()
                large = np.nonzero((self.counts[a] > 0) & (self.signatures[:, 0] - room <= back))[0]
                if not len(large) or not exchanges:
                    return
                exchanges -= 1
                self._move(a, b, large[self.signatures[large, 0].argmin()])
                continue
            # the largest that fits, and of these the best for the labels
            size = self.signatures[able, 0]
            able = able[size == size.max()]
            self._move(a, b, able[self._after(a, b, self.signatures[able, 1:]).argmin()])

    def fit_labels(self, rounds: int = 10_000) -> None:
        """Swap subjects of equally many recordings while that brings labels closer to their goals."""
        for _ in range(rounds):
            best = (1e-9, None)
            for a in range(len(self.parts)):
                for b in range(a + 1, len(self.parts)):
                    now = np.abs(self.over[a, 1:]).sum() + np.abs(self.over[b, 1:]).sum()
                    if now < 1:
                        continue
                    for n in range(1, MOVABLE + 1):
                        # of very many signatures the commonest are tried
                        own, other = (np.nonzero((self.counts[p] > 0) & (self.signatures[:, 0] == n))[0] for p in (a, b))
                        own, other = (x[np.argsort(-self.counts[p][x], kind="stable")[:512]] for p, x in ((a, own), (b, other)))
                        if len(own) and len(other):
                            change = self.signatures[own, None, 1:] - self.signatures[None, other, 1:]
                            gain = now - self._after(a, b, change.reshape(-1, change.shape[2]))
                            at = int(gain.argmax())
                            if gain[at] > best[0]:
                                best = gain[at], (a, b, own[at // len(other)], other[at % len(other)])
            if best[1] is None:
                return
            a, b, s, t = best[1]
            self._move(a, b, s)
            self._move(b, a, t)

    def net(self) -> list[tuple[str, str, int, int]]:
        """Moves ``(from, to, signature, subjects)`` with opposite ones set off."""
        out = []
        for (a, b, s), n in self.moves.items():
            n -= self.moves.get((b, a, s), 0)
            if n > 0:
                out.append((self.parts[a], self.parts[b], s, n))
        return out


def refined(parts: DataFrame, subjects: DataFrame, subject: str, out: str, goals: Mapping[str, Goal], labels: Sequence[str], seed: int) -> DataFrame:
    """``parts`` (``subject, out``) after moves that bring each part to its goal.

    Sizes come first: with enough subjects of few recordings they are met
    exactly.  Then swaps that keep them bring the labels closer.  A subject is
    never split.  Which subjects of a signature move is decided by a hash.
    """
    if len(goals) < 2:
        return parts
    spark, names = parts.sparkSession, list(goals)
    signature = ["n_recordings", *labels]
    both = salted_join(parts, subjects.select(subject, *signature), [subject])
    held = both.groupBy(out).agg(F.count(F.lit(1)).alias("subjects"), F.sum("n_recordings").alias("n_recordings"), *[F.sum(x).alias(x) for x in labels]).collect()
    over = np.zeros((len(names), len(signature)))
    for r in held:
        over[names.index(r[out])] = [float(r[x] or 0) for x in signature]
    over -= np.array([[goals[k].records, *goals[k].labels] for k in names], float)
    may = (F.col("n_recordings") <= MOVABLE) | F.col(out).isin([r[out] for r in held if r["subjects"] <= SMALL])
    few = both.where(may).groupBy(out, *signature).agg(F.count(F.lit(1)).alias("n")).collect()
    kinds = sorted({tuple(int(r[x]) for x in signature) for r in few})
    if not kinds:
        return parts
    counts = np.zeros((len(names), len(kinds)), np.int64)
    for r in few:
        counts[names.index(r[out]), kinds.index(tuple(int(r[x]) for x in signature))] = r["n"]
    tally = Tally(names, np.array(kinds), counts, over)
    tally.fit_sizes()
    tally.fit_labels()
    tally.fit_sizes()
    moves = tally.net()
    if not moves:
        return parts
    # moves of one part and signature take successive places
    spans, used = [], {}
    for a, b, s, n in moves:
        first = used.get((a, s), 0)
        used[a, s] = first + n
        spans.append((a, *kinds[s], b, first, first + n))
    schema = f"{out} string, " + ", ".join(f"{x} bigint" for x in signature) + ", __to string, __first bigint, __last bigint"
    table = F.broadcast(spark.createDataFrame(spans, schema))  # of at most the moves, which signatures bound
    movable = both.where(may).select(out, *[F.col(x).cast("bigint").alias(x) for x in signature], subject)
    placed = place_by_hash(movable, [out, *signature], subject, seed + 1)
    gone = placed.join(table, [out, *signature]).where((F.col("place") > F.col("__first")) & (F.col("place") <= F.col("__last"))).select(subject, F.col("__to"))
    return parts.join(gone, subject, "left").select(subject, F.coalesce("__to", out).alias(out))
