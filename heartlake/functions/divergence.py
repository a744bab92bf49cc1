"""Smoothed categorical distributions and their divergence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def smoothed(counts: Column, pseudo: float = 0.5) -> Column:
    """Probabilities of an array of counts, each raised by ``pseudo``.

    A negative count, or no count above zero, raises.
    """
    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    wrong = F.exists(counts, lambda x: x < 0) | (total <= 0)
    p = F.transform(counts, lambda x: (x + F.lit(pseudo)) / (total + F.lit(pseudo) * F.size(counts)))
    return F.when(wrong, F.raise_error(F.lit("counts must be nonnegative, with some above zero")).cast("array<double>")).otherwise(p)


def kl_nats(source: Column, target: Column, pseudo: float = 0.5) -> Column:
    """Kullback-Leibler divergence from ``source`` to ``target`` of two arrays of counts, in nats."""
    terms = F.zip_with(smoothed(source, pseudo), smoothed(target, pseudo), lambda p, q: p * F.ln(p / q))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)
