"""Sharded automata: which evaluation passages stand in which training texts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import width

#: Fence around a field; neither occurs in data after ``fenced``.
_BEGIN, _END = "\u0001", "\u0002"


def fenced(kind: str, field: Column) -> Column:
    """A field as a text of its own: a match can neither begin nor end inside it."""
    return F.concat(F.lit(kind + _BEGIN), F.translate(field, _BEGIN + _END, ""), F.lit(_END))


def step(name: Column, last: bool) -> Column:
    """One step of a path as a passage of the fenced path: a folder, or what the path ends in."""
    return F.concat(F.lit("/"), F.translate(name, _BEGIN + _END, ""), F.lit(_END if last else "/"))


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one shard, evaluation passages (side 0) first, to the passages found."""
    import ahocorasick

    automaton, passages, found, ready = ahocorasick.Automaton(), 0, set(), False
    for batch in batches:
        for side, text in zip(batch["side"], batch["text"]):
            if side == 0:
                automaton.add_word(text, text)
                passages += 1
            elif passages:
                if not ready:
                    automaton.make_automaton()
                    ready = True
                found.update(passage for _, passage in automaton.iter(text))
    yield pd.DataFrame({"text": sorted(found)}, dtype=object)


def matched_passages(evaluation: DataFrame, training: DataFrame, text: str = "text", anchor: str | None = None, anchors: str | None = None, rows_per_task: int = 200_000) -> DataFrame:
    """The distinct evaluation passages (column ``text``) that training texts hold.

    A passage stands in the shard of its ``anchor``, a part of it that every
    text with the passage names among its ``anchors`` (an array); a text goes
    to the shards of all its anchors, so no shard lacks a text that could match.
    Without these columns passages and texts are whole ``fenced`` fields and
    anchor themselves.  Each shard builds one Aho-Corasick automaton from its
    passages and scans its texts.  Both sides are made distinct first (combined
    before the shuffle).  Texts of an anchor that very many have, a folder of a
    third of all files, are spread over shards by their content, and its
    passages sent to each.  Null texts are left out; with an empty side there
    are no matches.
    """
    one = evaluation.where(F.col(text).isNotNull()).select(F.col(anchor or text).alias("anchor"), F.col(text).alias("text")).distinct()
    many = training.where(F.col(text).isNotNull()).select(F.col(text).alias("text"), (F.col(anchors) if anchors else F.array(text)).alias("anchors")).dropDuplicates(["text"])
    many = many.select(F.explode(F.array_distinct("anchors")).alias("anchor"), "text")
    # at most the number of texts / rows_per_task anchors are hot
    hot = many.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows_per_task).select("anchor", F.ceil(F.col("n") / rows_per_task).cast("int").alias("salts"))
    salts = F.coalesce("salts", F.lit(1))
    a = one.join(hot, "anchor", "left").select(F.lit(0).alias("side"), "anchor", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), "text")
    b = many.join(hot, "anchor", "left").select(F.lit(1).alias("side"), "anchor", F.pmod(F.xxhash64("text"), salts).cast("int").alias("salt"), "text")
    shards = a.unionByName(b).repartition(2 * width(evaluation.sparkSession), "anchor", "salt").sortWithinPartitions("side")
    return shards.select("side", "text").mapInPandas(_scan, "text string").distinct()


def covered_length(spans: Column) -> Column:
    """Characters covered by an array of ``struct<a, b>`` half-open intervals, overlaps once."""
    start = F.struct(F.lit(0).alias("sum"), F.lit(-1).alias("end"))

    def step(done: Column, s: Column) -> Column:
        more = F.greatest(F.lit(0), s["b"] - F.greatest(s["a"], done["end"]))
        return F.struct((done["sum"] + more).alias("sum"), F.greatest(done["end"], s["b"]).alias("end"))

    return F.aggregate(F.array_sort(spans), start, step, lambda done: done["sum"])
