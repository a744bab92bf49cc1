"""Evaluation texts that stand, wholly or in part, in documents.

The search is for containment: how much of a short item stands in a document of
any length.  Items are parted by their number of shingles.  For each part the
documents are cut into blocks that fit its items, so a min-hash of an item and
one of a block agree with a chance that depends on the part's sizes alone, and
the number of min-hashes follows from the containment wanted.  The smallest
part holds the passages of all items, runs of ``passage`` words: windows of the
same length hold equal passages wholly, so one min-hash finds each.  Whatever
the search proposes is held against exact shingle containment.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import salted_join
from ..session import cut
from .markup import plain, without_tags

WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class LeakRule:
    """``passage``: successive words that make a leak.  ``shingle``: words of one hashed shingle.
    ``contained``: share of an item's shingles that makes it a leak though no passage
    of it is unbroken.  ``missed``: chance that an item just so contained isn't
    proposed; passages are never missed.  ``item_keys``: min-hashes of items that
    every task may hold, 8 bytes each; with more, documents' min-hashes are
    shuffled instead of tested where they are.  ``together``: candidate items that
    one row of a document is verified with.
    """

    passage: int = 12
    shingle: int = 5
    contained: float = 0.8
    missed: float = 0.001
    item_keys: int = 4_000_000
    together: int = 64
    seed: int = 5

    def __post_init__(self) -> None:
        if not 0 < self.shingle <= self.passage:
            raise ValueError("a shingle must fit in a passage")
        if not 0 < self.contained <= 1:
            raise ValueError("contained must lie in (0, 1]")

    def hashes(self) -> int:
        """Min-hashes of a block.

        Items of part ``c`` have ``2**c`` to ``2**(c + 1) - 1`` shingles, their
        blocks ``3 * 2**c`` at steps of ``2**c``, so each item fits in a block.
        An item of n shingles of which a share t stands in a block of m agrees
        with it in a min-hash with chance tn / (n + m - tn) at least.
        """
        t, n, m = self.contained, 1.0, 3.0
        agree = t * n / (n + m - t * n)
        return math.ceil(math.log(self.missed) / math.log(1 - agree))


def readings(text: str | None) -> list[list[str]]:
    """Letters and digits of a text in words; case, punctuation, mark-up, layout and invisible characters make no difference.

    A text with angles has two readings, without what may be mark-up and with it.
    """
    if not text:
        return []
    t = plain(text)
    kept = WORD.findall(t.casefold())
    bare = WORD.findall(without_tags(t).casefold()) if "<" in t else kept
    return [x for x in ([bare] if bare == kept else [bare, kept]) if x]


def words(text: str | None) -> list[str]:
    """The reading without mark-up."""
    found = readings(text)
    return found[0] if found else []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def hashed_words(tokens: list[str], seed: int) -> np.ndarray:
    """64-bit hashes of words; each different word is hashed once."""
    if not tokens:
        return np.zeros(0, np.uint64)
    coded = pa.array(tokens, pa.large_string()).dictionary_encode()
    each = np.array([xxhash.xxh3_64_intdigest(w, seed) for w in coded.dictionary.to_pylist()], np.uint64)
    return each[coded.indices.to_numpy()]


def shingles(hashed: np.ndarray, left: np.ndarray, size: int) -> np.ndarray:
    """One hash per word: of the run of ``size`` words that begins there, or the greatest number where fewer are ``left``."""
    n = len(hashed)
    out = np.zeros(n, np.uint64)
    padded = np.concatenate([hashed, np.zeros(size, np.uint64)])
    for k in range(size):
        out = _mix(out * np.uint64(0x100000001B3) + padded[k : k + n])
    out[left < size] = _LAST
    return out


def passage_keys(s: np.ndarray, left: np.ndarray, rule: LeakRule) -> np.ndarray:
    """For each word the min-hash of the window of ``passage`` words that begins there; the greatest number where none fits."""
    span, n = rule.passage - rule.shingle + 1, len(s)
    padded = np.concatenate([s, np.full(span, _LAST)])
    least = padded[:n].copy()
    for k in range(1, span):
        np.minimum(least, padded[k : k + n], out=least)
    least[left < rule.passage] = _LAST
    return least


def _part(counts: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64)


class Sketcher:
    """Min-hash keys of many texts at once.  A key tells part, hash function and min-hash."""

    def __init__(self, rule: LeakRule, parts: tuple[int, ...] = ()):
        self.rule, self.parts = rule, parts
        self.salts = np.random.default_rng(rule.seed).integers(1, 2**63, rule.hashes(), dtype=np.int64).astype(np.uint64)

    def _laid(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Owner and start of each reading, shingles, words left from each, owner of each word."""
        owner, tokens, sizes = [], [], []
        for i, text in enumerate(texts):
            for r in readings(text):
                owner.append(i)
                sizes.append(len(r))
                tokens += r
        sizes = np.array(sizes, np.int64)
        starts = np.cumsum(sizes) - sizes
        n = len(tokens)
        left = np.repeat(starts + sizes, sizes) - np.arange(n)
        s = shingles(hashed_words(tokens, self.rule.seed), left, self.rule.shingle) if n else np.zeros(0, np.uint64)
        return np.array(owner, np.int64), starts, s, left, sizes

    def _blocks(self, s: np.ndarray, stretches: list[tuple[np.ndarray, np.ndarray, int | np.ndarray]]) -> list[np.ndarray]:
        """For each ``(starts, ends, part)`` the ``block x hash`` keys of the stretches ``[start, end)`` of shingles, none empty."""
        out = [np.empty((len(a), len(self.salts)), np.uint64) for a, _, _ in stretches]
        bounds = [np.stack([a, z], 1).ravel() for a, z, _ in stretches]
        tags = [np.uint64(0x9E3779B97F4A7C15) * np.asarray(part + 1, np.uint64) for _, _, part in stretches]
        end = np.append(s, _LAST)
        none = end == _LAST
        for k, salt in enumerate(self.salts):
            h = _mix(end ^ salt)
            h[none] = _LAST
            for keys, at, tag in zip(out, bounds, tags):
                keys[:, k] = _mix(np.minimum.reduceat(h, at)[::2] + tag + np.uint64(k + 1))
        return out

    def of_items(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Owner, key and part (-1 for passages) of every min-hash of items."""
        owner, starts, s, left, sizes = self._laid(texts)
        if not len(s):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        each = np.repeat(owner, sizes)
        p = passage_keys(s, left, self.rule)
        fits = p != _LAST
        ids, keys, parts = [each[fits]], [p[fits]], [np.full(fits.sum(), -1)]
        whole = sizes >= self.rule.shingle
        if whole.any():
            count = sizes[whole] - self.rule.shingle + 1
            part = _part(count)
            k = self._blocks(s, [(starts[whole], starts[whole] + count, part)])[0]
            ids.append(np.repeat(owner[whole], k.shape[1]))
            keys.append(k.ravel())
            parts.append(np.repeat(part, k.shape[1]))
        return np.concatenate(ids), np.concatenate(keys), np.concatenate(parts)

    def of_documents(self, texts: list[str | None], known: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Owner and key of the min-hashes of documents, of the ``known`` keys only if these are given (sorted)."""
        owner, starts, s, left, sizes = self._laid(texts)
        none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        if not len(s):
            return none
        each = np.repeat(owner, sizes)
        p = passage_keys(s, left, self.rule)
        fits = p != _LAST
        fits[1:] &= (p[1:] != p[:-1]) | (each[1:] != each[:-1])
        ids, keys = [each[fits]], [p[fits]]
        count = sizes - self.rule.shingle + 1
        stretches = []
        for part in self.parts:
            step = 1 << part
            # fewer shingles can't hold the wanted share of an item of this part
            some = count >= max(1, math.floor(self.rule.contained * step))
            if not some.any():
                continue
            b = np.maximum(1, -(-count[some] // step) - 2)  # the last block reaches the end
            no = np.arange(b.sum()) - np.repeat(np.cumsum(b) - b, b)
            a = np.repeat(starts[some], b) + no * step
            stretches.append((a, np.minimum(a + 3 * step, np.repeat(starts[some] + count[some], b)), part))
            ids.append(np.repeat(np.repeat(owner[some], b), len(self.salts)))
        keys += [k.ravel() for k in self._blocks(s, stretches)] if stretches else []
        i, k = np.concatenate(ids), np.concatenate(keys)
        if known is not None:
            at = np.minimum(np.searchsorted(known, k), max(len(known) - 1, 0))
            hit = known[at] == k if len(known) else np.zeros(len(k), bool)
            i, k = i[hit], k[hit]
        by = np.lexsort((k, i))
        i, k = i[by], k[by]
        fresh = np.ones(len(i), bool)
        fresh[1:] = (i[1:] != i[:-1]) | (k[1:] != k[:-1])
        return i[fresh], k[fresh]


def _contained(rule: LeakRule):
    """Rows ``doc_id, text, item_ids, item_texts`` to ``doc_id, item_id, shared, passages, containment`` of leaks."""

    def runs(found: list[list[str]], size: int) -> set[tuple[str, ...]]:
        return {tuple(r[i : i + size]) for r in found for i in range(len(r) - size + 1)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[set, set]] = {}
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text, items, item_texts in zip(*(c.to_pylist() for c in batch.columns)):
                read = readings(text)
                own, small = runs(read, rule.passage), runs(read, rule.shingle)
                for item, item_text in zip(items, item_texts):
                    if item not in known:
                        if len(known) >= 20_000:
                            known.clear()
                        known[item] = runs([words(item_text)], rule.passage), runs([words(item_text)], rule.shingle)
                    passages, all_of = known[item]
                    shared = len(own & passages)
                    part = len(small & all_of) / len(all_of) if all_of else 0.0
                    if shared or part >= rule.contained:
                        for c, x in zip(out, (doc, item, shared, len(passages), round(part, 6))):
                            c.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "item_id", "shared", "passages", "containment"])

    return run


def leaked(documents: DataFrame, items: DataFrame, rule: LeakRule = LeakRule()) -> DataFrame:
    """The documents of ``contained`` that share an unbroken passage with the item."""
    return contained(documents, items, rule).where(F.col("shared") > 0)


def contained(documents: DataFrame, items: DataFrame, rule: LeakRule = LeakRule()) -> DataFrame:
    """``doc_id, item_id, shared, passages, containment``: documents that hold an item wholly or in part.

    ``shared`` of the item's ``passages`` (distinct runs of ``rule.passage``
    words) stand in the document; all of them if the item leaked whole.
    ``containment`` is the share of the item's shingles that do.  A leak shares
    a passage, which is never missed, or has ``rule.contained`` of the shingles
    without an unbroken passage, as edited or short items do.  Items of fewer
    words than a shingle can't leak; null and empty texts hold nothing.

    Documents are sketched where they are read and send only min-hashes that
    items have, tested against the items' sorted keys if these are few enough
    to be sent to every task; else the join shuffles both sides' keys, salted.
    A candidate document's text is fetched with its candidate items, a bounded
    number in each row.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(F.col("text").isNotNull())
    tests = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").alias("item_text")).where(F.col("item_text").isNotNull())

    def sketch_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(rule)
        for batch in batches:
            at, keys, parts = sketcher.of_items(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(keys.view(np.int64)), pa.array(parts, pa.int64())], names=["item_id", "key", "part"])

    wanted = cut(tests.mapInArrow(sketch_items, "item_id bigint, key bigint, part bigint").distinct())
    sizes = [r["part"] for r in wanted.select("part").where("part >= 0").distinct().collect()]  # at most 63
    few = wanted.select("key").distinct().limit(rule.item_keys + 1).toArrow().column("key").to_numpy().view(np.uint64)
    known = spark.sparkContext.broadcast(np.sort(few)) if len(few) <= rule.item_keys else None
    parts = tuple(sorted(sizes))

    def sketch_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(rule, parts)
        for batch in batches:
            texts = batch.column(1)
            for a, b in _portions(texts):
                at, keys = sketcher.of_documents(texts.slice(a, b - a).to_pylist(), None if known is None else known.value)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at + a)), pa.array(keys.view(np.int64))], names=["doc_id", "key"])

    seen = docs.mapInArrow(sketch_documents, "doc_id bigint, key bigint")
    pairs = wanted.select("key", "item_id").distinct()
    joined = seen.join(F.broadcast(pairs), "key") if known is not None and pairs.count() <= rule.item_keys else salted_join(seen, pairs, ["key"])
    candidates = cut(joined.select("doc_id", "item_id").distinct())
    groups = candidates.groupBy("doc_id").agg(F.ceil(F.count(F.lit(1)) / rule.together).alias("groups"))
    grouped = candidates.join(groups, "doc_id").withColumn("no", F.pmod(F.xxhash64("item_id"), "groups"))
    per_doc = grouped.join(tests, "item_id").groupBy("doc_id", "no").agg(F.collect_list("item_id").alias("items"), F.collect_list("item_text").alias("texts"))
    schema = "doc_id bigint, item_id bigint, shared int, passages int, containment double"
    return docs.join(per_doc, "doc_id").select("doc_id", "text", "items", "texts").mapInArrow(_contained(rule), schema)


def _portions(texts: pa.Array, most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Stretches of a batch of about ``most`` bytes, each text whole."""
    offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b
        a = b
