"""Byte-level byte pair encoding with the ranks of a public vocabulary.

A piece of text is a doubly linked list of symbols.  Candidate merges wait in
a priority queue by rank and place; an entry whose symbols have changed since
is stale and skipped.  Decoding joins the vocabulary's byte strings.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed value: the pattern that cuts a text into pieces, as published with the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Where the vocabulary files lie unless told otherwise.
FOLDER = "/opt/tokenizers"


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a ranks file: base64 of the byte string, blank, id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    """Text to ids and back.

    ``keep`` bounds the number of pieces whose ids are remembered; when it is
    reached the memory is emptied, so very varied text costs time, not space.
    """

    def __init__(self, ranks: dict[bytes, int], keep: int = 200_000):
        self.ranks, self.keep = ranks, keep
        self.strings = {v: k for k, v in ranks.items()}
        self.cut = regex.compile(PATTERN)
        self.known: dict[str, list[int]] = {}

    def piece(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        ranks, n = self.ranks, len(data)
        symbol: list[bytes | None] = [data[i : i + 1] for i in range(n)]
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = []
        for i in range(n - 1):
            r = ranks.get(data[i : i + 2])
            if r is not None:
                queue.append((r, i, 2))
        heapify(queue)
        while queue:
            rank, i, length = heappop(queue)
            left = symbol[i]
            if left is None:
                continue
            j = after[i]
            if j < 0 or len(left) + len(symbol[j]) != length or ranks.get(left + symbol[j]) != rank:
                continue  # stale
            symbol[i], symbol[j] = left + symbol[j], None
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                r = ranks.get(symbol[i] + symbol[k])
                if r is not None:
                    heappush(queue, (r, i, len(symbol[i]) + len(symbol[k])))
            h = before[i]
            if h >= 0:
                r = ranks.get(symbol[h] + symbol[i])
                if r is not None:
                    heappush(queue, (r, h, len(symbol[h]) + len(symbol[i])))
        return [ranks[s] for s in symbol if s is not None]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text without special tokens; an empty or null text has none.

        Strings that look like special tokens are ordinary text.
        """
        out: list[int] = []
        if not text:
            return out
        known = self.known
        for p in self.cut.findall(text):
            ids = known.get(p)
            if ids is None:
                ids = self.piece(p.encode("utf-8"))
                if len(known) >= self.keep:
                    known.clear()
                if len(p) <= 64:
                    known[p] = ids
            out += ids
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(self.strings[i] for i in ids).decode("utf-8", errors="replace")


def encoded(df: DataFrame, id_col: str, text: str, folder: str = FOLDER, name: str = "byte_bpe_50k") -> DataFrame:
    """``id_col, ids``: the token ids of each text, one row per row of ``df``.

    Every worker reads the vocabulary from ``folder``; a null or empty text has
    an empty list.  Rows stay in their partitions: no shuffle.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    path = f"{folder}/{name}.tiktoken"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(read_ranks(path))
        for batch in batches:
            column = batch.column(1)
            for at in range(0, batch.num_rows, 1024):
                part = column.slice(at, 1024)
                lists = [encoder.encode(t.as_py()) for t in part]
                ends = np.zeros(len(lists) + 1, np.int32)
                np.cumsum([len(x) for x in lists], out=ends[1:])
                flat = pa.array([i for x in lists for i in x], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1024), pa.ListArray.from_arrays(pa.array(ends), flat)], names=[id_col, "ids"])

    return df.select(id_col, text).mapInArrow(run, f"{id_col} {id_type}, ids array<int>")
