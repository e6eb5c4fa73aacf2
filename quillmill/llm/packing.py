"""Packing of tokenised documents into sequences: first-fit decreasing over a tournament tree.

A document's ids are cut at every ``SEQUENCE`` ids. Whole cuts are sequences of
their own; the remainders are dealt at random into groups of about
``GROUP_DOCUMENTS`` documents, and each group is packed by itself: pieces from
the longest to the shortest, each into the first bin that still holds it. The
tree's inner nodes hold the most room below them, so the first fitting bin is
found in a walk from the root.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .tokens import VOCABULARY, encoder

SEQUENCE = 2048
END = 1
GROUP_DOCUMENTS = 2048

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class TournamentTree:
    """Rooms of ``n`` bins, all ``capacity`` at first."""

    def __init__(self, n: int, capacity: int):
        self.size = 1 << max(0, (n - 1).bit_length())
        self.most = [capacity] * (2 * self.size)

    def place(self, length: int) -> int:
        """Put ``length`` into the first bin with room for it, and return the bin; -1 if none has."""
        most = self.most
        if most[1] < length:
            return -1
        i = 1
        while i < self.size:
            i *= 2
            if most[i] < length:
                i += 1
        bin_ = i - self.size
        most[i] -= length
        while i > 1:
            i //= 2
            a, b = most[2 * i], most[2 * i + 1]
            best = a if a > b else b
            if most[i] == best:
                break
            most[i] = best
        return bin_


def first_fit_decreasing(lengths: np.ndarray, capacity: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length. Lengths over the capacity are an error; equal lengths keep their order."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, filled = TournamentTree(max(1, len(lengths)), capacity), {}
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        if n > capacity:
            raise ValueError("a piece is longer than a sequence")
        bins[i] = b = tree.place(n)
        offsets[i] = filled.get(b, 0)
        filled[b] = int(offsets[i]) + n
    return bins, offsets


def _cut(vocabulary: str, groups: int, keep_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, count = encoder(vocabulary), TaskContext.get().partitionId(), 0
        deal = np.random.Generator(np.random.PCG64([part, 7]))  # the same on every attempt
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                b = whole.slice(a, 512)
                rows = []
                for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                    ids = np.append(encode(text or ""), np.uint32(END)).astype("<u4")
                    group = int(deal.integers(groups))
                    for start in range(0, len(ids), SEQUENCE):
                        piece = ids[start : start + SEQUENCE]
                        own = (part << 33 | count) if len(piece) == SEQUENCE else None
                        count += own is not None
                        rows.append((i, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), own, group, piece.tolist() if keep_ids else None))
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "own", "group", "ids"]
                kinds = [pa.int64()] * 7 + [pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    return cut


def _fill(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    bins, offsets = first_fit_decreasing(table.column("length").to_numpy())
    number = (key[0].as_py() << 33) | bins
    return table.drop_columns(["own", "group"]).append_column("sequence_id", pa.array(2 * number + 1)).append_column("offset", pa.array(offsets))


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, keep_ids: bool = False) -> DataFrame:
    """One row per piece of each row of ``docs`` (doc_id, text).

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    and with ``keep_ids`` the ids. A document's ids are those of its text and
    then ``END``; null and empty texts have ``END`` alone. Each id lies in one
    piece; pieces lie in their sequence without gaps from offset 0. Groups are
    drawn per row, so repeated rows, equal or null ids and equal texts spread
    like any others. Further columns are not read. Only rows of pieces shorter
    than a sequence are shuffled, without their text.
    """
    groups = max(1, math.ceil(docs.count() / GROUP_DOCUMENTS))
    pieces = docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").mapInArrow(
        _cut(vocabulary, groups, keep_ids), f"{_PIECE}, own long, group long, ids array<long>"
    )
    if not keep_ids:
        pieces = pieces.drop("ids")
    pieces = written(pieces, "pieces")  # both branches below read it: texts are tokenised once
    last = f"{_PIECE}, {'ids array<long>, ' if keep_ids else ''}sequence_id long, offset long"
    packed = pieces.where("own IS NULL").groupBy("group").applyInArrow(_fill, last)
    whole = pieces.where("own IS NOT NULL").drop("group").withColumns({"sequence_id": F.col("own") * 2, "offset": F.lit(0).cast("long")}).drop("own")
    return packed.unionByName(whole)
