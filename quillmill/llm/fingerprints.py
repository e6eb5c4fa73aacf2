"""Bottom-k sketches of shingle hashes, as document fingerprints.

A sketch is the k least distinct 64-bit hashes of a text's shingles. The sketch
of two texts together is the k least of both sketches, so sketches of parts
merge to the sketch of the whole. Shingles here are runs of ``WIDTH`` bytes of
the UTF-8 text, the text led in by ``WIDTH - 1`` zero bytes, so that even a
text of one character has shingles and short texts can resemble each other.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts
from .kernels import _BYTE, distinct, mix, pieces, powers

K = 128
WIDTH = 12


class BottomK:
    def __init__(self, hashes: np.ndarray, k: int = K):
        self.hashes, self.k = hashes, k

    @classmethod
    def of_hashes(cls, h: np.ndarray, k: int = K) -> BottomK:
        if len(h) > 8 * k:  # most often the least 4k hold k distinct ones
            low = distinct(np.partition(h, 4 * k)[: 4 * k])
            if len(low) >= k:
                return cls(low[:k], k)
        return cls(distinct(h)[:k], k)

    @classmethod
    def parse(cls, text: str, k: int = K) -> BottomK:
        return cls(np.frombuffer(base64.b64decode(text), ">u8").astype(np.uint64), k)

    def __str__(self) -> str:
        return base64.b64encode(self.hashes.astype(">u8").tobytes()).decode()

    def merge(self, other: BottomK) -> BottomK:
        return BottomK(distinct(np.concatenate((self.hashes, other.hashes)))[: self.k], self.k)

    def distinct(self) -> float:
        """Number of distinct shingles: exact below k, else from the k-th least hash."""
        if len(self.hashes) < self.k:
            return float(len(self.hashes))
        return (self.k - 1) / ((float(self.hashes[-1]) + 1) / 2.0**64)

    def resemblance(self, other: BottomK) -> float:
        """Intersection over union; 1 for two empty sketches."""
        a, b = self.hashes, other.hashes
        if not len(a) + len(b):
            return 1.0
        both = np.sort(np.concatenate((a, b)))
        first = np.concatenate(([True], both[1:] != both[:-1]))
        size = min(self.k, other.k, int(first.sum()))
        place = np.cumsum(first)  # rank in the union; a hash of both stands there twice
        return int(np.count_nonzero(~first & (place <= size))) / size

    def containment(self, other: BottomK) -> float:
        """The share of this text's shingles that the other has too; 1 for an empty one."""
        n = self.distinct()
        return min(1.0, self.resemblance(other) * self.merge(other).distinct() / n) if n else 1.0


def sketches(texts: list[str | None], k: int = K, width: int = WIDTH) -> Iterator[BottomK]:
    """The sketch of each text, in order, many texts to a numpy call."""
    lead = b"\0" * (width - 1)
    for piece in pieces(texts):
        raw = [t.encode("utf-8", "surrogatepass") for t in piece]
        buf = np.frombuffer(b"".join(x for r in raw for x in (lead, r)), np.uint8)
        p, q = powers(len(buf) + 1)
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTE[buf] * p[: len(buf)], out=sums[1:])
        n = max(0, len(buf) - width + 1)
        h = mix((sums[width : width + n] - sums[:n]) * q[:n])
        at = 0
        for r in raw:
            yield BottomK.of_hashes(h[at : at + len(r)], k)
            at += len(r) + width - 1


def _key(doc_id: int | None, th: int) -> tuple:
    return (doc_id is None, doc_id or 0, th)


def _firsts(docs: DataFrame, n: int) -> list[tuple]:
    """The first key of each of about n ranges of the documents' order: one row a range reaches the driver."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.slice(0, 1)
                return

    order = [F.col("doc_id").asc_nulls_last(), F.col("th")]
    rows = docs.select("doc_id", "th").repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(first, "doc_id long, th long").collect()
    return sorted({_key(r.doc_id, r.th) for r in rows})


def _split(firsts: list[tuple]):
    """Rows with the number of their range; the first row of each range goes to the one before as well, as its end."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [_key(i, t) for i, t in zip(b.column("doc_id").to_pylist(), b.column("th").to_pylist(), strict=True)]
            bucket = [bisect.bisect_right(firsts, k) - 1 for k in keys]
            ends = [i for i, k in enumerate(keys) if firsts[bucket[i]] == k]
            cols = [pa.array(bucket, pa.int32()), pa.array([False] * len(keys)), b.column("doc_id"), b.column("th"), b.column("text")]
            names = ["bucket", "ends", "doc_id", "th", "text"]
            yield pa.RecordBatch.from_arrays(cols, names=names)
            if ends:
                part = pa.RecordBatch.from_arrays(cols, names=names).take(pa.array(ends))
                before = pa.array([(bucket[i] - 1) % len(firsts) for i in ends], pa.int32())
                yield pa.RecordBatch.from_arrays([before, pa.array([True] * len(ends)), *part.columns[2:]], names=names)

    return split


_OUT = {
    "doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(),
    "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64(), "n_shingles": pa.float64(),
}


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    """rows: (doc_id, text, sketch, text of the next, sketch of the next)."""
    edited = []
    for _, text, _, after, _ in rows:
        q = len(text) // 4
        edited.append(text[: len(text) - q] + after[:q])
    out = []
    for (i, text, own, _, then), e, s in zip(rows, edited, sketches(edited), strict=True):
        out.append((i, len(text), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), str(own), str(s), own.resemblance(s), own.resemblance(then), own.distinct()))
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(_OUT.values())], names=list(_OUT))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Go through rows sorted by (bucket, ends, order); each waits for the row after it."""
    wait, at = None, None
    for whole in batches:
        for a in range(0, whole.num_rows, 256):
            b = whole.slice(a, 256)
            texts = [t or "" for t in b.column("text").to_pylist()]
            ready = []
            for bucket, ends, i, text, s in zip(b.column("bucket").to_pylist(), b.column("ends").to_pylist(), b.column("doc_id").to_pylist(), texts, sketches(texts), strict=True):
                if wait is not None and at == bucket:
                    ready.append((*wait, text, s))
                wait, at = (None, bucket) if ends else ((i, text, s), bucket)
            if ready:
                yield _emit(ready)


def fingerprint(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): its fingerprint, and those of its edited text and the next one.

    Columns: doc_id, n_chars (code points), edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, n_shingles (estimate of the
    distinct shingles). The edited text has its last ``n_chars div 4`` code
    points replaced by the first as many of the next document in ascending
    doc_id order; after the last comes the first, and a lone document follows
    itself. Null text is empty; an empty text has an empty fingerprint, which
    is like another empty one (1) and unlike all else (0). Rows without doc_id
    come last; equal ids are ordered by a hash of their text. Further columns
    are not read.

    The order is cut into ranges; each text is shuffled once, to its range,
    and only the first text of a range is sent twice.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("th", F.xxhash64("text"))
    n = parts(docs.sparkSession)
    firsts = _firsts(docs, 2 * n)
    if not firsts:
        return docs.sparkSession.createDataFrame(pa.table({k: pa.array([], t) for k, t in _OUT.items()}))
    dealt = docs.mapInArrow(_split(firsts), "bucket int, ends boolean, doc_id long, th long, text string").repartition(n, "bucket")
    ordered = dealt.sortWithinPartitions("bucket", "ends", F.col("doc_id").asc_nulls_last(), "th")
    return ordered.mapInArrow(_walk, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double")
