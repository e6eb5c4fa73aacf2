"""Benchmark decontamination by latent semantic retrieval.

1. Every item's words that are rarer in the corpus (half of its distinct words)
   are its keys; document frequencies count all documents.
2. Passages, of items and of all documents, are tf-idf vectors over all keys.
   How often two keys share a passage is counted over the cluster, and a
   randomised SVD of these counts, weighted, gives the latent space.
3. Every window of every document that holds enough keys is projected, and its
   cosine with the items' passages selects candidates.
4. A window around which so many of an item's rarer words lie that the item may
   be confirmed is a candidate too, whatever its cosine. The bound is exact, so
   what is found depends neither on the latent space nor on the other items.
5. A candidate is confirmed by the longest common subsequence of the item's
   words and the words around the window, together with the item's answer: its
   closing words.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, written
from .kernels import U, Words, distinct, pieces

BLOCK = 24  # words; a window is two blocks next to each other, and so is a passage of an item
RANK, OVERSAMPLE = 192, 16
HELD_PAIRS = 1 << 20  # pairs of keys that a task holds before it passes them on
COSINE = 0.4
LCS, LCS_WITH_ANSWER, ANSWER = 0.75, 0.6, 0.5
ANSWER_WORDS = 0.25  # the share of an item's words that is its answer
LEAD = 0.3  # share of an item's words that are looked up beyond those that a confirmed text may lack
SPAN = 192  # words; texts are first searched in spans of two such units, or of longer ones where an item needs them
ITEMS_AT_ONCE = 2000  # items are searched in blocks of so many, each broadcast


def lcs_length(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a word of ``b`` at a time, all of ``a`` at once in the bits of a number."""
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for x in b:
        if (m := at.get(x)) is not None:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


class _Vocabulary:
    """Places of known word hashes; -1 for other words. A bit table turns most words away at once."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = distinct(hashes)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.hashes >> U(44)] = True

    def places(self, words: np.ndarray) -> np.ndarray:
        out = np.full(len(words), -1, np.int64)
        some = np.flatnonzero(self.maybe[words >> U(44)])
        if len(some) and len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, words[some]), len(self.hashes) - 1)
            hit = self.hashes[at] == words[some]
            out[some[hit]] = at[hit]
        return out


def _frequencies(words: _Vocabulary):
    """Documents of a task that hold each word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, docs, size = np.zeros(len(words.hashes), np.int64), 0, U(max(1, len(words.hashes)))
        for b in batches:
            for piece in pieces(t.as_py() for t in b.column("text")):
                w = Words(piece)
                place = words.places(w.hashes())
                doc = np.repeat(np.arange(len(piece)), np.diff(w.first))
                own = place >= 0
                both = distinct(doc[own].astype(np.uint64) * size + place[own].astype(np.uint64))
                n += np.bincount((both % size).astype(np.int64), minlength=len(n))
                docs += len(piece)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *some.tolist()], pa.int64()), pa.array([docs, *n[some].tolist()], pa.int64())], names=["word", "n"])

    return count


def _blocks(w: Words, place: np.ndarray):
    """(block, key, place in the text) of every key of the texts; blocks of a text are numbered without gaps, and one is left free between texts."""
    size = np.diff(w.first)
    count = -(-size // BLOCK) + 1
    base = np.concatenate(([0], np.cumsum(count)))
    at = np.flatnonzero(place >= 0)
    text = np.searchsorted(w.first, at, side="right") - 1
    offset = at - w.first[text]
    return base[text] + offset // BLOCK, place[at], text, base


def _window_vectors(block: np.ndarray, key: np.ndarray, rows: np.ndarray, least: int):
    """Sums of ``rows`` over windows (block b and b + 1) with at least ``least`` keys: first blocks and vectors."""
    if not len(block):
        return np.zeros(0, np.int64), np.zeros((0, rows.shape[1]), rows.dtype)
    cut = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    own, n = block[cut], np.diff(cut, append=len(block))
    first = distinct(np.concatenate((own, own - 1)))
    near = np.zeros((2, len(first)), np.int64)
    has = np.zeros((2, len(first)), bool)
    for k in range(2):
        near[k] = np.minimum(np.searchsorted(own, first + k), len(own) - 1)
        has[k] = own[near[k]] == first + k
    keep = (n[near] * has).sum(axis=0) >= least
    first, near, has = first[keep], near[:, keep], has[:, keep]
    vectors = np.zeros((len(first), rows.shape[1]), rows.dtype)
    if not len(first):
        return first, vectors
    used = distinct(near[has].ravel())
    sums = np.zeros((len(used), rows.shape[1]), rows.dtype)
    starts, ends = cut[used], cut[used] + n[used]
    for i, (a, e) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        sums[i] = rows[key[a:e]].sum(axis=0)
    for k in range(2):
        i = np.flatnonzero(has[k])
        vectors[i] += sums[np.searchsorted(used, near[k][i])]
    return first, vectors


def _units(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


class _Rarest:
    """For each item its rarest words, so many that a text which confirm() accepts lacks not all: exact bounds on where to look.

    A confirmed item has at least ``least`` of its ``n`` words in common with
    the text, so at most ``n - least`` places of it are missing. Its looked-up
    words fill more places than that: ``need`` is the rest, which every
    confirmed text must hold.
    """

    def __init__(self, words: list[np.ndarray], vocabulary: _Vocabulary, df: np.ndarray):
        at, item, weight, self.need, self.own = [], [], [], np.zeros(len(words), np.int64), []
        for k, own in enumerate(words):
            place, times = np.unique(np.searchsorted(vocabulary.hashes, own), return_counts=True)
            by = np.lexsort((place, df[place]))
            place, held = place[by], np.cumsum(times[by])
            n = len(own)
            lack = n - next(c for c in range(1, n + 1) if c / n >= min(LCS, LCS_WITH_ANSWER))
            most = int(np.searchsorted(held, min(n, lack + max(1, math.ceil(LEAD * n))))) + 1
            self.need[k] = held[most - 1] - lack
            at.append(place[:most])
            item.append(np.full(most, k))
            weight.append(times[by][:most])
        at, item, weight = map(np.concatenate, (at, item, weight))
        used = distinct(at)
        self.words = _Vocabulary(vocabulary.hashes[used])
        at = np.searchsorted(used, at)
        by = np.argsort(at, kind="stable")
        self.first = np.searchsorted(at[by], np.arange(len(used) + 1))
        self.item, self.weight = item[by], weight[by]
        self.own = [at[item == k] for k in range(len(words))]
        self.size = np.array([len(x) for x in words])
        self.unit = max(SPAN, 2 * BLOCK + 2 * int(self.size.max()))

    def _spans(self, w: Words, place: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, first word, item) of the spans that hold enough of an item."""
        at = np.flatnonzero(place >= 0)
        if not len(at):
            return
        units = np.maximum(1, -(-np.diff(w.first) // self.unit))
        base = np.concatenate(([0], np.cumsum(units)))
        text = np.searchsorted(w.first, at, side="right") - 1
        local, key = (at - w.first[text]) // self.unit, place[at]
        # a span is a unit and the next; the last unit of a text has no span of its own unless it is the only one
        own, last = (local < units[text] - 1) | (units[text] == 1), local > 0
        size = len(self.first) - 1
        pairs = distinct(np.concatenate(((base[text] + local)[own] * size + key[own], (base[text] + local - 1)[last] * size + key[last])))
        span, key = pairs // size, pairs % size
        step, items = max(1, (1 << 21) // len(self.need)), len(self.need)
        for a in range(0, int(base[-1]), step):
            i, j = np.searchsorted(span, [a, a + step])
            n = self.first[key[i:j] + 1] - self.first[key[i:j]]
            post = np.repeat(self.first[key[i:j]] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            held = np.bincount(np.repeat(span[i:j] - a, n) * items + self.item[post], self.weight[post], min(step, int(base[-1]) - a) * items)
            hit = np.flatnonzero(held.reshape(-1, items) >= self.need)
            for s, k in zip((hit // items + a).tolist(), (hit % items).tolist(), strict=True):
                t = int(np.searchsorted(base, s, side="right")) - 1
                yield t, int(w.first[t]) + (s - int(base[t])) * self.unit, k

    def windows(self, w: Words, hashes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, first word, item) of every window around which confirm() may accept the item."""
        place = self.words.places(hashes)
        for t, a, k in self._spans(w, place):
            low, end, n = int(w.first[t]), int(w.first[t + 1]), int(self.size[k])
            e = min(end, a + 2 * self.unit)
            near = place[a:e]
            mark = np.zeros(len(self.first), np.int64)  # the last place stands for other words
            mark[self.own[k]] = 1
            held = np.concatenate(([0], np.cumsum(mark[near])))
            start = np.arange(low + -(-(a - low) // BLOCK) * BLOCK, e, BLOCK)
            left, right = np.maximum(low, start - n), np.minimum(end, start + 2 * BLOCK + n)
            fits = (left >= a) & (right <= e)
            start, left, right = start[fits], left[fits], right[fits]
            for b in start[held[right - a] - held[left - a] >= self.need[k]].tolist():
                yield t, b, k


@dataclass
class Index:
    """Items by place; word hashes of each, keys with their vectors, and the passages' latent directions."""

    ids: list
    words: list[np.ndarray]
    keys: _Vocabulary
    vectors: np.ndarray
    passages: np.ndarray
    owner: np.ndarray
    least: int
    rarest: _Rarest

    def _cosine(self, hashes: np.ndarray, item: int) -> float:
        """The best cosine of the window of ``hashes`` with the item's passages."""
        place = self.keys.places(hashes)
        window = _units(self.vectors[place[place >= 0]].sum(axis=0)[None])
        return float((window @ self.passages[self.owner == item].T).max(initial=0.0))

    def search(self, texts: list[str]) -> list[tuple[int, int, float, float, float]]:
        """(text, item, cosine, share of the item's words in common order, share of its answer) of the confirmed."""
        w = Words(texts)
        hashes = w.hashes()
        block, key, _, base = _blocks(w, self.keys.places(hashes))
        first, vectors = _window_vectors(block, key, self.vectors, self.least)
        found: dict[tuple[int, int, int], float | None] = {(t, start, item): None for t, start, item in self.rarest.windows(w, hashes)}
        for a in range(0, len(first), 4096):
            cos = _units(vectors[a : a + 4096]) @ self.passages.T
            for i, p in zip(*np.nonzero(cos >= COSINE), strict=True):
                b = int(first[a + i])
                t = int(np.searchsorted(base, max(b, 0), side="right")) - 1
                if b < base[t]:
                    t -= 1
                place = (t, int(w.first[t]) + max(0, int(b - base[t])) * BLOCK, int(self.owner[p]))
                found[place] = max(found.get(place) or 0.0, float(cos[i, p]))
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        times: dict[int, Counter] = {}
        for (t, start, item), c in found.items():
            mine, end = self.words[item], int(w.first[t + 1])
            around = hashes[max(int(w.first[t]), start - len(mine)) : min(end, start + 2 * BLOCK + len(mine))]
            own = times.get(item) or times.setdefault(item, Counter(mine.tolist()))
            if sum(map(own.get, own.keys() & around.tolist())) / len(mine) < min(LCS, LCS_WITH_ANSWER):
                continue  # so many of the item's words are missing that no order of the others is enough
            share, answer = confirm(mine, around)
            if share >= LCS or (share >= LCS_WITH_ANSWER and answer >= ANSWER):
                now = (self._cosine(hashes[start : min(end, start + 2 * BLOCK)], item) if c is None else c, share, answer)
                best[t, item] = max(best.get((t, item), now), now, key=lambda x: (x[1], x[2], x[0]))
        return [(*k, *v) for k, v in sorted(best.items())]


def confirm(item: np.ndarray, around: np.ndarray) -> tuple[float, float]:
    """Shares of the item's words, and of its closing words, that ``around`` holds in the same order."""
    region = around.tolist()
    mine = item.tolist()
    tail = mine[-max(1, math.ceil(ANSWER_WORDS * len(mine))) :]
    known = set(mine)
    region = [x for x in region if x in known]
    return lcs_length(mine, region) / len(mine), lcs_length(tail, region) / len(tail)


def _pairs(keys: _Vocabulary):
    """Of a task's passages the product of A's transpose with A, where A counts a passage's keys: lower place times keys plus higher place, and the entry."""
    size = len(keys.hashes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            for piece in pieces(t.as_py() for t in b.column("text")):
                w = Words(piece)
                block, key, _, _ = _blocks(w, keys.places(w.hashes()))
                found, times = [key * (size + 1)], [np.ones(len(key), np.int64)]
                for lag in range(1, BLOCK):
                    i = np.flatnonzero(block[lag:] == block[:-lag])
                    if not len(i):
                        break
                    x, y = key[i], key[i + lag]
                    found.append(np.minimum(x, y) * size + np.maximum(x, y))
                    times.append(np.where(x == y, 2, 1))
                held, at = np.unique(np.concatenate([held, *found]), return_inverse=True)
                n = np.bincount(at, weights=np.concatenate([n, *times]), minlength=len(held)).astype(np.int64)
                if len(held) > HELD_PAIRS:
                    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(n)], names=["pair", "n"])
                    held, n = held[:0], n[:0]
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(n)], names=["pair", "n"])

    return count


def _sketch(weight: np.ndarray, step: np.ndarray, parts_: int):
    """Of a task's pairs the weighted product with ``step``, in runs of rows."""

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros_like(step)
        for b in batches:
            pair, n = b.column("pair").to_numpy(), b.column("n").to_numpy()
            x, y = pair // len(step), pair % len(step)
            value = n * weight[x] * weight[y]
            apart = x != y  # the other half of the matrix
            for row, of, v in ((x, y, value), (y[apart], x[apart], value[apart])):
                order = np.argsort(row, kind="stable")
                row, of, v = row[order], of[order], v[order]
                cut = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else np.zeros(0, np.int64)
                if len(cut):
                    out[row[cut]] += np.add.reduceat(step[of] * v[:, None], cut)
        for k, rows in enumerate(np.array_split(out, parts_)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([rows.astype(np.float64).tobytes()], pa.binary())], names=["run", "rows"])

    return product


def _sum(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(x) for x in table.column("rows").to_pylist()], axis=0)
    return pa.table({"run": pa.array([key[0].as_py()], pa.int32()), "rows": pa.array([total.tobytes()], pa.binary())})


def latent_space(docs: DataFrame, items: DataFrame, keys: _Vocabulary, weight: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Right singular vectors (keys by rank) of the tf-idf matrix of passages: all items' and all documents'.

    The product of the matrix's transpose with it has a row and a column a
    key, and keys are words of the items, so its size does not depend on the
    documents; its entries are whole numbers times weights. Randomised: a
    random start, two products with it, and an orthonormal basis after each.
    """
    n = len(keys.hashes)
    width = min(n, rank + OVERSAMPLE)
    counted = docs.select("text").union(items.select("text")).mapInArrow(_pairs(keys), "pair long, n long")
    pairs = written(counted.groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    basis = np.linalg.qr(np.random.Generator(np.random.PCG64(11)).standard_normal((n, width)))[0]
    for _ in range(2):
        rows = pairs.repartition(8).mapInArrow(_sketch(weight, basis, 8), "run int, rows binary").groupBy("run").applyInArrow(_sum, "run int, rows binary").orderBy("run").collect()
        image = np.concatenate([np.frombuffer(r.rows) for r in rows]).reshape(n, width)
        basis, size, _ = np.linalg.svd(image, full_matrices=False)
    remove(pairs)
    return basis[:, : min(rank, width)][:, size[: min(rank, width)] > 0]


def build_index(docs: DataFrame, items: DataFrame) -> Index | None:
    """Index of ``items`` (item_id, text), at most ITEMS_AT_ONCE; None if none has words."""
    rows = [r for r in items.select("item_id", "text").orderBy("item_id", "text").collect() if r.text]
    w = Words([r.text for r in rows])
    all_words = w.hashes()
    own = [(r.item_id, all_words[a:b]) for r, a, b in zip(rows, w.first[:-1], w.first[1:], strict=True) if b > a]
    if not own:
        return None
    vocabulary = _Vocabulary(all_words)
    counts = docs.select("text").mapInArrow(_frequencies(vocabulary), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r.word: r.n for r in counts}  # one row a word of the items
    total = counts.pop(-1, 0)
    df = np.zeros(len(vocabulary.hashes))
    df[list(counts)] = list(counts.values())
    rare = []
    for _, words in own:
        place = np.searchsorted(vocabulary.hashes, distinct(words))
        rare.append(place[np.lexsort((place, df[place]))][: -(-len(place) // 2)])
    chosen = distinct(np.concatenate(rare))
    keys = _Vocabulary(vocabulary.hashes[chosen])
    weight = np.log((1 + total) / (1 + df[chosen])) + 1
    vectors = (latent_space(docs, items, keys, weight) * weight[:, None]).astype(np.float32)
    passages, owner = [], []
    for k, (_, words) in enumerate(own):
        place = keys.places(words)
        for a in range(0, max(1, len(words) - BLOCK), BLOCK):
            got = place[a : a + 2 * BLOCK]
            got = got[got >= 0]
            if len(got):
                passages.append(vectors[got].sum(axis=0))
                owner.append(k)
    fewest = min(len(r) for r in rare)
    return Index([i for i, _ in own], [x for _, x in own], keys, vectors, _units(np.array(passages)), np.array(owner), max(1, fewest // 3), _Rarest([x for _, x in own], vocabulary, df))


_PAIR = "doc_id long, item_id long, cosine double, common double, answer double"


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, common, answer): documents that hold a benchmark item, whole or reworded in part.

    Every pair that ``confirm`` accepts around some window is found.

    ``common`` is the share of the item's words found in the same order around
    the best window, ``answer`` that of its closing quarter. Confirmed are
    pairs with ``common`` of at least 0.75, or 0.6 and an ``answer`` of 0.5.
    Null and empty documents and items hold nothing. Each of repeated rows is
    reported; rows without an id are reported with a null one. Further columns
    are not read. Very long texts are searched whole. Items are gathered in
    blocks of ITEMS_AT_ONCE, whatever their number; which pairs are found does
    not depend on the blocks, though a pair's ``cosine`` does, as each has a
    latent space of its own. Documents are neither collected nor shuffled.
    """
    out = None
    for part in _item_blocks(items):
        index = build_index(docs, part)
        if index is None:
            continue

        def search(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, at = b.column("doc_id").to_pylist(), 0
                for piece in pieces(t.as_py() for t in b.column("text")):
                    rows = [(ids[at + t], index.ids[i], c, s, a) for t, i, c, s, a in index.search(piece)]
                    at += len(piece)
                    kinds = [pa.int64(), pa.int64(), *[pa.float64()] * 3]
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["doc_id", "item_id", "cosine", "common", "answer"])

        found = docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").mapInArrow(search, _PAIR)
        out = found if out is None else out.union(found)
    return docs.sparkSession.createDataFrame([], _PAIR) if out is None else out


def _item_blocks(items: DataFrame) -> list[DataFrame]:
    items = items.selectExpr("CAST(item_id AS LONG) AS item_id", "text")
    blocks = -(-items.count() // ITEMS_AT_ONCE)
    if blocks <= 1:
        return [items]
    number = F.pmod(F.xxhash64("item_id", "text"), F.lit(2 * blocks))
    return [items.where(number == k) for k in range(2 * blocks)]


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns as they are.

    Rows with null or empty texts stay, as do all where there are no items.
    Repeated rows share one fate. Very long texts are searched whole.
    """
    keep = docs
    for part in _item_blocks(items):
        index = build_index(docs, part)
        if index is None:
            continue

        keep = keep.where(~_holds(index)("text"))
    return keep


def _holds(index: Index):
    @F.arrow_udf("boolean")
    def holds(texts: pa.Array) -> pa.Array:
        out, at = np.zeros(len(texts), bool), 0
        for piece in pieces(t.as_py() for t in texts):
            for t, *_ in index.search(piece):
                out[at + t] = True
            at += len(piece)
        return pa.array(out)

    return holds
