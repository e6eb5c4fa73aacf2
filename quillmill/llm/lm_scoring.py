"""Language-model scores by context-tree weighting over bytes.

A text is scored as its words, A-Z lower-cased, joined by single blanks and
closed by an end byte, as is its token sequence by the base model. Each byte is
eight binary decisions; every decision has its own context tree over the bytes
before it, down to ``DEPTH``. A node's estimate is Krichevsky-Trofimov's from
the training counts, and the weighted probability of a node is half its own
estimate's and half the product of its children's. The probability of a
decision is the root's weighted probability with it over that without it: along
the path, each node mixes its own estimate with its child's prediction by the
weights that training left, and a child that training never reached predicts
1/2. The score is the sum of log10 over all decisions.

The trees are never in one place. Counts of (context, byte) are gathered by the
nearest two context bytes, which holds whole subtrees from depth two on; the
two depths above them are at most 65,536 small nodes. Texts are dealt into
chunks, a chunk asks each bucket for the distinct (context, byte) it holds, and
the answers are summed back over its texts. Word counts go the same way. What
the commonest two bytes are asked is dealt over several copies of their bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, parts, release, released, written
from .kernels import U, Words, distinct, mix, pieces, planes, steps, unplanes, unsteps

DEPTH = 6  # context bytes; the key of a context and a byte has to fit 64 bits
CHUNK_BYTES, MOST_CHUNK_BYTES = 8 << 20, 64 << 20  # a chunk grows with the root of the input, so that requests stay packed
GATHER_KEYS = 1 << 21
GATHER_BYTES = 64 << 30  # counts of more text than this are merged in two rounds
SALT_POSITIONS, SALT_KEYS = 1 << 20, 32  # training positions a copy of a bucket, and for each of the bucket's keys
FOLDS = 10
NGRAM, WORD = 0, 1
_END = mix(np.array([0xE0D], np.uint64))
_LN2 = math.log(2)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x >= 0.5, by Stirling's series after a shift by 8."""
    x = np.asarray(x, np.float64)
    shift = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    y = x + 8
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y - shift


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of any sequence of n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - math.log(math.pi)


def keys_of(texts: list[str], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all positions of all texts, and where each text's begin (and the end).

    A key holds the context bytes, the nearest in the highest place, and then
    the byte itself. The context of a text's start is end bytes.
    """
    norm = [b" ".join(t.encode("utf-8", "surrogatepass").lower().split()) + b"\n" for t in texts]
    lead = b"\n" * depth
    data = lead + lead.join(norm) + b"\0" * 8
    v = np.ndarray((len(data) - 8,), "<u8", data, 0, (1,))[: len(data) - 8 - depth]
    sizes = np.array([len(x) for x in norm], np.int64)
    first = np.concatenate(([0], np.cumsum(sizes)))
    own = np.ones(len(v), bool)
    for a in first[1:-1] + depth * np.arange(len(norm) - 1):
        own[a : a + depth] = False
    v = v[own]
    bits = U(8 * depth)
    return ((v & U((1 << 8 * depth) - 1)) << U(8)) | ((v >> bits) & U(255)), first


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each text's closed by the end token, and where each text's begin (and the end)."""
    w = Words(texts)
    h = np.insert(w.hashes(), w.first[1:], _END)
    return h, w.first + np.arange(len(w.first))


class _Tree:
    """Nodes from depth ``least`` on: for each depth the sorted node keys, the estimate of a one, and the weight of stopping."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, least: int = 2):
        self.depth, self.least, self.levels = depth, least, {}
        below: tuple[np.ndarray, np.ndarray] | None = None
        comp, counts = keys, counts.astype(np.float64)
        for d in range(depth, least - 1, -1):
            if d < depth:
                comp = ((comp >> U(16)) << U(8)) | (comp & U(255))
                order = np.argsort(comp, kind="stable")
                comp, counts = comp[order], counts[order]
                cut = np.flatnonzero(np.concatenate(([True], comp[1:] != comp[:-1]))) if len(comp) else np.zeros(0, np.int64)
                comp, counts = comp[cut], np.add.reduceat(counts, cut) if len(cut) else counts
            nodes, n0, n1 = self._nodes(comp, counts)
            own = log_kt(n0, n1)
            if below is None:
                weighted, stop = own, np.ones(len(own))
            else:
                up = np.searchsorted(nodes, ((below[0] >> U(16)) << U(8)) | (below[0] & U(255)))
                inner = np.bincount(up, weights=below[1], minlength=len(nodes))
                weighted = np.logaddexp(own, inner) - _LN2
                stop = np.exp(own - _LN2 - weighted)
            self.levels[d] = (nodes, (n1 + 0.5) / (n0 + n1 + 1), stop)
            below = (nodes, weighted)
            self.top = (nodes, n0, n1, weighted)

    @staticmethod
    def _nodes(comp: np.ndarray, counts: np.ndarray):
        out = []
        context, symbol = comp >> U(8) << U(8), comp & U(255)
        for j in range(8):
            node = context | U(1 << j) | (symbol >> U(8 - j))
            if not len(node):
                break
            cut = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
            ones = counts * ((symbol >> U(7 - j)) & U(1))
            n, n1 = np.add.reduceat(counts, cut), np.add.reduceat(ones, cut)
            out.append((node[cut], n - n1, n1))
        if not out:
            return np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
        nodes, n0, n1 = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.argsort(nodes)
        return nodes[order], n0[order], n1[order]

    def log10(self, keys: np.ndarray, top: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
        """log10 of the probability of each key's byte after its context. ``top``: the levels above ``least``, from the root on."""
        levels = [*top, *(self.levels[d] for d in range(self.least, self.depth + 1))]
        symbol, out = keys & U(255), np.zeros(len(keys))
        for j in range(8):
            heap = U(1 << j) | (symbol >> U(8 - j))
            one = ((symbol >> U(7 - j)) & U(1)).astype(bool)
            p = np.full(len(keys), 0.5)  # what a child that training never reached predicts
            for d in range(self.depth, -1, -1):
                nodes, kt, stop = levels[d]
                if not len(nodes):
                    continue
                node = (keys >> U(8 * (self.depth - d + 1)) << U(8)) | heap if d else heap
                at = np.minimum(np.searchsorted(nodes, node), len(nodes) - 1)
                here = nodes[at] == node
                est = np.where(one, kt[at], 1 - kt[at])
                p = np.where(here, stop[at] * est + (1 - stop[at]) * p, 0.5)
            out += np.log10(p)
        return out


def _bucket(kind: int, keys: np.ndarray, buckets: int, depth: int) -> np.ndarray:
    near = keys >> U(8 * (depth - 1)) if kind == NGRAM else keys
    return (mix(near) % U(buckets)).astype(np.int64)


def _rows(kind: int, keys: np.ndarray, counts: np.ndarray | None, buckets: int, depth: int, chunk: int, salts: dict[int, int] | None = None) -> list[tuple]:
    """Sorted keys as one row a bucket; ``salts`` tells into how many copies the large buckets of n-grams are dealt."""
    b = _bucket(kind, keys, buckets, depth)
    order = np.argsort(b, kind="stable")
    b, keys = b[order], keys[order]
    cut = np.flatnonzero(np.diff(b, prepend=-1))
    out = []
    for a, e in zip(cut.tolist(), [*cut[1:].tolist(), len(b)], strict=True):
        salt = int(chunk * 0x9E3779B97F4A7C15 >> 32 & 0xFFFFFFFF) % salts.get(int(b[a]), 1) if salts and kind == NGRAM else 0
        out.append((kind, int(b[a]), salt, chunk, steps(keys[a:e]), None if counts is None else planes(counts[order[a:e]])))
    return out


_ROW = "kind int, bucket long, salt long, chunk long, keys binary, counts binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["kind", "bucket", "salt", "chunk", "keys", "counts"])


def _merge(parts_: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts. ``parts_`` is emptied: the parts go as soon as they are joined."""
    keys, counts = (np.concatenate(x) for x in zip(*parts_, strict=True))
    parts_.clear()
    order = np.argsort(keys)
    keys = keys[order]
    counts = counts[order]
    del order
    cut = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[cut], np.add.reduceat(counts, cut) if len(cut) else counts


def _gather(buckets: int, depth: int, rounds: int):
    """Counts of the training texts of a task, combined before the shuffle. ``chunk`` is one of ``rounds`` parts of the tasks."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() % rounds
        held: dict[int, list] = {NGRAM: [], WORD: []}
        size = {NGRAM: 0, WORD: 0}

        def flush(kind: int, last: bool) -> list[tuple]:
            keys, counts = _merge(held[kind])
            if last or len(keys) > GATHER_KEYS:
                held[kind], size[kind] = [], 0
                return _rows(kind, keys, counts, buckets, depth, part)
            held[kind], size[kind] = [(keys, counts)], len(keys)
            return []

        for b in batches:
            for piece in pieces(t.as_py() for t in b.column("text")):
                for kind, keys in ((NGRAM, keys_of(piece, depth)[0]), (WORD, words_of(piece)[0])):
                    keys.sort()
                    cut = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
                    u, n = keys[cut], np.diff(cut, append=len(keys))
                    held[kind].append((u, n.astype(np.uint64)))
                    size[kind] += len(u)
                    if size[kind] > 2 * GATHER_KEYS and (rows := flush(kind, False)):
                        yield _batch(rows)
                        del rows
                        release()
        for kind in held:
            if held[kind] and (rows := flush(kind, True)):
                yield _batch(rows)
                del rows
        release()

    return gather


def _keys(table: pa.Table) -> list[np.ndarray]:
    return [unsteps(x.as_buffer()) for x in table.column("keys")]


def _counts(table: pa.Table) -> list[np.ndarray]:
    return [unplanes(x.as_buffer(), np.uint64) for x in table.column("counts")]


def _merged(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """One row of a bucket's counts from a part of the tasks."""
    kind, bucket, chunk = (k.as_py() for k in key)
    keys, counts = _merge([*zip(_keys(table), _counts(table), strict=True)])
    return pa.Table.from_batches([_batch([(kind, bucket, 0, chunk, steps(keys), planes(counts))])])


_MODEL = "kind int, bucket long, keys binary, counts binary, n long, total long, node array<int>, n0 array<double>, n1 array<double>, weighted array<double>"


def _model(depth: int):
    def model(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """The bucket's counts, and what the nodes of depth two pass on to depth one."""
        kind, bucket = (k.as_py() for k in key)
        keys, counts = _merge([*zip(_keys(table), _counts(table), strict=True)])
        node = n0 = n1 = weighted = None
        if kind == NGRAM:
            nodes, a, b, w = _Tree(keys, counts, depth).top
            up = (((nodes >> U(16)) << U(8)) | (nodes & U(255))).astype(np.int64)
            node, at = np.unique(up, return_inverse=True)
            n0, n1, weighted = (np.bincount(at, weights=x) for x in (a, b, w))
        row = [kind, bucket, steps(keys), planes(counts), len(keys), int(counts.sum()), node, n0, n1, weighted]
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int32()), *[pa.list_(pa.float64())] * 3)
        return pa.table([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=["kind", "bucket", "keys", "counts", "n", "total", "node", "n0", "n1", "weighted"])

    return model


def _top(model: DataFrame) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels 0 and 1 of the trees. At most 256 contexts by 255 nodes reach the driver, whatever the data."""
    x = model.where(F.col("kind") == NGRAM).select(F.explode(F.arrays_zip("node", "n0", "n1", "weighted")).alias("x"))
    rows = x.groupBy(F.col("x.node").alias("node")).agg(F.sum("x.n0"), F.sum("x.n1"), F.sum("x.weighted")).toPandas().sort_values("node")
    nodes, n0, n1, inner = (rows.iloc[:, k].to_numpy() for k in range(4))
    out = []
    for level in (1, 0):
        if level == 0:
            nodes, at = np.unique(nodes & 255, return_inverse=True)
            n0, n1, inner = (np.bincount(at, weights=v, minlength=len(nodes)) for v in (n0, n1, weighted))
        own = log_kt(n0, n1)
        weighted = np.logaddexp(own, inner) - _LN2
        out.insert(0, (nodes.astype(np.uint64), (n1 + 0.5) / (n0 + n1 + 1), np.exp(own - _LN2 - weighted)))
    return out


def _dealt(model: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """The model with large buckets of n-grams in several copies (``salt``), and into how many; at most as many as two bytes have values.

    A copy is asked for about SALT_POSITIONS positions, but at least for
    SALT_KEYS times as many as its bucket has keys, so copies stay small
    against what is asked of them.
    """
    copies = F.floor(F.least(F.col("total") / F.lit(SALT_POSITIONS), F.col("total") / F.lit(SALT_KEYS) / F.col("n")))
    model = model.withColumn("copies", F.when(F.col("kind") == NGRAM, F.greatest(copies, F.lit(1))).otherwise(F.lit(1)))
    salts = {r.bucket: r.copies for r in model.where("copies > 1").select("bucket", "copies").collect()}
    return model.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))), salts


def _ask(buckets: int, depth: int, salts: dict[int, int]):
    def ask(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        texts = [t for c in table.column("text").chunks for t in c.to_pylist()]
        found: dict[int, list] = {NGRAM: [], WORD: []}
        for piece in pieces(texts):
            found[NGRAM].append(distinct(keys_of(piece, depth)[0]))
            found[WORD].append(distinct(words_of(piece)[0]))
        rows = []
        for kind, some in found.items():
            rows += _rows(kind, distinct(np.concatenate(some)), None, buckets, depth, key[0].as_py(), salts)
        return pa.Table.from_batches([_batch(rows)])

    return ask


def _answer(depth: int, top):
    def answer(key: tuple[pa.Scalar, ...], asked: pa.Table, model: pa.Table) -> pa.Table:
        """For n-grams log10 of the byte's probability, for words their count in training."""
        kind = key[0].as_py()
        wanted = _keys(asked)
        if not wanted:
            return pa.table({"kind": pa.array([], pa.int32()), "bucket": pa.array([], pa.int64()), "chunk": pa.array([], pa.int64()), "values": pa.array([], pa.binary())})
        keys, counts = (_keys(model)[0], _counts(model)[0]) if model.num_rows else (np.zeros(0, np.uint64),) * 2
        ends = np.cumsum([len(w) for w in wanted])
        wanted = np.concatenate(wanted)  # the parts go before the search begins
        unique, at = np.unique(wanted, return_inverse=True)
        del wanted
        if kind == NGRAM:
            value = _Tree(keys, counts, depth).log10(unique, top).astype(np.float32)
        else:
            value = np.zeros(len(unique), np.float64)
            if len(keys):
                place = np.minimum(np.searchsorted(keys, unique), len(keys) - 1)
                value = np.where(keys[place] == unique, counts[place], 0).astype(np.float64)
        value = value[at]
        return pa.table(
            {
                "kind": asked.column("kind"), "bucket": asked.column("bucket"), "chunk": asked.column("chunk"),
                "values": pa.array([planes(value[a:e]) for a, e in pairwise([0, *ends.tolist()])], pa.binary()),
            }
        )

    return answer


def _sums(first: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Sums of value between the bounds; every text has at least one position."""
    return np.add.reduceat(value, first[:-1]) if len(first) > 1 else np.zeros(0)


def _looked_up(keys: np.ndarray, known: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The value of every key; ``known`` is sorted. Each distinct key is searched once, in order."""
    order = np.argsort(keys)
    s = keys[order]
    cut = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    out = np.empty(len(keys), value.dtype)
    out[order] = np.repeat(value[np.searchsorted(known, s[cut])], np.diff(cut, append=len(s)))
    return out


def _score(buckets: int, depth: int):
    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        texts = [t for c in docs.column("text").chunks for t in c.to_pylist()]
        table: dict[int, np.ndarray] = {}
        for kind, dtype in ((NGRAM, np.float32), (WORD, np.float64)):
            rows = answers.filter(pa.compute.equal(answers.column("kind"), kind)).sort_by("bucket")
            table[kind] = np.concatenate([np.zeros(0, dtype), *(unplanes(x.as_buffer(), dtype) for x in rows.column("values"))])
        # the keys in the order of the answers: by bucket, then by key
        known: dict[int, list] = {NGRAM: [], WORD: []}
        for piece in pieces(texts):
            known[NGRAM].append(distinct(keys_of(piece, depth)[0]))
            known[WORD].append(distinct(words_of(piece)[0]))
        value = {}
        for kind, some in known.items():
            keys = distinct(np.concatenate(some))
            order = np.argsort(_bucket(kind, keys, buckets, depth), kind="stable")
            own = np.empty(len(keys), np.float64)
            own[order] = table[kind]
            known[kind], value[kind] = keys, own
        out = []
        for piece in pieces(texts):
            got = []
            for kind, (keys, first) in ((NGRAM, keys_of(piece, depth)), (WORD, words_of(piece))):
                got.append((_looked_up(keys, known[kind], value[kind]), first))
            (p, first), (c, start) = got
            out.append((np.diff(start), _sums(start, (c > 0).astype(np.float64)), _sums(start, np.log10(c + 0.1)), np.diff(first), _sums(first, p)))
        n, k, base, size, s = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table(
            {
                "doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": pa.array(n.astype(np.int64)), "n_known": pa.array(k.astype(np.int64)),
                "base": pa.array(base), "n_bytes": pa.array(size.astype(np.int64)), "score": pa.array(s),
            }
        )

    return score


def score_texts(docs: DataFrame, depth: int = DEPTH, folds: int = FOLDS) -> DataFrame:
    """Scores of every row of ``docs`` (doc_id, text), learning from those whose crc32(doc_id) mod ``folds`` is not 0.

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score, code_bits_per_byte (code length over the bytes of the normalised
    text and its end). Null and empty texts have the end token alone; a very
    long text is scored whole, in memory of some hundred times its length. A
    null doc_id counts as the empty id. Repeated rows count as often as they
    occur. Without training rows every binary decision has probability 1/2.
    Further columns are not read.
    """
    held = fold("doc_id", folds) == 0
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held_out"))
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    chunk_bytes = min(MOST_CHUNK_BYTES, max(CHUNK_BYTES, 32 * math.isqrt(size)))
    chunks = max(1, math.ceil(size / chunk_bytes))
    buckets, rounds = max(2 * parts(spark), chunks), math.ceil((size + 1) / GATHER_BYTES)
    gathered = docs.where("NOT held_out").select("text").mapInArrow(_gather(buckets, depth, rounds), _ROW)
    if rounds > 1:
        gathered = gathered.groupBy("kind", "bucket", "chunk").applyInArrow(released(_merged), _ROW)
    model = written(gathered.groupBy("kind", "bucket").applyInArrow(released(_model(depth)), _MODEL), "model")
    top = _top(model)
    total, distinct = model.where(F.col("kind") == WORD).agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    dealt = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks))).repartition(max(chunks, parts(spark)), "chunk")
    model, salts = _dealt(model)
    asked = dealt.groupBy("chunk").applyInArrow(released(_ask(buckets, depth, salts)), _ROW)
    told = asked.groupBy("kind", "bucket", "salt").cogroup(model.groupBy("kind", "bucket", "salt")).applyInArrow(released(_answer(depth, top)), "kind int, bucket long, chunk long, values binary")
    out = dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(
        released(_score(buckets, depth)), "doc_id long, held_out boolean, n_tokens long, n_known long, base double, n_bytes long, score double"
    )
    scale = math.log10(total + 0.1 * (distinct + 1))
    return out.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(scale)).alias("base_score"), "score",
        (-F.col("score") / F.lit(math.log10(2)) / F.col("n_bytes")).alias("code_bits_per_byte"),
    )
