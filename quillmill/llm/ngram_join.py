"""Exact Jaccard join of word n-gram sets with prefix trees, and the groups it links.

1. Texts are dealt into chunks of a few megabytes. A chunk sends the hashes of
   its shingles, packed and sorted, to the buckets of the hash space; a bucket
   answers with how many sets hold each. So every shingle gets its document
   frequency, which gives the global order: rare first, then by hash.
2. Two sets whose similarity reaches the threshold share a shingle within the
   first ``n - ceil(t*n) + 1`` places of both (prefix filter). Shingles held by
   one set only fall out, and with them nearly all documents that have no copy.
3. Equal sets are one class. Where classes share a prefix shingle, one leader
   is compared with all others first; whatever is then in one component needs
   no more comparisons. What still stands in different components is compared
   pair by pair, so no link between different components is lost, while a
   large group of near copies takes a number of comparisons in proportion to
   its size.
4. Comparisons go in runs. A run's sets are put into one prefix tree, which
   every probe of the run walks: partial overlaps are shared along common paths,
   and a subtree is left when it holds none of the probe's candidates or when
   its remaining length can no longer reach the threshold.

Shingles are 64-bit hashes; two different shingles of a pair of texts share one
with a probability of about 1e-19 for each pair of shingles.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, remove, settings, written
from .components import components
from .kernels import U, shingles

CHUNK_BYTES, MOST_CHUNK_BYTES = 4 << 20, 64 << 20  # chunks and buckets grow with the root of the input, so that requests stay packed
BUCKET_BYTES, MOST_BUCKET_BYTES = 4 << 20, 256 << 20
STAR_ROUNDS = 2

_ONE = "doc_id long, row_key long, n int, sig binary, h array<long>, pos array<int>, rare int, items binary"


class PrefixTree:
    """Sets as paths of globally ordered items; nodes hold runs of items.

    Sets are inserted in the order of their paths, so the places in this order
    of the sets below a node are a range.
    """

    def __init__(self, sets: list[np.ndarray]):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.root = _Node(np.zeros(0, np.uint64), 0)
        self.place = [0] * len(sets)
        for k, i in enumerate(order):
            self.place[i] = k
            self._insert(sets[i], i, k)

    def _insert(self, items: np.ndarray, i: int, k: int) -> None:
        n, node, at = len(items), self.root, 0
        while True:
            node.least, node.most, node.last = min(node.least, n), max(node.most, n), k
            if at == n:
                node.ids.append(i)
                return
            child = node.children.get(int(items[at]))
            if child is None:
                node.children[int(items[at])] = leaf = _Node(items[at:], k)
                leaf.least = leaf.most = n
                leaf.ids.append(i)
                return
            run = child.run
            m = min(len(run), n - at)
            differ = run[:m] != items[at : at + m]
            same = int(differ.argmax()) if differ.any() else m
            if same < len(run):  # split the run where the paths part
                top = _Node(run[:same], child.first)
                top.least, top.most, top.last = child.least, child.most, child.last
                child.run = run[same:]
                top.children[int(child.run[0])] = child
                node.children[int(items[at])] = child = top
            node, at = child, at + same

    def similar(self, probe: np.ndarray, num: int, den: int, among: Sequence[int] | None = None) -> Iterator[tuple[int, int]]:
        """(set, overlap) of every set, or those ``among`` which are asked for, with ``den * overlap >= num * union``; ``probe`` is sorted by value."""
        m = len(probe)
        if not m:
            return
        asked = None if among is None else sorted(self.place[i] for i in among)
        stack = [(self.root, 0, 0)]
        while stack:
            node, depth, got = stack.pop()
            if node.most * den < num * m or node.least * num > den * m:
                continue
            if asked is not None and ((k := bisect_left(asked, node.first)) == len(asked) or asked[k] > node.last):
                continue
            if len(node.run):
                at = np.searchsorted(probe, node.run)
                at[at == m] = 0
                got += int(np.count_nonzero(probe[at] == node.run))
                depth += len(node.run)
            # the longest set below loses least: it needs ceil(num*(n+m)/(num+den)) common items
            if got + node.most - depth < -(-num * (node.most + m) // (num + den)):
                continue
            for i in node.ids:
                if den * got >= num * (depth + m - got) and (asked is None or self.place[i] in asked):
                    yield i, got
            stack.extend((c, depth, got) for c in node.children.values())


class _Node:
    __slots__ = ("children", "first", "ids", "last", "least", "most", "run")

    def __init__(self, run: np.ndarray, place: int):
        self.run, self.children, self.ids, self.least, self.most, self.first, self.last = run, {}, [], 1 << 62, 0, place, place


def _signature(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _chunk_sets(table: pa.Table, width: int, bits: int):
    """Sets and signatures of a chunk, and its sorted distinct keys with the number of distinct sets that hold each."""
    texts = table.column("text")
    sets = list(shingles((t for b in texts.chunks for t in b.to_pylist()), width))
    sigs = [_signature(s) if len(s) else None for s in sets]
    first = {g: i for i, g in reversed([*enumerate(sigs)]) if g}
    rows = sorted(first.values())
    keys = np.concatenate([np.zeros(0, np.uint64), *(sets[i] for i in rows)]) >> U(32 - bits)
    return sets, sigs, rows, *np.unique(keys, return_counts=True)


def _requests(width: int, bits: int):
    def ask(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        *_, keys, counts = _chunk_sets(table, width, bits)
        bucket = (keys >> U(32)).astype(np.int64)
        cut = np.flatnonzero(np.diff(bucket, prepend=-1))
        ends = [*cut[1:], len(keys)]
        low, n = keys.astype(np.uint32), np.minimum(counts, 255).astype(np.uint8)
        return pa.table(
            {
                "bucket": pa.array(bucket[cut], pa.int64()),
                "chunk": pa.array([key[0].as_py()] * len(cut), pa.int64()),
                "keys": pa.array([low[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary()),
                "counts": pa.array([n[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary()),
            }
        )

    return ask


def _answer(table: pa.Table) -> pa.Table:
    """For each request the frequency class of its keys: exact below 128, then in steps of an eighth of a doubling."""
    asked = [np.frombuffer(x, np.uint32) for x in table.column("keys").to_pylist()]
    counts = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("counts").to_pylist()])
    _, at = np.unique(np.concatenate(asked), return_inverse=True)
    df = np.bincount(at, weights=counts)[at]
    code = np.where(df < 128, df, 128 + np.minimum(127, np.floor(8 * np.log2(np.maximum(df, 1) / 128)))).astype(np.uint8)
    ends = np.cumsum([len(x) for x in asked])
    blobs = [code[e - len(x) : e].tobytes() for x, e in zip(asked, ends, strict=True)]
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "codes": pa.array(blobs, pa.binary())})


def _order(width: int, bits: int, num: int, den: int):
    def order(docs: pa.Table, answers: pa.Table) -> pa.Table:
        sets, sigs, rows, keys, _ = _chunk_sets(docs, width, bits)
        answers = answers.sort_by("bucket")
        codes = np.frombuffer(b"".join(answers.column("codes").to_pylist()), np.uint8)
        out: dict[str, list] = {k: [None] * len(sets) for k in ("h", "pos", "rare", "items")}
        for i in rows:
            s = sets[i]
            code = codes[np.searchsorted(keys, s >> U(32 - bits))]
            prefix = len(s) - -(-num * len(s) // den) + 1
            by = np.lexsort((s, code))
            head = by[:prefix]
            shared = np.flatnonzero(code[head] > 1)
            if len(shared):
                out["h"][i] = s[head[shared]].view(np.int64).tolist()
                out["pos"][i] = shared.tolist()
                out["rare"][i] = int(np.count_nonzero(code == 1) * 1000 // len(s))
                out["items"][i] = s[by[::-1]].tobytes()  # common items first: paths are shared from the root on
        return pa.table(
            {
                "doc_id": docs.column("doc_id"),
                "row_key": docs.column("row_key"),
                "n": pa.array([len(s) for s in sets], pa.int32()),
                "sig": pa.array(sigs, pa.binary()),
                "h": pa.array(out["h"], pa.list_(pa.int64())),
                "pos": pa.array(out["pos"], pa.list_(pa.int32())),
                "rare": pa.array(out["rare"], pa.int32()),
                "items": pa.array(out["items"], pa.binary()),
            }
        )

    return order


def _compare(num: int, den: int):
    """Pairs (a, b) that are similar. The sets b of a batch share one prefix tree, which each a walks once."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, items, probes = (batch.column(x) for x in ("a", "b", "items", "probe"))
            number: dict[bytes, int] = {}
            sets: list[np.ndarray] = []
            asked: dict[bytes, tuple[int, list[int]]] = {}
            for row, (x, y) in enumerate(zip(a.to_pylist(), b.to_pylist(), strict=True)):
                if y not in number:
                    number[y] = len(sets)
                    sets.append(np.frombuffer(items[row].as_py(), np.uint64))
                asked.setdefault(x, (row, []))[1].append(number[y])
            names, tree, found = list(number), PrefixTree(sets), []
            for x, (row, among) in asked.items():
                probe = np.sort(np.frombuffer(probes[row].as_py(), np.uint64))
                found += [(x, names[i]) for i, _ in tree.similar(probe, num, den, among)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], names=["a", "b"])

    return compare


def _fits(n: str, m: str, i: str, j: str, num: int, den: int) -> str:
    """The sizes allow the threshold, and it is still in reach if places i and j hold the first common item."""
    need = f"((CAST({num} AS BIGINT) * ({n} + {m}) + {num + den - 1}) DIV {num + den})"
    return f"{den} * CAST({n} AS BIGINT) >= {num} * CAST({m} AS BIGINT) AND {den} * CAST({m} AS BIGINT) >= {num} * CAST({n} AS BIGINT) AND {n} - {i} >= {need} AND {m} - {j} >= {need}"


def near_duplicates(docs: DataFrame, num: int = 80, den: int = 100, width: int = 5) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    Two documents are linked when ``den * intersection >= num * union`` of
    their sets of shingles of ``width`` words; ``component_id`` is the least
    doc_id that links lead to. Null and empty texts have no shingles and are
    linked with nothing: their component is their own id. A row without doc_id
    takes part, but gives no component its id; a component without any id is
    null. Repeated rows are exact copies. Very long texts are compared whole.
    Further columns are not read.
    """
    rows, classes = _classes(docs, num, den, width)
    low = classes.groupBy("label").agg(F.min("low").alias("component_id"))
    low = classes.join(low, "label").select("sig", "component_id")
    out = rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "sig")
    lone = out.where("sig IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.where("sig IS NOT NULL").join(low, "sig").select("doc_id", "n_shingles", "component_id").union(lone)


def linked_classes(docs: DataFrame, num: int = 80, den: int = 100, width: int = 5) -> tuple[DataFrame, DataFrame]:
    """All links: (doc_id, n_shingles, sig) of every row, and the pairs (a, b), a < b, of the classes ``sig`` of equal sets that are linked.

    Rows of one class are linked with each other; rows without shingles have a
    null ``sig`` and no links. Every pair of classes that share a prefix
    shingle is compared: where m different texts are all near copies of each
    other, m * (m - 1) / 2 pairs, as many as there are links.
    """
    one = _sets(docs, num, den, width)
    posts, items = _postings(one)
    other = posts.select("h", F.col("sig").alias("sig2"), F.col("n").alias("n2"), F.col("pos").alias("pos2"))
    pairs = posts.join(other, "h").where("sig < sig2").where(_fits("n", "n2", "pos", "pos2", num, den)).select(F.col("sig").alias("a"), F.col("sig2").alias("b"))
    try:
        links = _similar(written(pairs.distinct(), "pairs"), items, num, den)
    finally:
        items.drop()
    return one.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "sig"), links


def link_counts(docs: DataFrame, num: int = 80, den: int = 100, width: int = 5) -> DataFrame:
    """doc_id, n_shingles and n_links, the number of other rows that the row is linked with, for every row of ``docs``."""
    rows, links = linked_classes(docs, num, den, width)
    size = rows.where("sig IS NOT NULL").groupBy("sig").agg(F.count("*").alias("size"))
    both = links.union(links.select("b", "a"))
    more = both.join(size.withColumnRenamed("sig", "b"), "b").groupBy("a").agg(F.sum("size").alias("more"))
    count = size.join(more, size.sig == more.a, "left").select("sig", (F.col("size") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))
    return rows.join(count, "sig", "left").select("doc_id", "n_shingles", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_one(docs: DataFrame, num: int = 80, den: int = 100, width: int = 5) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the row with the least doc_id.

    Rows without doc_id come after those with one; between rows of one id a
    hash of their text decides, and one of identical rows (id and text) stays.
    Rows without shingles (null, empty or blank text) all stay. All columns
    of ``docs``, whatever their names, are returned as they are.
    """
    rows, classes = _classes(docs, num, den, width)
    keys = rows.join(classes.select("sig", "label"), "sig")
    last = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")
    best = keys.groupBy("label").agg(F.min(last).alias("x")).select("x.row_key", F.lit(True).alias("one"))
    kept = best.union(rows.where("sig IS NULL").groupBy("row_key").agg(F.lit(False).alias("one")))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), _row_key(docs).alias("row_key"))
    found = whole.join(kept, "row_key")
    twice = rows.where("sig IS NOT NULL").groupBy("row_key").agg(F.count("*").alias("k")).where("k > 1").select("row_key")
    once = found.where("NOT one").select("row").union(found.where("one").join(twice, "row_key", "left_anti").select("row"))
    again = found.where("one").join(twice, "row_key", "left_semi").groupBy("row_key").agg(F.any_value("row").alias("row")).select("row")
    return once.union(again).select("row.*")


def _row_key(docs: DataFrame):
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))


def _sets(docs: DataFrame, num: int, den: int, width: int) -> DataFrame:
    """Every row's signature and size, and of one row of each set of a chunk its prefix and items in the global order."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _row_key(docs).alias("row_key"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    grown = 32 * math.isqrt(size)
    chunks = max(1, math.ceil(size / min(MOST_CHUNK_BYTES, max(CHUNK_BYTES, grown))))
    bits = max(2, math.ceil(math.log2(max(1, size / 6 * 4 / min(MOST_BUCKET_BYTES, max(BUCKET_BYTES, grown))))))
    dealt = docs.withColumn("chunk", F.pmod("row_key", F.lit(chunks))).repartition(max(chunks, parts(spark)), "chunk")
    asked = dealt.groupBy("chunk").applyInArrow(_requests(width, bits), "bucket long, chunk long, keys binary, counts binary")
    told = asked.groupBy("bucket").applyInArrow(_answer, "chunk long, bucket long, codes binary")
    return written(dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_order(width, bits, num, den), _ONE), "sets")


def _classes(docs: DataFrame, num: int, den: int, width: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, row_key, n, sig) and classes of equal sets (sig, label, low): component and least doc_id."""
    one = _sets(docs, num, den, width)
    classes = one.where("sig IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("low"))
    labels = _labels(one, num, den)
    classes = written(classes.join(labels, "sig", "left").select("sig", F.coalesce("label", "sig").alias("label"), "low"), "classes")
    return one.select("doc_id", "row_key", "n", "sig"), classes


class _Bucketed:
    """A table in the warehouse, bucketed by ``key``: joins on the key do not shuffle it again."""

    def __init__(self, df: DataFrame, key: str):
        self.spark, self.name, n = df.sparkSession, f"quillmill_{uuid.uuid4().hex}", parts(df.sparkSession)
        df.repartition(n, key).write.bucketBy(n, key).sortBy(key).saveAsTable(self.name)
        self.rows = self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE {self.name}")


def _postings(one: DataFrame) -> tuple[DataFrame, _Bucketed]:
    """(h, sig, n, pos, rare) of the prefix shingles that several classes hold, and those classes' items."""
    cand = one.where("h IS NOT NULL")
    posts = cand.select("sig", "n", "rare", F.explode(F.arrays_zip("h", "pos")).alias("x")).select(F.col("x.h").alias("h"), F.col("x.pos").alias("pos"), "sig", "n", "rare")
    found = posts.groupBy("h", "sig").agg(F.max("n").alias("n"), F.max("pos").alias("pos"), F.max("rare").alias("rare"))
    common = found.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h")
    common = written(common, "common")  # what joins by a possibly hot key is read from files, so that the join can be split
    posts = written(found.join(common, "h"), "postings")
    remove(common)
    items = cand.select("sig", "items").join(posts.select("sig").distinct(), "sig", "left_semi").groupBy("sig").agg(F.any_value("items").alias("items"))
    return posts, _Bucketed(items, "sig")


def _similar(pairs: DataFrame, items: _Bucketed, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) of classes that are linked."""
    with settings(pairs.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch=256):
        probes = written(pairs.select("a").distinct().join(items.rows.select(F.col("sig").alias("a"), F.col("items").alias("probe")), "a"), "probes")
        both = pairs.join(items.rows.withColumnRenamed("sig", "b"), "b").join(probes, "a")
        links = written(both.select("a", "b", "items", "probe").mapInArrow(_compare(num, den), "a binary, b binary"), "links")
    remove(probes)
    return links


def _labels(one: DataFrame, num: int, den: int) -> DataFrame:
    """(sig, label) of the classes that have links."""
    posts, items = _postings(one)
    try:
        labels = _merged(posts, items, num, den)
    finally:
        items.drop()
    remove(posts)
    return one.limit(0).selectExpr("sig", "sig AS label") if labels is None else labels


def _merged(posts: DataFrame, items: _Bucketed, num: int, den: int) -> DataFrame | None:
    """(sig, label) of the classes that some round linked; None if there are none."""
    labels = None
    for step in range(STAR_ROUNDS + 1):
        done = []  # tables that no later step reads
        now = posts.withColumn("label", F.col("sig")) if labels is None else written(posts.join(labels, "sig", "left").withColumn("label", F.coalesce("label", "sig")), "labelled")
        if step < STAR_ROUNDS:
            first = F.struct("rare", "sig") if step == 0 else F.struct(F.xxhash64("sig", F.lit(step)), F.col("sig"))
            lead = now.groupBy("h").agg(F.min_by(F.struct("sig", "n", "pos", "label"), first).alias("lead"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("h", "lead")
            done.append(lead := written(lead, "leaders"))
            pairs = now.join(lead, "h").where("label <> lead.label").where(_fits("n", "lead.n", "pos", "lead.pos", num, den)).select(F.col("lead.sig").alias("a"), F.col("sig").alias("b"))
        else:
            main = now.groupBy("h", "label").agg(F.count("*").alias("k")).groupBy("h").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.count("*").alias("m")).where("m > 1").select("h", "main")
            done.append(main := written(main, "main"))
            rest = now.join(main, "h").where("label <> main").select("h", "main", F.col("sig").alias("sig2"), F.col("n").alias("n2"), F.col("pos").alias("pos2"), F.col("label").alias("label2"))
            done.append(rest := written(rest, "rest"))
            pairs = now.join(rest, "h").where("label <> label2 AND (label = main OR sig < sig2)").where(_fits("n", "n2", "pos", "pos2", num, den)).select(F.col("sig2").alias("a"), F.col("sig").alias("b"))
        pairs = written(pairs.distinct(), "pairs")
        for old in [*done, *([] if labels is None else [now])]:
            remove(old)
        if not pairs.limit(1).count():
            remove(pairs)
            continue  # leaders may fit nothing where other pairs do
        new = _similar(pairs, items, num, den)
        remove(pairs)
        if new.limit(1).count():
            step_edges = new
            if labels is not None:
                step_edges = new.join(labels.select(F.col("sig").alias("a"), F.col("label").alias("la")), "a", "left").join(labels.select(F.col("sig").alias("b"), F.col("label").alias("lb")), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
            merged = components(step_edges).withColumnsRenamed({"node": "at", "label": "to"})
            if labels is None:
                labels = merged.withColumnsRenamed({"at": "sig", "to": "label"})
            else:
                nodes = labels.union(new.selectExpr("a AS sig", "a AS label").union(new.selectExpr("b AS sig", "b AS label")).distinct().join(labels, "sig", "left_anti"))
                after = written(nodes.join(merged, nodes.label == merged.at, "left").select("sig", F.coalesce("to", "label").alias("label")), "labels")
                remove(labels)
                remove(merged)
                labels = after
        remove(new)
    return labels
