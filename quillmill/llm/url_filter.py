"""URL filter over a memory-mapped, sorted array of 64-bit digests.

Rules are (host, path) pairs. The index file holds the xxhash64 digests of
``host + path`` in ascending order, and the full strings beside them. A URL is
probed with suffixes of its host at a label boundary, joined with prefixes of
its path. Only suffixes and prefixes as long as those of some rule can be a
rule, and the index names these lengths: a URL of any length has at most as many
probes as there are pairs of lengths, none longer than the longest rule. A
vectorised binary search serves a run of probes, and a hit counts only if the
stored string is the probe itself, so digest collisions never decide a verdict.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from .common import scratch

RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
VERDICTS = ("allow", "block")
PROBES = 1 << 16  # probes are looked up in runs of about so many
URLS = 1024  # rows in an Arrow batch of results

_PARTS = re.compile(r"([^/?#]*)([^?#]*)")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty where the URL is null or has no ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host, path = _PARTS.match(rest).groups()
    return host.translate(_LOWER), path


def index_bytes(rules: Iterable[tuple[str, str, str]]) -> bytes:
    """The index file: counts, lengths (of host and path) that rules have, digests, verdicts, offsets and strings. The last of equal rules holds."""
    found = {host.translate(_LOWER) + path: (len(host), len(path), VERDICTS.index(verdict)) for host, path, verdict in rules}
    texts = sorted(found, key=lambda t: (xxhash.xxh64_intdigest(t.encode()), t))
    raw = [t.encode() for t in texts]
    lengths = sorted({found[t][:2] for t in texts}, reverse=True)
    head = np.array([len(raw), len(lengths), *(n for pair in lengths for n in pair)], np.uint64)
    keys = np.array([xxhash.xxh64_intdigest(r) for r in raw], np.uint64)
    marks = np.array([found[t][2] for t in texts], np.uint64)
    ends = np.cumsum([0, *map(len, raw)], dtype=np.uint64)
    return b"".join(x.tobytes() for x in (head, keys, marks, ends)) + b"".join(raw)


class DigestIndex:
    def __init__(self, data: np.ndarray):
        n, m = (int(x) for x in data[:16].view(np.uint64))
        at = 16 + 16 * m
        pairs = data[16:at].view(np.uint64).astype(int).reshape(-1, 2).tolist()
        self.lengths = {h: [p for g, p in pairs if g == h] for h, _ in pairs}
        self.keys = data[at : at + 8 * n].view(np.uint64)
        self.marks = data[at + 8 * n : at + 16 * n].view(np.uint64)
        self.ends = data[at + 16 * n : at + 24 * n + 8].view(np.uint64)
        self.text = data[at + 24 * n + 8 :]

    def find(self, probes: list[str]) -> np.ndarray:
        """For each probe the place of its rule, or -1."""
        raw = [p.encode("utf-8", "surrogatepass") for p in probes]
        keys = np.array([xxhash.xxh64_intdigest(r) for r in raw], np.uint64)
        at = np.searchsorted(self.keys, keys)
        out = np.full(len(raw), -1)
        inside = np.flatnonzero(at < len(self.keys))
        for i in inside[self.keys[at[inside]] == keys[inside]].tolist():
            k = int(at[i])
            while k < len(self.keys) and self.keys[k] == keys[i]:
                if self.text[int(self.ends[k]) : int(self.ends[k + 1])].tobytes() == raw[i]:
                    out[i] = k
                    break
                k += 1
        return out

    def _probes(self, host: str, path: str) -> Iterator[str]:
        """What a rule that fits the URL can be."""
        for h, paths in self.lengths.items():
            # a rule's host is the URL's, or what follows one of its dots
            if 0 < h <= len(host) and (h == len(host) or host[-h - 1] == "."):
                yield from (host[-h:] + path[:p] for p in paths if p <= len(path))

    def judge(self, urls: Iterable[str | None], default: str = "allow") -> Iterator[tuple[str, str, str | None, str]]:
        """(host, path, rule, verdict) of each URL; the longest rule wins."""
        parts: list[tuple[str, str]] = []
        probes: list[str] = []
        owner: list[int] = []

        def judged() -> Iterator[tuple[str, str, str | None, str]]:
            found = self.find(probes)
            best: list[tuple[int, str, int] | None] = [None] * len(parts)
            for j in np.flatnonzero(found >= 0).tolist():
                i, rule = owner[j], (len(probes[j]), probes[j], int(found[j]))
                if best[i] is None or rule > best[i]:
                    best[i] = rule
            for p, b in zip(parts, best, strict=True):
                yield (*p, b[1] if b else None, VERDICTS[int(self.marks[b[2]])] if b else default)

        for u in urls:
            parts.append(split_url(u))
            probes += self._probes(*parts[-1])
            owner += [len(parts) - 1] * (len(probes) - len(owner))
            if len(probes) >= PROBES or len(parts) >= PROBES:
                yield from judged()
                parts, probes, owner = [], [], []
        yield from judged()


def write_index(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> str:
    """Write the index once to the shared folder and return its place."""
    uri = scratch(spark, "urls") + ".index"
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(path) as out:
        out.write(index_bytes(rules))
    return uri


@lru_cache(maxsize=4)
def open_index(uri: str) -> DigestIndex:
    """Memory-map the index where the shared folder is a mounted one; else read it once a worker."""
    store, path = fs.FileSystem.from_uri(uri)
    if isinstance(store, fs.LocalFileSystem):
        return DigestIndex(np.memmap(path, np.uint8, "r"))
    with store.open_input_stream(path) as f:
        return DigestIndex(np.frombuffer(f.read(), np.uint8))


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages`` (page_id, url).

    A URL that no rule fits gets ``default``, as do null URLs and URLs without
    ``://``, whose host and path are empty. A very long URL is judged whole, in
    memory of a few times its length. Rules without a host fit nothing.
    Repeated rows and null ids are judged like any other; further columns are
    not read. No shuffle.
    """
    uri = write_index(pages.sparkSession, rules)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = open_index(uri)
        for whole in batches:
            for a in range(0, whole.num_rows, URLS):
                b = whole.slice(a, URLS)
                rows = [*index.judge((u.as_py() for u in b.column("url")), default)]
                cols = [pa.array([r[k] for r in rows], pa.string()) for k in range(4)]
                yield pa.RecordBatch.from_arrays([b.column("page_id"), *cols], names=["page_id", "host", "path", "rule", "verdict"])

    return pages.selectExpr("CAST(page_id AS LONG) AS page_id", "url").mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string")
