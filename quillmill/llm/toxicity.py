"""Toxicity scores from a lexicon trie met by Levenshtein automata.

The lexicon holds stems: a seed list, and prefixes of words learnt from labelled
documents. For every stem the automaton of all spellings within one edit runs
along the trie of all stems; the product is made deterministic as words ask for
it, so a word is read character by character through one table, and most words
leave it within three characters. A hit is judged by the words around it:
quotation marks and words of speech mark it as quoted, forms of address as
aimed at someone. A logistic model weighs exact and misspelled, aimed, plain
and quoted hits.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, remove, written
from .kernels import Words, distinct

FOLDS = 5
TRAIN_DOCUMENTS = 20_000  # expected size of the sample of labelled rows, drawn by a hash of their id
WINDOW = 4  # words on either side of a hit
SHORTEST, LONGEST = 4, 12  # lengths of stems
FUZZY_FROM = 5  # stems of so many characters may be misspelled by one edit
SEED_STEMS = ("idiot", "moron", "stupid", "scum", "loser", "pathetic", "worthless", "disgusting", "imbecile", "retard", "bastard")
SPEECH = frozenset("said says say called calls wrote writes quote quoted sagte sagt schrieb nannte dijo dice llamó escribió dit disait appelé écrit".split())
ADDRESS = frozenset("you your you're u ur du dein deine dich ihr tu tus eres usted vous ton ta toi".split())
_EDGE = ".,;:!?\"'()[]{}<>«»„“”‚‘’…*_-–—/\\|~`#"
_QUOTES = "\"'«»„“”‚‘’`"


class _Node:
    __slots__ = ("end", "next", "stem")

    def __init__(self):
        self.next: dict[str, _Node] = {}
        self.end, self.stem = False, ""


class StemAutomaton:
    """Deterministic product of the stems' trie and their Levenshtein automata of one edit, built on demand.

    A word matches if one of its prefixes is a stem, or for stems of
    ``FUZZY_FROM`` characters or more is one edit away from it.
    """

    def __init__(self, stems):
        self.root = _Node()
        for s in stems:
            node = self.root
            for c in s:
                node = node.next.setdefault(c, _Node())
            node.end, node.stem = True, s
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.found: list[tuple[int, str] | None] = []  # errors and stem of the best match on reaching a state
        self.step: list[dict[str, int]] = []
        self.nodes: dict[int, _Node] = {}
        self.dead = self._state(frozenset())
        self.start = self._state(self._closed({(id(self.root), 0)}))
        self.cache: dict[str, int] = {}

    def _at(self, node: _Node) -> int:
        self.nodes[id(node)] = node
        return id(node)

    def _closed(self, states: set) -> frozenset:
        """With what follows by leaving out a character of the stem."""
        self.nodes[id(self.root)] = self.root
        out = set(states)
        for at, e in states:
            if not e:
                out.update((self._at(c), 1) for c in self.nodes[at].next.values())
        return frozenset(out)

    def _state(self, states: frozenset) -> int:
        if states not in self.ids:
            self.ids[states] = len(self.sets)
            self.sets.append(states)
            self.step.append({})
            ends = [(e, self.nodes[at].stem) for at, e in states if self.nodes[at].end and (not e or len(self.nodes[at].stem) >= FUZZY_FROM)]
            self.found.append(min(ends, default=None))
        return self.ids[states]

    def _follow(self, state: int, c: str) -> int:
        out = set()
        for at, e in self.sets[state]:
            node = self.nodes[at]
            if (child := node.next.get(c)) is not None:
                out.add((self._at(child), e))
            if not e:
                out.add((at, 1))  # c is one too many
                out.update((self._at(child), 1) for child in node.next.values())  # c stands for another
        self.step[state][c] = got = self._state(self._closed(out))
        return got

    def match(self, word: str) -> tuple[int, str] | None:
        """(errors, stem) of the best match of a prefix of ``word``."""
        head = word[:3]
        state = self.cache.get(head)
        best = None
        if state is None:
            state = self.start
            for c in head:
                to = self.step[state].get(c)
                state = self._follow(state, c) if to is None else to
            if len(self.cache) < 200_000:
                self.cache[head] = state
        if state == self.dead:
            return None
        if (hit := self.found[state]) is not None:
            best = hit
        for c in word[3:]:
            to = self.step[state].get(c)
            state = self._follow(state, c) if to is None else to
            if state == self.dead:
                break
            if (hit := self.found[state]) is not None and (best is None or hit < best):
                best = hit
                if not hit[0]:
                    break
        return best


def features(text: str, automaton: StemAutomaton) -> list[float]:
    """Exact and misspelled hits, each aimed, plain and quoted, and hits a hundred words."""
    words = text.lower().split()
    counts = [0.0] * 6
    for i, raw in enumerate(words):
        word = raw.strip(_EDGE)
        hit = automaton.match(word)
        if hit is None:
            continue
        around = words[max(0, i - WINDOW) : i] + words[i + 1 : i + 1 + WINDOW]
        marked = sum(q in raw for q in _QUOTES) or (any(w[:1] in _QUOTES for w in around[:WINDOW] if w) and any(w[-1:] in _QUOTES for w in around[-WINDOW:] if w))
        bare = {w.strip(_EDGE) for w in around}
        kind = 2 if marked or bare & SPEECH else 0 if bare & ADDRESS else 1
        counts[3 * hit[0] + kind] += 1
    total = sum(counts)
    return [*(math.log1p(c) for c in counts), math.log1p(100 * total / len(words)) if words else 0.0]


N_FEATURES = 7


@dataclass
class ToxicityModel:
    stems: tuple[str, ...] = SEED_STEMS
    weights: tuple[float, ...] = (3.0, 2.5, 0.5, 1.0, 0.7, 0.1, 0.5)
    bias: float = -2.5
    _automaton: StemAutomaton | None = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {"stems": self.stems, "weights": self.weights, "bias": self.bias, "_automaton": None}

    def score(self, text: str | None) -> float:
        if self._automaton is None:
            self._automaton = StemAutomaton(self.stems)
        z = self.bias + sum(w * x for w, x in zip(self.weights, features(text or "", self._automaton), strict=True))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))

    def column(self, text: str | Column) -> Column:
        model = self

        @F.arrow_udf("double")
        def score(texts: pa.Array) -> pa.Array:
            return pa.array((model.score(t.as_py()) for t in texts), pa.float64(), size=len(texts))

        return score(text)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights and bias of a ridge logistic regression, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.eye(x.shape[1]) * ridge
    penalty[-1, -1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += move
        if np.abs(move).max() < 1e-6:
            break
    return w


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold a word with a prefix, by label, combined within the task."""
    n = {0: Counter(), 1: Counter()}
    for b in batches:
        for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            words = {w.strip(_EDGE) for w in (text or "").lower().split()}
            n[toxic].update({w[:k] for w in words for k in range(SHORTEST, min(LONGEST, len(w)) + 1)})
    # what no toxic document of the task holds still counts against a prefix, so it goes too
    terms = list(n[0].keys() | n[1].keys())
    yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([n[k][t] for t in terms], pa.int64()) for k in (1, 0))], names=["term", "bad", "good"])


def _kin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The three least word hashes of each text: near copies nearly always agree in them."""
    for b in batches:
        keys = []
        for t in b.column("text"):
            keys.append(distinct(Words([t.as_py() or ""]).hashes())[:3].tobytes())
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.binary())], names=["doc_id", "text", "toxic", "kin"])


def choose_stems(counts: dict[str, tuple[int, int]], bad_docs: int, good_docs: int) -> list[str]:
    """Prefixes common in toxic documents and next to absent in others.

    Of prefixes that extend each other without losing a tenth of their
    documents the longest stands for all, and a stem makes longer ones
    needless. At least 0.3 % of the toxic documents, and 8, have to hold it.
    """
    least = max(8, math.ceil(0.003 * bad_docs))
    pure = {t for t, (b, g) in counts.items() if b >= least and (b + 0.5) / (bad_docs + 1) > 25 * (g + 0.5) / (good_docs + 1)}
    longest: dict[str, int] = {}
    for t in pure:
        if t[:-1] in counts:
            longest[t[:-1]] = max(longest.get(t[:-1], 0), counts[t][0])
    closed = {t for t in pure if longest.get(t, 0) < 0.9 * counts[t][0]}
    return sorted(t for t in closed if not any(t[:k] in closed for k in range(SHORTEST, len(t))))


def train(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, most: int = TRAIN_DOCUMENTS) -> ToxicityModel:
    """Learn stems and weights from labelled rows whose crc32(doc_id) mod ``folds`` is not 0.

    About ``most`` rows of ``labels`` (doc_id, toxic) at most, drawn by a hash
    of their distinct ids, are joined with ``docs`` (broadcast: the bound proves
    its size). Near copies among them count once. Where either class has fewer than
    10 documents, the seed stems and default weights hold.
    """
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(fold("doc_id", folds) != 0).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = min(1.0, most / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < math.ceil(1_000_000 * share))
    own = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").mapInArrow(_kin, "doc_id long, text string, toxic int, kin binary")
    own = own.groupBy("kin", "toxic").agg(F.min_by("text", "doc_id").alias("text")).select("text", "toxic")
    own = written(own, "labelled")
    sizes = {r.toxic: r["count"] for r in own.groupBy("toxic").count().collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if min(bad, good) < 10:
        remove(own)
        return ToxicityModel()
    terms = own.mapInArrow(_prefixes, "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    some = terms.where(f"bad >= 8 AND bad >= {0.003 * bad}").where((F.col("bad") + 0.5) * (good + 1) > (F.col("good") + 0.5) * (bad + 1) * 2)
    counts = {r.term: (r.bad, r.good) for r in some.collect()}  # each held by 0.3 % of a bounded sample or more
    stems = tuple(sorted({*SEED_STEMS, *choose_stems(counts, bad, good)}))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = StemAutomaton(stems)
        for b in batches:
            rows = [features(t or "", automaton) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), b.column("toxic")], names=["x", "toxic"])

    rows = own.mapInArrow(measure, "x array<double>, toxic int").collect()  # at most ``most`` rows of numbers
    remove(own)
    w = fit_logistic(np.array([r.x for r in rows]), np.array([r.toxic for r in rows], float))
    return ToxicityModel(stems, tuple(float(v) for v in w[:-1]), float(w[-1]))


def score_documents(docs: DataFrame, labels: DataFrame, folds: int = FOLDS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text).

    Null and empty texts have no hits and get the score of a text without any.
    A null doc_id counts as the empty id for the fold. Repeated rows and equal
    texts get equal scores. Further columns are not read. Scoring does not shuffle.
    """
    model = train(docs, labels, folds)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", folds) == 0).alias("held_out"), model.column("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
