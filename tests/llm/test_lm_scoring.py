import functools
import itertools
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from quillmill.llm import lm_scoring
from quillmill.llm.kernels import planes, steps, unplanes, unsteps
from quillmill.llm.lm_scoring import _Tree, keys_of, log_gamma, log_kt, score_texts

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def tokens(text):
    return [w.lower() for w in WORD.findall((text or "").encode())]


def held(i):
    return zlib.crc32(str("" if i is None else i).encode()) % 10 == 0


def base(rows):
    c = Counter(t for i, x in rows if not held(i) for t in [*tokens(x), None])
    n, v = sum(c.values()), len(c)
    out = []
    for i, x in rows:
        ts = [*tokens(x), None]
        out.append((i, held(i), len(ts), sum(c[t] > 0 for t in ts), n, sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts)))
    return out


class Brute:
    """Context-tree weighting from its definition: the root's weighted probability of all decisions counted so far."""

    def __init__(self, texts, depth):
        self.depth, self.n, self.children = depth, Counter(), {}
        for t in texts:
            for context, node, bit in self.bits(t):
                self.count(context, node, bit, 1)

    def count(self, context, node, bit, by):
        for d in range(self.depth + 1):
            self.n[context[:d], node, bit] += by
            if d:
                self.children.setdefault((context[: d - 1], node), set()).add(context[:d])

    def bits(self, text):
        data = b"\n" * self.depth + b" ".join(tokens(text)) + b"\n"
        for i in range(self.depth, len(data)):
            context = tuple(reversed(data[i - self.depth : i]))
            for j in range(8):
                yield context, (1 << j) | data[i] >> (8 - j), data[i] >> (7 - j) & 1

    def kt(self, c, node):
        a, b = self.n[c, node, 0], self.n[c, node, 1]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(self, c, node):
        """ln of (KT + product of the children) / 2, of KT alone at the last depth."""
        own = self.kt(c, node)
        if len(c) == self.depth:
            return own
        inner = sum(self.weighted(k, node) for k in self.children.get((c, node), ()))
        return np.logaddexp(own, inner) - math.log(2)

    @functools.cache  # noqa: B019
    def p(self, context, node, bit):
        """The root's weighted probability with this decision over that without it."""
        before = self.weighted((), node)
        self.count(context, node, bit, 1)
        after = self.weighted((), node)
        self.count(context, node, bit, -1)
        return math.exp(after - before)

    def score(self, text):
        return sum(math.log10(self.p(c, node, b)) for c, node, b in self.bits(text))


@pytest.mark.parametrize("depth", [2, 3, 6])
def test_scores_as_by_the_definition(spark, depth):
    rnd = random.Random(depth)
    rows = [(i, " ".join(rnd.choice(("abra", "cadabra", "Ab", "ba", "cab", "é")) for _ in range(rnd.randrange(0, 9)))) for i in range(60)]
    got = {r.doc_id: r for r in score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), depth=depth).collect()}
    model = Brute([t for i, t in rows if not held(i)], depth)
    for i, h, n, k, total, b in base(rows):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, n, k, total)
        assert r.base_score == pytest.approx(b, rel=1e-9) and r.score == pytest.approx(model.score(rows[i][1]), rel=1e-5)


def test_every_decision_as_by_the_definition():
    depth, texts = 6, ["abra cadabra", "ab ba", "cab abra", "abra abra cab"]
    model = Brute(texts, depth)
    keys, counts = np.unique(np.concatenate([keys_of([t], depth)[0] for t in texts]), return_counts=True)
    tree = _Tree(keys, counts.astype(np.uint64), depth, least=0)
    seen = 0
    for t in [*texts, "abacab", "zebra abba", "é"]:
        bits = [*model.bits(t)]
        got = tree.log10(keys_of([t], depth)[0], [])
        for i, g in enumerate(got):
            assert g == pytest.approx(sum(math.log10(model.p(*x)) for x in bits[8 * i : 8 * i + 8]), abs=1e-9)
            seen += 8
    assert seen > 400


def test_large_buckets_and_inputs_are_dealt_out(spark, monkeypatch):
    """Copies of buckets and merging in rounds change no score."""
    rows = [(i, "abra cadabra " * (i % 7) + "cab" * (i % 3)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = sorted(map(tuple, score_texts(docs).collect()))
    for name, value in (("SALT_POSITIONS", 40), ("SALT_KEYS", 1), ("GATHER_BYTES", 4096), ("CHUNK_BYTES", 256), ("MOST_CHUNK_BYTES", 256)):
        monkeypatch.setattr(lm_scoring, name, value)
    dealt = []
    deal = lm_scoring._dealt
    monkeypatch.setattr(lm_scoring, "_dealt", lambda model: dealt.append(deal(model)) or dealt[-1])
    got = sorted(map(tuple, score_texts(docs).collect()))
    assert max(dealt[0][1].values()) > 2 and [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-5)


def test_a_proper_distribution(spark):
    """Probabilities of all next bytes sum to one, so a prefix code of the scores exists."""
    rows = [(i, "aab aba") for i in range(12)]
    m = Brute([t for i, t in rows if not held(i)], 2)
    total = 0.0
    for byte in range(256):
        p = 1.0
        for j in range(8):
            p *= m.p((97, 97), (1 << j) | byte >> (8 - j), byte >> (7 - j) & 1)
        total += p
    assert total == pytest.approx(1)


def test_odd_rows(odd, none, spark):
    from .conftest import ROWS, sort

    got = score_texts(odd).collect()
    want = sort((*x[:5], round(x[5], 6)) for x in base(ROWS))
    assert sort((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert score_texts(none).count() == 0
    only = next(i for i in itertools.count() if held(i))
    (r,) = score_texts(spark.createDataFrame([(only, "ab")], "doc_id long, text string")).collect()
    assert r.train_tokens == 0 and r.score == pytest.approx(24 * math.log10(0.5))


def test_gamma():
    x = np.array([0.5, 1, 1.5, 7, 1e3, 1e7])
    assert np.allclose(log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-11, atol=1e-11)
    assert log_kt(np.array([1.0]), np.array([0.0]))[0] == pytest.approx(math.log(0.5))


@given(st.lists(st.integers(0, 2**64 - 1)), st.lists(st.floats(width=32, allow_nan=False)))
def test_keys_and_values_travel_whole(keys, values):
    keys, values = np.unique(np.array(keys, np.uint64)), np.array(values, np.float32)
    assert unsteps(steps(keys)).tolist() == keys.tolist() and unsteps(steps(keys)).dtype == np.uint64
    assert unplanes(planes(values), np.float32).tolist() == values.tolist()


def test_merging_drops_its_parts():
    """While parts are sorted they are held once, not twice."""
    n = 1 << 18
    rng = np.random.default_rng(4)
    parts = [(rng.integers(0, 1 << 60, n, dtype=np.uint64), np.ones(n, np.uint64)) for _ in range(8)]
    whole = 16 * 8 * n
    tracemalloc.start()
    parts = [(k.copy(), c.copy()) for k, c in parts]  # as many bytes, traced
    keys, counts = lm_scoring._merge(parts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert counts.sum() == 8 * n and (np.diff(keys.astype(np.int64)) > 0).all() and not parts
    assert peak < 2.8 * whole
