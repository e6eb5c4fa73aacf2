import random
import re

import numpy as np
import pytest

from quillmill.llm.components import components
from quillmill.llm.kernels import Words, distinct, shingles
from quillmill.llm.ngram_join import PrefixTree, keep_one, link_counts, near_duplicates

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def sets(text):
    w = [x.lower() for x in WORD.findall((text or "").encode())]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    """(set size, component) of each row by comparing all pairs."""
    s = [sets(t) for _, t in rows]
    top = list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(s[i] & s[j])
            if s[i] and s[j] and 100 * both >= 80 * (len(s[i]) + len(s[j]) - both):
                top[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return [(d, len(s[i]), low.get(root(i)) if s[i] else d) for i, (d, _) in enumerate(rows)]


def near_copies(seed, n):
    rnd = random.Random(seed)
    base = [[f"w{rnd.randrange(400)}" for _ in range(rnd.choice([3, 8, 60, 150]))] for _ in range(12)]
    rows = []
    for i in range(n):
        words = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2, 4])):
            words[rnd.randrange(len(words))] = f"n{rnd.randrange(10**6)}"
        if rnd.random() < 0.3:
            words += rnd.choice(base)
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_as_by_all_pairs(spark, seed):
    rows = near_copies(seed, 150)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))


def test_link_whose_leaders_fit_nothing(spark):
    w = [f"w{i}" for i in range(1, 101)]
    rows = [(1, w), (2, [*w[:49], "other", *w[50:]]), (3, w[:49]), (4, w[50:])]
    rows = [(i, " ".join(x)) for i, x in rows]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows)) and brute(rows)[1][2] == 1


def test_odd_rows(odd, none):
    from .conftest import ROWS, sort

    assert sort(map(tuple, near_duplicates(odd).collect())) == sort(brute(ROWS))
    assert near_duplicates(none).count() == 0


def test_keep_one(odd, none):
    got = keep_one(odd)
    assert got.columns == odd.columns
    ids = [r.doc_id for r in got.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 4, 5, 6, 8, 10, 11, 11] and ids.count(None) == 2
    assert keep_one(none).count() == 0


def test_prefix_tree_finds_what_comparing_finds():
    rnd = np.random.default_rng(3)
    base = [np.unique(rnd.integers(1, 500, 60).astype(np.uint64)) for _ in range(8)]
    many = [x[rnd.random(len(x)) < 0.9] for x in base for _ in range(10)]
    many = [x[::-1].copy() for x in many if len(x)]
    tree = PrefixTree(many)
    for probe in map(np.sort, many[:40]):
        want = {i for i, x in enumerate(many) if 100 * (c := len(np.intersect1d(x, probe))) >= 80 * (len(x) + len(probe) - c)}
        assert {i for i, _ in tree.similar(probe, 80, 100)} == want


def test_words_and_shingles():
    texts = ["A b\tC\x0bd e f", "", None, "é É x\u00a0y"]
    assert [len(s) for s in shingles(texts)] == [2, 0, 0, 1]
    w = Words(["Ab ab", "AB"])
    h = w.hashes()
    assert h[0] == h[1] == h[2] and list(w.first) == [0, 2, 3]
    assert distinct(np.array([3, 1, 3], np.uint64)).tolist() == [1, 3]


def test_connected_components(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (3, 4), (9, 8), (7, 7), (5, None)] + [(20 + i, 21 + i) for i in range(30)], "a int, b int")
    got = {r.node: r.label for r in components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8, **{20 + i: 20 for i in range(31)}}


def test_one_tree_serves_many_probes():
    rnd = random.Random(3)
    sets_ = [np.array(sorted(rnd.sample(range(60), rnd.randrange(1, 25))), np.uint64) for _ in range(120)]
    tree = PrefixTree(sets_)
    for probe in sets_[::3]:
        among = rnd.sample(range(120), 40)
        want = sorted((i, len({*probe.tolist()} & {*sets_[i].tolist()})) for i in among if 2 * len({*probe.tolist()} & {*sets_[i].tolist()}) >= len({*probe.tolist()} | {*sets_[i].tolist()}))
        assert sorted(tree.similar(probe, 1, 2, among)) == want


def test_no_link_is_lost(spark, odd, none):
    rows = near_copies(7, 120) + [(200, None), (201, "")]
    s = [sets(t) for _, t in rows]
    want = []
    for i, (d, _) in enumerate(rows):
        both = [(len(s[i] & x), len(s[i] | x)) for j, x in enumerate(s) if j != i and s[i] and x]
        want.append((d, len(s[i]), sum(100 * a >= 80 * b for a, b in both)))
    got = link_counts(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted(map(tuple, got)) == sorted(want) and max(w[2] for w in want) > 10
    assert link_counts(odd).count() == odd.count() and link_counts(none).count() == 0
