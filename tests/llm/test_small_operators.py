"""Fingerprints, sharding, WARC, URL filter, packing."""

import hashlib
import io
import json
import random
import zlib

import numpy as np
import pytest

from quillmill.llm.fingerprints import BottomK, fingerprint, sketches
from quillmill.llm.packing import END, SEQUENCE, TournamentTree, first_fit_decreasing, pack
from quillmill.llm.sharding import lookup_table, place
from quillmill.llm.tokens import encoder
from quillmill.llm.url_filter import DigestIndex, filter_urls, index_bytes, split_url
from quillmill.llm.warc import WarcError, read_records, record, round_trip

# ---- fingerprints ----


def edited(rows):
    rows = sorted(rows, key=lambda r: r[0])
    out = {}
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        q = len(t) // 4
        out[i] = (len(t), t[: len(t) - q] + after[:q])
    return out


def test_edits_across_ranges(spark):
    rnd = random.Random(4)
    rows = [(i * 7 - 300, "".join(rnd.choice("ab cé😀") for _ in range(rnd.randrange(300)))) for i in range(200)]
    rnd.shuffle(rows)
    rows[3] = (rows[3][0], None)
    got = fingerprint(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    want = edited(rows)
    assert len(got) == 200
    for r in got:
        n, e = want[r.doc_id]
        assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        (s,) = sketches([e])
        assert r.edited_fingerprint == str(s)
        assert r.near_edited == BottomK.parse(r.fingerprint).resemblance(s)


def test_likeness_as_by_sets(spark):
    """Against sets of runs of 12 bytes: exact where the sketches hold all of them, within four standard errors beyond."""
    rnd = random.Random(12)
    base = "".join(rnd.choice("abcdefgh é") for _ in range(4000))
    rows = []
    for i in range(120):
        n = rnd.choice([0, 1, 3, 20, 45, 60]) if i % 2 else rnd.randrange(800, 3000)
        at = rnd.randrange(900)
        rows.append((i * 3, base[at : at + n]))

    def runs(t):
        raw = b"\0" * 11 + t.encode()
        return {raw[k : k + 12] for k in range(len(t.encode()))}

    def like(a, b):
        a, b = runs(a), runs(b)
        return (len(a & b) / len(a | b) if a | b else 1.0), len(a | b)

    texts = dict(rows)
    want, prints, exact, far = edited(rows), {}, 0, []
    for r in fingerprint(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect():
        after = texts.get(r.doc_id + 3, texts[0])
        for got, other in ((r.near_edited, want[r.doc_id][1]), (r.near_next, after)):
            true, n = like(texts[r.doc_id], other)
            if n <= 128:
                assert abs(got - true) < 1e-12
                exact += 1
            else:
                far.append(abs(got - true) - 4 * (true * (1 - true) / 128) ** 0.5)
        n = len(runs(texts[r.doc_id]))
        assert r.n_shingles == n if n < 128 else abs(r.n_shingles / n - 1) < 0.4
        assert prints.setdefault(r.fingerprint, texts[r.doc_id]) == texts[r.doc_id] or n > 128
    assert exact > 50 and len(far) > 50 and max(far) < 0.02


def test_odd_documents(odd, none, spark):
    got = fingerprint(odd).collect()
    assert len(got) == odd.count() and fingerprint(none).count() == 0
    by: dict = {}
    for r in got:
        by.setdefault(r.n_chars, set()).add(r.fingerprint)
    assert by[0] == {""} and len(by[9]) == 1
    (one,) = fingerprint(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")).collect()
    assert one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one.near_next == 1.0


def test_sketches_merge_and_estimate():
    rnd = np.random.default_rng(1)
    a, b = rnd.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2), rnd.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2)
    x, y, z = BottomK.of_hashes(a), BottomK.of_hashes(np.concatenate((a[:2500], b[:2500]))), BottomK.of_hashes(np.concatenate((a, b)))
    assert str(BottomK.of_hashes(a[:2000]).merge(BottomK.of_hashes(a[2000:]))) == str(x)
    assert abs(x.resemblance(y) - 1 / 3) < 0.15 and abs(x.containment(y) - 0.5) < 0.2 and abs(z.distinct() / 10_000 - 1) < 0.3
    assert BottomK.of_hashes(a[:50]).distinct() == 50
    assert str(BottomK.parse(str(x))) == str(x)


# ---- sharding ----


def filled(shards, size, off, step):
    table, k = [None] * size, [0] * len(shards)
    while None in table:
        for i in range(len(shards)):
            if None not in table:
                break
            while table[(off[i] + k[i] * step[i]) % size] is not None:
                k[i] += 1
            table[(off[i] + k[i] * step[i]) % size] = i
    return table


def test_table_as_by_the_plain_rule():
    from quillmill.llm.sharding import _hash

    names = ["a", "b", "c", "d"]
    off, step = [_hash(n, "offset") % 101 for n in names], [_hash(n, "step") % 100 + 1 for n in names]
    assert lookup_table(names, 101).tolist() == filled(names, 101, off, step)


def test_balance_and_small_moves():
    names = [f"s{i}" for i in range(20)]
    t = lookup_table(names, 2003)
    n = np.bincount(t)
    assert n.max() - n.min() <= 1
    less = lookup_table(names[:-1], 2003)
    assert np.mean(less[t < 19] != t[t < 19]) < 0.15
    with pytest.raises(ValueError):
        lookup_table(names, 2000)
    with pytest.raises(ValueError):
        lookup_table(["a", "a"], 7)


def test_placement(odd, none):
    got = place(odd, size=101, shards=["a", "b"]).collect()
    assert len(got) == odd.count() and {r.shard for r in got} <= {"a", "b"}
    assert len({r.slot for r in got if r.doc_id == 7}) == 1
    assert place(none).count() == 0
    plain = {(r.k, r.slot, r.shard) for r in place(odd.selectExpr("text AS k"), "k", size=101, shards=["a", "b"]).collect()}
    for name in ("slot", "shard", "_slot", "a.b"):
        again = place(odd.select(odd.text.alias(name)), name, size=101, shards=["a", "b"])
        assert again.columns == [name, "slot", "shard"] and {tuple(r) for r in again.collect()} == plain


# ---- WARC ----


def test_records_read_back_and_flaws_show():
    data = record(1, "http://a b\n", b"x" * 700_000) + record(2, None, b"", 1) + record(None, "u", "é".encode())
    got = list(read_records(io.BytesIO(data), keep_payload=True))
    assert [(r.page_id, r.headers["warc-type"], r.payload_bytes, r.refers_to) for r in got] == [(1, "response", 700_000, None), (2, "revisit", 0, 1), (None, "response", 2, None)]
    assert got[0].payload == b"x" * 700_000 and got[0].headers["warc-target-uri"] == "http://a%20b%0A"
    with pytest.raises(WarcError):
        list(read_records(io.BytesIO(data[:200])))
    z = zlib.compressobj(wbits=31)
    bad = zlib.decompress(record(1, "u", b"abc"), 31).replace(b"abc", b"abd")
    with pytest.raises(WarcError):
        list(read_records(io.BytesIO(z.compress(bad) + z.flush())))


def test_round_trip(spark):
    big = "é" * 600
    rows = [(1, "u", big), (5, "u", big), (5, "v", big), (None, "w", big), (2, None, None), (3, "x", ""), (4, "y", "short"), (6, "y", "short"), (7, "z", "lone" * 400), (None, "q", "n" * 2000), (None, "r", "n" * 2000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in round_trip(df).collect())
    want = []
    for i, _, h in rows:
        p = (h or "").encode()
        same = [x[0] for x in rows if (x[2] or "").encode() == p and x[0] is not None]
        top = max(same, default=None) if len(p) >= 1000 else None
        refers = top if top is not None and i != top else None
        want.append((str(i), len(p), hashlib.sha1(p).hexdigest(), "response" if refers is None else "revisit", refers))
    assert got == sorted(want, key=lambda x: tuple(map(str, x))) or got == sorted(want)
    assert round_trip(df.limit(0)).count() == 0


# ---- URL filter ----


def test_hosts_and_paths():
    assert split_url("HTTP://WWW.Ex.org:80/A?b#c") == ("www.ex.org:80", "/A")
    assert split_url("x://h#f/g") == ("h", "") and split_url("mailto:a") == ("", "") and split_url(None) == ("", "")


def test_collisions_are_confirmed(monkeypatch):
    import xxhash

    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda b: len(b) % 3)
    rules = [("a.org", "/", "block"), ("b.org", "/", "allow"), ("c.com", "/x", "block")]
    index = DigestIndex(np.frombuffer(index_bytes(rules), np.uint8))
    assert [next(index.judge([u]))[2] for u in ("s://a.org/", "s://z.b.org/q", "s://c.com/y", "s://c.com/xy", "s://d.org/")] == ["a.org/", "b.org/", None, "c.com/x", None]


def test_verdicts(spark):
    urls = ["http://example.org/es/1", "http://w.example.org/en/12", "http://example.org/en/2", "https://a.com/fr/", "https://com/de/x", "http://notexample.org/es/", "http://x.org", "http://x.net/es/", None, "nothing", ""]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in filter_urls(df).collect()}
    assert [got[i] for i in range(len(urls))] == [
        ("example.org/es/", "block"), ("example.org/en/1", "block"), ("org/", "allow"), ("com/fr/", "allow"), ("com/de/", "block"), ("org/", "allow"),
        (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"),
    ]
    assert filter_urls(df.limit(0)).count() == 0


def plain_verdict(url, rules):
    host, path = split_url(url)
    fits = [(h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda r: (len(r[0]), r[0]), default=(None, "allow"))


def test_verdicts_as_by_trying_every_rule(spark):
    from pyspark.sql import functions as F

    rnd = random.Random(5)
    host = lambda: ".".join(rnd.choice(["a", "bb", "c", "é", ""]) for _ in range(rnd.randrange(1, 5)))
    path = lambda: "/" + "/".join(rnd.choice(["x", "yy", "é", ""]) for _ in range(rnd.randrange(4)))
    rules = [*{(host(), path()): rnd.choice(["allow", "block"]) for _ in range(60)}.items()]
    rules = [(h, p, v) for (h, p), v in rules if h]
    whole = {h + p: (h, p, v) for h, p, v in rules}  # equal strings cannot be told apart
    rules = [*whole.values()]
    rows = [(None if i == 9 else i % 900, f"s://{host().upper()}{path()}?q#f") for i in range(1000)] + [(7, None), (7, None)]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("x") for c in ("host", "path", "rule", "verdict", "html")})
    got = sorted((str(r.page_id), r.host, r.path, str(r.rule), r.verdict) for r in filter_urls(df, rules).collect())
    want = []
    for i, u in rows:
        rule, verdict = plain_verdict(u, rules)
        want.append((str(i), *split_url(u), str(rule), verdict))
    assert got == sorted(want) and len({w[3] for w in want}) > 10


def test_a_very_long_url_takes_little_memory():
    import tracemalloc

    index = DigestIndex(np.frombuffer(index_bytes([("org", "/", "allow"), ("a.org", "/" + "p" * 50, "block")]), np.uint8))
    urls = ["s://" + "a." * 500_000 + "org/" + "p" * 60, "s://" + "x" * 10 + ".org/" + "p/" * 500_000, "s://" + "." * 1_000_000]
    tracemalloc.start()
    got = [r[2:] for r in index.judge(iter(urls))]
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()
    assert got == [("a.org/" + "p" * 50, "block"), ("org/", "allow"), (None, "allow")]


# ---- packing ----


def test_first_fit_decreasing():
    rnd = random.Random(9)
    n = np.array([rnd.randrange(1, 101) for _ in range(500)])
    bins, offsets = first_fit_decreasing(n, 100)
    rooms, want = [], {}
    for i in sorted(range(500), key=lambda i: -n[i]):
        b = next((k for k, r in enumerate(rooms) if r >= n[i]), None)
        if b is None:
            rooms.append(100)
            b = len(rooms) - 1
        want[i] = (b, 100 - rooms[b])
        rooms[b] -= n[i]
    assert [want[i] for i in range(500)] == [*zip(bins.tolist(), offsets.tolist(), strict=True)]
    assert TournamentTree(1, 5).place(6) == -1


def test_pieces_cover_documents(odd, none):
    from .conftest import ROWS, sort

    rows = pack(odd, keep_ids=True).collect()
    encode = encoder()
    want = sort((i, len(encode(t or "")) + 1) for i, t in ROWS)
    got = []
    fill: dict = {}
    for r in rows:
        ids = np.array(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(ids.tobytes()) == r.ids_crc32 and (ids[-1] == END) == (r.start + r.length == r.doc_tokens)
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
        if r.start == 0:
            got.append((r.doc_id, r.doc_tokens))
    assert sort(got) == want and sum(r.length for r in rows) == sum(n for _, n in want)
    for pieces in fill.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= SEQUENCE
    assert pack(none).count() == 0 and "ids" not in pack(none).columns


def test_ids_are_those_of_the_tokenizer_file(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rnd = random.Random(2)
    end = "<|endoftext|>"
    texts = ["", "  a\n\n b", end, f"a {end} b", f"{end} a", f"a{end}", f"{end}{end}", f"x {end} y {end} z", "<|endoftext", "don't 123 é😀", json.dumps({"a": [1, 2]})]
    texts += ["".join(rnd.choice("ab'é 1\n.,\u00a0𝔘") for _ in range(60)) for _ in range(200)]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert [encoder()(x).tolist() for x in texts] == want and want[3] == [64, 220, 50256, 275]
    got = pack(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), keep_ids=True).collect()
    assert sorted((r.doc_id, r.ids) for r in got) == [(i, [*w, END]) for i, w in enumerate(want)]
