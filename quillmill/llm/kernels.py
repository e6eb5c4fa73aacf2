"""Vectorised text kernels: words, word hashes and shingle hashes of many texts at once.

A batch of texts is one byte buffer, with a line feed after each text, so that
no word crosses from one text to the next. Words are maximal runs of bytes
other than 0x20 and 0x09-0x0D, with A-Z lower-cased; in UTF-8 these bytes
stand for nothing else. A word's hash is a polynomial over randomised bytes
modulo 2**64, taken from prefix sums and then scrambled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

U = np.uint64
PIECE_BYTES = 1 << 20  # texts are handled in pieces of about this size, which bounds the temporaries

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_COEF = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * U(2) + U(1)
_P = 0x9E3779B97F4A7C55
_PINV = pow(_P, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values; a bijection (the finaliser of splitmix64)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; sorting is several times as fast as numpy's hashing here."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def planes(x: np.ndarray) -> bytes:
    """The bytes of an array's values, all lowest ones first: what values have in common lies together and compresses."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unplanes(raw, dtype) -> np.ndarray:
    """The array that ``planes`` made ``raw`` (bytes or an Arrow buffer) of."""
    if not len(raw):
        return np.zeros(0, dtype)
    size = np.dtype(dtype).itemsize
    return np.frombuffer(raw, np.uint8).reshape(size, len(raw) // size).T.copy().view(dtype).reshape(-1)


def steps(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as planes of the steps between them: a third of their size once compressed."""
    return planes(np.diff(keys, prepend=U(0)))


def unsteps(raw) -> np.ndarray:
    keys = unplanes(raw, np.uint64)
    return np.cumsum(keys, out=keys)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("p", ())) < n:
        n = 1 << max(16, (n - 1).bit_length())
        for k, base in (("p", _P), ("q", _PINV)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=np.uint64)
    return _powers["p"], _powers["q"]


def pieces(texts: Iterable[str | None], most: int = PIECE_BYTES) -> Iterator[list[str]]:
    """Runs of texts of about ``most`` characters; a longer text is alone. None counts as empty."""
    out: list[str] = []
    size = 0
    for t in texts:
        t = t or ""
        if out and size + len(t) > most:
            yield out
            out, size = [], 0
        out.append(t)
        size += len(t)
    if out:
        yield out


class Words:
    """The words of some texts: ``start``, ``end`` (bytes of ``buf``), ``first`` (of each text, and the end)."""

    def __init__(self, texts: list[str], lower: bool = True):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        joined = b"\n".join([*raw, b""])
        self.bytes = joined.lower() if lower else joined
        self.buf = np.frombuffer(self.bytes, np.uint8)
        ends = np.cumsum([len(r) + 1 for r in raw], dtype=np.int64) if raw else np.zeros(0, np.int64)
        self.text_end = ends
        inside = ~_SPACE[self.buf]
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
        self.start, self.end = edge[::2], edge[1::2]
        self.first = np.concatenate(([0], np.searchsorted(self.start, ends))).astype(np.int64)

    def hashes(self) -> np.ndarray:
        n = len(self.buf)
        if not len(self.start):
            return np.zeros(0, np.uint64)
        p, q = powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.buf] * p[:n], out=sums[1:])
        raw = (sums[self.end] - sums[self.start]) * q[self.start]
        return mix(raw + (self.end - self.start).astype(np.uint64) * U(_COEF[63]))


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of ``width`` words.

    A text of fewer words has its whole sequence as one shingle; a text
    without words has none.
    """
    if len(words) >= width:
        n = len(words) - width + 1
        s = words[:n] * _COEF[0]
        for k in range(1, width):
            s += words[k : n + k] * _COEF[k]
        s = mix(s)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(distinct(s[a : b - width + 1]))
        elif b > a:
            short = np.sum(words[a:b] * _COEF[8 : 8 + b - a], dtype=np.uint64, keepdims=True)
            out.append(mix(short + U(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingles(texts: Iterable[str | None], width: int = 5) -> Iterator[np.ndarray]:
    """Shingle sets of texts, in their order, in bounded memory."""
    for piece in pieces(texts):
        w = Words(piece)
        yield from shingle_hashes(w.hashes(), w.first, width)
