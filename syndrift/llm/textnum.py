"""Words and their hashes for a batch of texts, in numpy over the UTF-8 bytes.

A batch is ``(buf, offs)``: the bytes of all texts, and where each begins (one more offset than texts).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PLAIN = np.arange(256, dtype=np.uint8)
#: Bytes between words: ASCII white space; or all of ASCII but digits and letters.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
MARKS = np.ones(256, bool)
MARKS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
SPAN = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n <= SPAN + 1:
        if not _POWERS:
            _POWERS["up"], _POWERS["down"] = powers(BASE, SPAN + 1), powers(INVERSE, SPAN + 1)
        return _POWERS["up"], _POWERS["down"]
    return powers(BASE, n), powers(INVERSE, n)


def pack(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string column; null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    arr = texts.cast(pa.large_string()).fill_null("")
    _, offs, data = arr.buffers()
    offs = np.frombuffer(offs, np.int64)[arr.offset : arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def parts(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer text is a range of its own."""
    lens = texts.cast(pa.large_string()).fill_null("")
    lens = np.diff(pack(lens)[1])
    at, held = 0, 0
    for i, n in enumerate(lens.tolist()):
        if held and held + n > most:
            yield at, i
            at, held = i, 0
        held += n
    if at < len(lens):
        yield at, len(lens)


def words(buf: np.ndarray, offs: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the number of words of each text."""
    inside = ~between[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offs[:-1][offs[:-1] < len(buf)]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = offs[1:][offs[1:] > 0] - 1
    last[tails] = inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offs))


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, folded: np.ndarray = PLAIN) -> np.ndarray:
    """A 64-bit hash of each byte range, alike in every batch.

    Prefix sums of a polynomial give the ranges' sums; dividing by the power at the start makes them free of
    the place.  Ranges are taken in spans of a mebibyte, so the tables of powers stay small.
    """
    out = np.empty(len(starts), U)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + SPAN, "right")))
        lo, hi = int(starts[at]), int(ends[to - 1])
        up, down = _powers(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, U)
        np.cumsum((folded[buf[lo:hi]].astype(U) + U(1)) * up[: hi - lo], out=sums[1:])
        s, e = starts[at:to] - lo, ends[at:to] - lo
        out[at:to] = (sums[e] - sums[s]) * down[s] + (e - s).astype(U) * U(0xD6E8FEB86659FD93)
        at = to
    return mix(out)


def word_hash(word: str) -> int:
    """What ``hashes`` gives for one word."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(hashes(raw, np.array([0]), np.array([len(raw)]))[0])


def grams(h: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of n words that stays in its text, and the word at which it starts."""
    if len(h) < n:
        return np.zeros(0, U), np.zeros(0, np.int64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = out * U(BASE) + h[k : len(h) - n + 1 + k]
    ends = np.repeat(np.cumsum(counts), counts)[: len(out)]
    at = np.flatnonzero(np.arange(n, len(h) + 1) <= ends)
    return mix(out[at]), at


def shingles(h: np.ndarray, counts: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """For each text its sorted set of hashed n-word shingles; with fewer words, the whole sequence as one."""
    g, at = grams(h, counts, n)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    cut = np.searchsorted(at, bounds)
    for i, c in enumerate(counts.tolist()):
        if c >= n:
            yield np.unique(g[cut[i] : cut[i + 1]])
        elif c:
            own = h[bounds[i] : bounds[i + 1]] * powers(BASE, c)
            yield mix(own.sum(keepdims=True) ^ U(c))
        else:
            yield np.zeros(0, U)
