"""Hashes of words and shingles over many texts at once, by whole-array arithmetic."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E6C63D0876A9A47)
_MIX_A = np.uint64(0xFF51AFD7ED558CCD)
_MIX_B = np.uint64(0xC4CEB9FE1A85EC53)


def word_bytes(lower: bool = True) -> np.ndarray:
    """Byte -> byte, A-Z lowered if asked for, and 0 for the characters that part words (space, 0x09-0x0D).

    Bytes are shifted up by one so that NUL is a character of words like any other."""
    t = np.arange(1, 257, dtype=np.uint16)
    if lower:
        t[65:91] += 32
    t[[0x20, *range(0x09, 0x0E)]] = 0
    return t


def scramble(h: np.ndarray) -> np.ndarray:
    """Finishing steps of a 64-bit mixer: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX_A
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX_B
    return h ^ (h >> np.uint64(33))


def word_hashes(texts: list[bytes], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, index of its text), in order. Polynomial over the word's bytes, then mixed."""
    joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    b = table[joined]
    inside = np.concatenate(([False], b != 0, [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    length = ends - starts
    powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(int(length.max()), _BASE))), dtype=np.uint64)
    chars = np.flatnonzero(b)
    first = np.cumsum(length) - length
    at = np.arange(len(chars)) - np.repeat(first, length)
    h = np.add.reduceat(b[chars].astype(np.uint64) * powers[at], first)
    stops = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    return scramble(h + length.astype(np.uint64) * _MIX_B), np.searchsorted(stops, starts, side="right")


def shingle_sets(texts: list[bytes], k: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of its text) of each text's distinct k-word shingles, sorted by text, then hash.

    A text of fewer words has its whole sequence as one; one without words has none."""
    w, of = word_hashes(texts, table)
    salts = scramble(np.arange(1, k + 2, dtype=np.uint64))
    hs, ts = [], []
    if len(w) >= k:
        full = np.flatnonzero(of[: len(w) - k + 1] == of[k - 1 :])
        h = np.zeros(len(w) - k + 1, np.uint64)
        for i in range(k):  # each step mixes, so order matters
            h = scramble(h ^ (w[i : len(w) - k + 1 + i] + salts[i]))
        hs.append(h[full])
        ts.append(of[full])
    n = np.bincount(of, minlength=len(texts))
    for t in np.flatnonzero((n > 0) & (n < k)):
        h = np.zeros(1, np.uint64)
        lo = int(np.searchsorted(of, t))
        for i in range(n[t]):
            h = scramble(h ^ (w[lo + i : lo + i + 1] + salts[i]))
        hs.append(scramble(h ^ (salts[k] + np.uint64(n[t]))))
        ts.append(np.array([t]))
    if not hs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, t = np.concatenate(hs), np.concatenate(ts)
    order = np.lexsort((h, t))
    h, t = h[order], t[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (t[1:] != t[:-1])))
    return h[new], t[new]


SLICE = 1_500_000


def slices(sizes: Sequence[int], size: int = SLICE, most: int = 60_000) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about ``size`` bytes together; one long text is a run of its own."""
    lo = 0
    while lo < len(sizes):
        hi, n = lo, 0
        while hi < len(sizes) and hi - lo < most and (hi == lo or n + sizes[hi] <= size):
            n += sizes[hi]
            hi += 1
        yield lo, hi
        lo = hi


def byte_slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, list[bytes]]]:
    """(from, to, UTF-8 texts) over a string column, null as empty: only one slice is ever outside Arrow's memory."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for lo, hi in slices(sizes, size):
        yield lo, hi, [t or b"" for t in column.slice(lo, hi - lo).cast(pa.binary()).to_pylist()]


def series_slices(texts: pd.Series, size: int = SLICE) -> Iterator[list[bytes]]:
    """The same over a pandas series of strings."""
    sizes = [len(t) for t in texts]
    for lo, hi in slices(sizes, size):
        yield [t.encode() for t in texts.iloc[lo:hi]]
