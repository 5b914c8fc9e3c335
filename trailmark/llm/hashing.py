"""Vectorised 64-bit fingerprints of words, word shingles and byte windows.

All arithmetic is modulo 2**64. A span's fingerprint is a polynomial in an odd
base, read off prefix sums of a whole buffer, then mixed. Two different spans
share one with chance 2**-64; with 10**10 spans in play that is one false match
in several hundred pairs of tables, and nothing else is approximate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)
UNBASE = U(pow(int(BASE), -1, 1 << 64))
M1, M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POWERS: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> U(30))) * M1
    x = (x ^ (x >> U(27))) * M2
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i <= n, kept between calls up to 4 MB of text."""
    if len(_POWERS[0]) <= n:
        made = []
        for base in (BASE, UNBASE):
            p = np.full(n + 1, base, U)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        if n > 1 << 22:
            return made[0], made[1]
        _POWERS[:] = made
    return _POWERS[0][: n + 1], _POWERS[1][: n + 1]


def forget() -> None:
    """Drop the powers that a long text left behind."""
    if len(_POWERS[0]) > 1 << 17:
        _POWERS[:] = [p[: 1 << 17].copy() for p in _POWERS]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    p, _ = powers(len(data))
    out = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * p[: len(data)], out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of data[start:end]."""
    _, back = powers(len(sums) - 1)
    return mix((sums[end] - sums[start]) * back[start])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow column as one UTF-8 buffer, and where each begins (and the end)."""
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, 8 * column.offset)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:
        valid = np.asarray(column.is_valid())
        sizes = np.where(valid, np.diff(at), 0)
        keep = [whole[a : a + s] for a, s in zip(at[:-1], sizes)]
        return np.concatenate(keep), np.concatenate([[0], np.cumsum(sizes)])
    return whole[at[0] : at[-1]], at - at[0]


def salt(i: int) -> np.uint64:
    return U(i * int(M1) & (1 << 64) - 1)


def shingles(column: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct fingerprints of each text's k-word shingles; fewer words are one shingle."""
    data, at = text_bytes(column)
    n = len(at) - 1
    if not len(data):
        return [np.zeros(0, U)] * n
    data = LOWER[data]
    word = ~SPACE[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    edge = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))]  # a word ends where its text does
    begins[edge] |= word[edge]
    ends[edge - 1] |= word[edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    h = spans(prefix_sums(data), start, end)
    owner = np.searchsorted(start, at)  # words of text i: owner[i]:owner[i + 1]
    rolled = np.zeros(len(h), U)
    for i in range(min(k, len(h))):
        rolled[: len(h) - i] += mix(h[i:] + salt(i + 1))
    rolled = mix(rolled + U(k))
    out = []
    for a, z in zip(owner[:-1], owner[1:]):
        if z - a >= k:
            out.append(np.unique(rolled[a : z - k + 1]))
        elif z > a:
            part = np.sum(mix(h[a:z] + np.arange(1, z - a + 1, dtype=U) * M1), keepdims=True, dtype=U)
            out.append(mix(part + U(z - a)))
        else:
            out.append(np.zeros(0, U))
    return out
