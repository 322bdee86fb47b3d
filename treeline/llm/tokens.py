"""Word hashes and shingles of Arrow string columns by numpy, without a Python object for each word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes worked on at once; a longer run without white space is one word and taken whole.
CHUNK = 1 << 21
_U = np.uint64
_RNG = np.random.default_rng(20240601)
_TABLE = _RNG.integers(1, 2**64, 256, dtype=_U)
_FOLDED = _TABLE.copy()
_FOLDED[65:91] = _TABLE[97:123]
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_MULTIPLIERS = _RNG.integers(1, 2**64, 64, dtype=_U) | _U(1)
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit; changes x."""
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS.clear()
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            p = np.full(n, base & (2**64 - 1), dtype=_U)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS[0], _POWERS[1]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of the rows) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _chunks(data: np.ndarray, offsets: np.ndarray):
    """Bounds of pieces of about CHUNK bytes that split no word."""
    a, n = 0, len(data)
    while a < n:
        b = min(a + CHUNK, n)
        if b < n:
            row = int(offsets[np.searchsorted(offsets, b, "right") - 1])
            if row > a:
                b = row
            else:
                white = np.flatnonzero(_WHITE[data[a:b]])
                if len(white):
                    b = a + int(white[-1]) + 1
                else:
                    end = int(offsets[np.searchsorted(offsets, b, "left")])
                    while b < end and not _WHITE[data[b]]:
                        b += 1
        yield a, b
        a = b


def word_hashes(column: pa.Array, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(a 64-bit hash of each word, offsets of the rows' words). fold: A-Z count as a-z."""
    data, offsets = buffers(column)
    table = _FOLDED if fold else _TABLE
    hashes, starts = [], []
    for a, b in _chunks(data, offsets):
        d = data[a:b]
        white = _WHITE[d]
        rows = offsets[np.searchsorted(offsets, a, "left") : np.searchsorted(offsets, b, "left")] - a
        before, after = np.empty(b - a, bool), np.empty(b - a, bool)
        before[0], before[1:] = True, white[:-1]
        before[rows] = True
        after[-1], after[:-1] = True, white[1:]
        after[rows[rows > 0] - 1] = True
        np.logical_not(white, out=white)
        s, e = np.flatnonzero(white & before), np.flatnonzero(white & after)
        up, down = _powers(max(CHUNK, b - a))
        total = np.cumsum(table[d] * up[: b - a])
        h = total[e]
        h[s > 0] -= total[s[s > 0] - 1]
        h *= down[s]
        hashes.append(mix(h))
        starts.append(s + a)
    h = np.concatenate(hashes) if hashes else np.zeros(0, _U)
    s = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return h, np.searchsorted(s, offsets, "left")


def shingle_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of h[i:i+n] for each i; as many as fit."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, _U)
    out = h[:m] * _MULTIPLIERS[0]
    for j in range(1, n):
        out += h[j : j + m] * _MULTIPLIERS[j]
    return mix(out)


def shingle_set(h: np.ndarray, n: int) -> np.ndarray:
    """Sorted hashes of the distinct n-word shingles; fewer words are one shingle as a whole, no word none."""
    if len(h) == 0:
        return h
    if len(h) < n:
        whole = (h * _MULTIPLIERS[: len(h)]).sum(keepdims=True, dtype=_U)
        return mix(whole + np.array([len(h)], dtype=_U) * _MULTIPLIERS[63])
    s = np.sort(shingle_hashes(h, n))
    return s[np.concatenate(([True], s[1:] != s[:-1]))]
