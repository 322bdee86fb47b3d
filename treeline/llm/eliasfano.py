"""Elias-Fano sequences over numpy arrays, with vectorised access and successor search, and files of arrays to be memory-mapped."""

from __future__ import annotations

import json

import numpy as np

_U = np.uint64
#: A place is kept for every SAMPLE-th one and zero of the high bits.
SAMPLE = 16
#: Numbers looked up at once: what a step works on should stay in the cache.
STEP = 1 << 15
_ALL = _U(0xFFFFFFFFFFFFFFFF)


def _select_table() -> np.ndarray:
    """The place of the k-th set bit of a byte, at 8 * byte + k."""
    out = np.zeros(2048, dtype=np.uint8)
    for byte in range(256):
        for k, place in enumerate(i for i in range(8) if byte >> i & 1):
            out[8 * byte + k] = place
    return out


_IN_BYTE = _select_table()
_ONES, _HIGHS = _U(0x0101010101010101), _U(0x8080808080808080)


def _select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of the k-th (from 0) set bit of each word, which has that many."""
    counts = word - (word >> _U(1) & _U(0x5555555555555555))
    counts = (counts & _U(0x3333333333333333)) + (counts >> _U(2) & _U(0x3333333333333333))
    counts = ((counts + (counts >> _U(4))) & _U(0x0F0F0F0F0F0F0F0F)) * _ONES  # bits up to each byte, it included
    k = k.astype(_U)
    # bytes whose count is not over k come before the one that holds the bit
    before = np.bitwise_count((k * _ONES | _HIGHS) - counts & _HIGHS).astype(_U) << _U(3)
    rest = k - ((counts << _U(8)) >> before & _U(255))
    return (before + _IN_BYTE[(word >> before & _U(255)) * _U(8) + rest]).astype(np.int64)


class EliasFano:
    """A non-decreasing sequence of numbers below 2**63: low bits apart, high bits in unary."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.n, self.low_bits = (int(x) for x in arrays["shape"])
        self.high, self.ones, self.zeros = arrays["high"], arrays["ones"], arrays["zeros"]
        self.bytes, self.nibbles = arrays["bytes"], arrays["nibbles"]

    @staticmethod
    def build(values: np.ndarray) -> dict[str, np.ndarray]:
        v = values.astype(_U)
        n = len(v)
        width = max(0, (int(v[-1]) // n).bit_length() - 1) if n else 0
        width = (width + 2) // 4 * 4  # whole nibbles
        high = (v >> _U(width)).astype(np.int64)
        bits = np.zeros((n + (int(high[-1]) if n else 0) + 2 + 63) // 64 * 64, dtype=bool)
        bits[high + np.arange(n)] = True
        place = np.uint32 if len(bits) < 2**32 else np.int64
        whole, rest = divmod(width, 8)
        parts = np.empty((n, whole), dtype=np.uint8)
        for j in range(whole):
            parts[:, j] = (v >> _U(8 * j) & _U(255)).astype(np.uint8)
        nibble = (v >> _U(8 * whole) & _U(15)).astype(np.uint8) if rest else np.zeros(0, np.uint8)
        nibble = np.append(nibble, np.zeros(len(nibble) % 2, np.uint8)).reshape(-1, 2)
        return {
            "shape": np.array([n, width]), "high": np.packbits(bits, bitorder="little").view(_U), "ones": np.flatnonzero(bits)[::SAMPLE].astype(place),
            "zeros": np.flatnonzero(~bits)[::SAMPLE].astype(place), "bytes": parts, "nibbles": nibble[:, 0] | nibble[:, 1] << 4,
        }

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """The place of the k-th (from 0) one or zero of the high bits."""
        flip = _U(0) if ones else _ALL
        at = (self.ones if ones else self.zeros)[k // SAMPLE].astype(np.int64)
        left = k % SAMPLE
        word = at >> 6
        bits = (self.high[word] ^ flip) & (_ALL << (at & 63).astype(_U))
        have = np.bitwise_count(bits)
        short = np.flatnonzero(have <= left)
        while len(short):
            rest = left[short] - have[short]
            here = word[short] + 1
            more = self.high[here] ^ flip
            held = np.bitwise_count(more)
            left[short], word[short], bits[short] = rest, here, more
            have[short] = held
            short = short[held <= rest]
        return (word << 6) + _select_in_word(bits, left)

    def _next(self, place: np.ndarray, ones: bool) -> np.ndarray:
        """The place of the first one or zero of the high bits after each place; there is one."""
        flip = _U(0) if ones else _ALL
        place = place + 1
        word = place >> 6
        bits = (self.high[word] ^ flip) & (_ALL << (place & 63).astype(_U))
        empty = np.flatnonzero(bits == 0)
        while len(empty):
            word[empty] += 1
            bits[empty] = self.high[word[empty]] ^ flip
            empty = empty[bits[empty] == 0]
        return (word << 6) + np.bitwise_count((bits & (~bits + _U(1))) - _U(1))

    def _low(self, i: np.ndarray) -> np.ndarray:
        whole = self.low_bits // 8
        out = np.zeros(len(i), dtype=_U)
        if whole:
            parts = self.bytes[i]
            for j in range(whole):
                out |= parts[:, j].astype(_U) << _U(8 * j)
        if self.low_bits % 8:
            out |= (self.nibbles[i >> 1] >> ((i & 1) * 4).astype(np.uint8) & np.uint8(15)).astype(_U) << _U(8 * whole)
        return out

    def access(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        return (self._select(i, True) - i).astype(_U) << _U(self.low_bits) | self._low(i)

    def access_two(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The i-th values and those behind them, which exist."""
        place = self._select(i, True)
        after = self._next(place, True)
        low = _U(self.low_bits)
        return (place - i).astype(_U) << low | self._low(i), (after - i - 1).astype(_U) << low | self._low(i + 1)

    def find(self, x: np.ndarray) -> np.ndarray:
        """The index of each x (of its successor, if that is equal), or -1. Fastest where x is in order."""
        out = np.full(len(x), -1, dtype=np.int64)
        if not self.n or not len(x):
            return out
        top = self.access(np.array([self.n - 1]))[0]
        for i in range(0, len(x), STEP):
            inside = np.flatnonzero(x[i : i + STEP] <= top)
            out[i + inside] = self._find(x[i + inside])
        return out

    def _find(self, x: np.ndarray) -> np.ndarray:
        high = (x >> _U(self.low_bits)).astype(np.int64)
        zero = self._select(np.maximum(high - 1, 0), False)
        zero[high == 0] = -1
        # the bucket's ones are those up to the next zero
        a, end = zero + 1 - high, self._next(zero, False) - high
        low = x & _U((1 << self.low_bits) - 1)
        b = end.copy()
        todo = np.flatnonzero(a < b)
        while len(todo):
            left, right, wanted = a[todo], b[todo], low[todo]
            while len(todo):
                mid = (left + right) >> 1
                less = self._low(mid) < wanted
                left, right = np.where(less, mid + 1, left), np.where(less, right, mid)
                more = left < right
                if more.all():
                    continue
                done = ~more
                a[todo[done]] = left[done]
                todo, left, right, wanted = todo[more], left[more], right[more], wanted[more]
        hit = np.flatnonzero(a < end)
        hit = hit[self._low(a[hit]) == low[hit]]
        out = np.full(len(x), -1, dtype=np.int64)
        out[hit] = a[hit]
        return out


def bundle(arrays: dict[str, np.ndarray]):
    """The bytes of named arrays, for load()."""
    head, at, parts = {}, 0, []
    for name, x in arrays.items():
        x = np.ascontiguousarray(x)
        head[name] = [x.dtype.str, list(x.shape), at]
        parts += [x.tobytes(), b"\0" * (-x.nbytes % 64)]
        at += x.nbytes + -x.nbytes % 64
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 64)
    return [len(text).to_bytes(8, "little") + text, *parts]


def load(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped."""
    raw = np.memmap(path, dtype=np.uint8, mode="r")
    n = int.from_bytes(raw[:8].tobytes(), "little")
    head = json.loads(raw[8 : 8 + n].tobytes())
    out = {}
    for name, (kind, shape, at) in head.items():
        size = int(np.prod(shape)) * np.dtype(kind).itemsize
        out[name] = np.asarray(raw[8 + n + at : 8 + n + at + size]).view(kind).reshape(shape)
    return out


def within(arrays: dict[str, np.ndarray], name: str) -> EliasFano:
    """The sequence whose arrays were bundled under name."""
    return EliasFano({k.removeprefix(f"{name}."): v for k, v in arrays.items() if k.startswith(f"{name}.")})


def under(name: str, arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {f"{name}.{k}": v for k, v in arrays.items()}
