"""Words of whole batches of texts by array work on their UTF-8 bytes.

Used inside tasks: Spark hands over record batches, these functions look at a bounded slice of their
bytes at a time. Words are runs of anything but space, tab and line ends; A-Z count as lower case.
A word is known by a 64-bit hash of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_U = np.uint64
_ODD = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit integers (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_OF_BYTE = mix((np.arange(256, dtype=_U) + _U(1)) * _U(_ODD))


#: Bytes that are summed up at a time: the powers for so many are the only table, however long a text.
SPAN = 1 << 20


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """SPAN powers of an odd number modulo 2^64, and of its inverse."""
    inverse = pow(_ODD, -1, 1 << 64)
    out = []
    for base in (_ODD, inverse):
        steps = np.full(SPAN, base, _U)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


class Block:
    """Some texts: their bytes end to end, and where each one starts."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets
        self.rows = len(offsets) - 1

    def find_words(self) -> None:
        """Sets start and end of each word, and per text the number of its first word."""
        inside = ~_SPACE[self.data]
        before = np.zeros(len(inside) + 1, bool)
        before[1:] = inside
        before[self.offsets] = False
        after = np.zeros(len(inside) + 1, bool)
        after[:-1] = inside
        after[self.offsets] = False
        self.start = np.flatnonzero(inside & ~before[:-1])
        self.end = np.flatnonzero(inside & ~after[1:]) + 1
        self.word_ptr = np.searchsorted(self.start, self.offsets)

    def without_marks(self, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each word without the bytes of `edge` at its ends, however many, and whether
        there is anything else in it; a word of such bytes alone stays as it is.
        """
        inner = ~edge[self.data]
        before = np.concatenate([[0], np.cumsum(inner)])
        places = np.flatnonzero(inner)
        low, high = before[self.start], before[self.end]
        some = high > low
        start, end = self.start.copy(), self.end.copy()
        start[some] = places[low[some]]
        end[some] = places[high[some] - 1] + 1
        return start, end, some

    def hashes(self, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
        """Hashes of the byte ranges, which may not be empty."""
        if not len(start):
            return np.zeros(0, _U)
        sums = np.zeros(len(start), _U)
        if len(self.data) <= SPAN:
            sums[:] = self._sums(0, len(self.data), start, end, lower)
        else:
            # from span to span, each with the ranges that start in it and end before it does
            order = np.argsort(start, kind="stable")
            first, last = start[order], np.maximum.accumulate(end[order])
            at = 0
            while at < len(order):
                low = int(first[at])
                to = int(np.searchsorted(last, low + SPAN, "right"))
                if to <= at:  # a range longer than a span
                    sums[order[at]] = self._long_sum(low, int(end[order[at]]), lower)
                    at += 1
                    continue
                some = order[at:to]
                sums[some] = self._sums(low, int(last[to - 1]), start[some], end[some], lower)
                at = to
        return mix(sums + (end - start).astype(_U) * _U(_ODD))

    def _sums(self, low: int, high: int, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
        """Of each range the sum of its bytes' numbers, each times a power by its place in the range."""
        up, down = _powers()
        data = self.data[low:high]
        data = _LOWER[data] if lower else data
        sums = np.zeros(len(data) + 1, _U)
        np.cumsum(_OF_BYTE[data] * up[: len(data)], out=sums[1:])
        return (sums[end - low] - sums[start - low]) * down[np.minimum(start - low, SPAN - 1)]

    def _long_sum(self, low: int, high: int, lower: bool) -> int:
        total, power = 0, 1
        for at in range(low, high, SPAN):
            to = min(at + SPAN, high)
            part = self._sums(at, to, np.array([at]), np.array([to]), lower)
            total += int(part[0]) * power
            power = power * pow(_ODD, SPAN, 1 << 64) % (1 << 64)
        return total % (1 << 64)

    def texts(self, start: np.ndarray, end: np.ndarray) -> pa.Array:
        """The byte ranges as lower-case strings; they must hold whole characters."""
        size = end - start
        ends = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(ends[-1]) + np.repeat(start - ends[:-1], size)
        data = pa.py_buffer(_LOWER[self.data[at]].tobytes())
        offsets = pa.py_buffer(ends.astype(np.int32).tobytes())
        return pa.StringArray.from_buffers(len(size), offsets, data)

    def word_hashes(self, lower: bool = True) -> np.ndarray:
        self.find_words()
        return self.hashes(self.start, self.end, lower)


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The texts in slices of about `limit` bytes; a longer text is a slice of its own. NULL is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, len(texts))
        yield Block(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def shingles(words: np.ndarray, ptr: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Per text its distinct hashes of k words in a row, sorted; a shorter text is one shingle."""
    chain = np.zeros(max(0, len(words) - k + 1), _U)
    for j in range(k if len(chain) else 0):
        chain = mix(chain * _U(_ODD) + words[j : j + len(chain)] + _U(j + 1))
    for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(chain[a : b - k + 1])
        elif b > a:
            whole = np.array([b - a], _U)
            for at in range(a, b):
                whole = mix(whole * _U(_ODD) + words[at : at + 1] + _U(k + 1))
            yield whole
        else:
            yield np.zeros(0, _U)
