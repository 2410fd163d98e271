"""Signature trees over sets: nodes hold OR-combined token bitmaps and ranges of set sizes.

A set's bitmap has one bit per hashed token. If A and B share c bits, and A loses at most s_A tokens
to hash collisions (its size less its bits), they share at most c + min(s_A, s_B) tokens. A node
bounds all sets below it: the OR of their bitmaps, the range of their sizes, the largest loss. Two
trees are walked together; a pair of nodes is left as soon as no pair of sets below them can share
enough tokens, can be near enough in size, or can belong to different classes.
"""

from __future__ import annotations

import numpy as np

FANOUT = 16
_SLICE_WORDS = 1 << 18
#: Node pairs whose children are looked at together: 256 pairs of children each.
_PARENTS = 256


def fold(bitmap: np.ndarray, words: int) -> np.ndarray:
    """The bitmap narrowed to fewer 64-bit words; widths are powers of two."""
    while len(bitmap) > words:
        half = len(bitmap) // 2
        bitmap = bitmap[:half] | bitmap[half:]
    return bitmap


def bitmap(tokens: np.ndarray, words: int) -> np.ndarray:
    """One bit per token: its low 6 bits choose the bit, the next ones the word, so folding fits."""
    out = np.zeros(words, np.uint64)
    word = ((tokens >> np.uint64(6)) & np.uint64(words - 1)).astype(np.int64)
    np.bitwise_or.at(out, word, np.uint64(1) << (tokens & np.uint64(63)))
    return out


class Tree:
    def __init__(self, bitmaps: np.ndarray, sizes: np.ndarray, classes: np.ndarray):
        """Leaves in the given order: neighbours there should be alike."""
        self.bits = [bitmaps]
        loss = sizes - np.bitwise_count(bitmaps).sum(1, dtype=np.int64)
        self.size = [(sizes, sizes)]
        self.loss = [loss]
        self.of = [(classes, classes)]
        while len(self.loss[-1]) > 1:
            at = np.arange(0, len(self.loss[-1]), FANOUT)
            self.bits.append(np.bitwise_or.reduceat(self.bits[-1], at, axis=0))
            self.loss.append(np.maximum.reduceat(self.loss[-1], at))
            for ranges in (self.size, self.of):
                low, high = ranges[-1]
                ranges.append((np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))
        self.depth = len(self.loss)


def _possible(x: Tree, y: Tree, level: int, i: np.ndarray, j: np.ndarray, share: int) -> np.ndarray:
    """Mask of node pairs below which a pair with 100 * overlap >= share * union can lie."""
    (x_low, x_high), (y_low, y_high) = x.size[level], y.size[level]
    (x_from, x_to), (y_from, y_to) = x.of[level], y.of[level]
    ok = (x_high[i] * 100 >= share * y_low[j]) & (y_high[j] * 100 >= share * x_low[i])
    ok &= (x_from[i] != x_to[i]) | (y_from[j] != y_to[j]) | (x_from[i] != y_from[j])
    left = np.flatnonzero(ok)
    a, b = x.bits[level], y.bits[level]
    step = max(1, _SLICE_WORDS // a.shape[1])
    for at in range(0, len(left), step):
        some = left[at : at + step]
        p, q = i[some], j[some]
        common = np.bitwise_count(a[p] & b[q]).sum(1, dtype=np.int64)
        if level:
            most = common + np.minimum(x.loss[level][p], y.loss[level][q])
        else:
            most = common + np.minimum(x.loss[0][p], y.loss[0][q])
        most = np.minimum(most, np.minimum(x_high[p], y_high[q]))
        # overlap >= share / (100 + share) of the sum of both sizes
        ok[some] = most * (100 + share) >= share * (x_low[p] + y_low[q])
    return ok


def dual_traversal(x: Tree, y: Tree, share: int) -> tuple[np.ndarray, np.ndarray]:
    """Leaf pairs (i, j) that may be similar; for one tree with itself, those with i < j."""
    alone = x is y
    level = max(x.depth, y.depth) - 1
    for tree in (x, y):
        while tree.depth <= level:  # a lower tree gets its root again
            for held in (tree.bits, tree.size, tree.loss, tree.of):
                held.append(held[-1])
            tree.depth += 1
    i = j = np.zeros(1, np.int32)
    ok = _possible(x, y, level, i, j, share)
    i, j = i[ok], j[ok]
    while level and len(i):
        level -= 1
        # some parents at a time, so that only survivors of a level are held
        parts = [
            _children(x, y, level, i[at : at + _PARENTS], j[at : at + _PARENTS], alone, share)
            for at in range(0, len(i), _PARENTS)
        ]
        i, j = (np.concatenate(part) for part in zip(*parts, strict=True))
    return i, j


def _children(x: Tree, y: Tree, level: int, i: np.ndarray, j: np.ndarray, alone: bool, share: int):
    """Of node pairs one level up, the pairs of their children that may hold similar sets."""

    def ranges(tree: Tree, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(tree.loss[level]) == len(tree.loss[level + 1]) == 1:
            return n, n + 1
        return n * FANOUT, np.minimum((n + 1) * FANOUT, len(tree.loss[level]))

    (x_from, x_to), (y_from, y_to) = ranges(x, i), ranges(y, j)
    high = y_to - y_from
    count = (x_to - x_from) * high
    pair = np.repeat(np.arange(len(i)), count)
    inside = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)
    i = (x_from[pair] + inside // high[pair]).astype(np.int32)
    j = (y_from[pair] + inside % high[pair]).astype(np.int32)
    if alone:
        ahead = i < j if level == 0 else i <= j
        i, j = i[ahead], j[ahead]
    ok = _possible(x, y, level, i, j, share)
    return i[ok], j[ok]
