"""Benchmark passages in documents: CGK embedding, bit-sampling LSH, exact edit verification.

The CGK embedding walks over a sequence: it puts out the word it stands on and moves on by a random
bit that depends on the step and the word. Two sequences at a small edit distance fall into step
again after an edit, so their walks agree in most places: edit distance becomes Hamming distance.
Sampled places of a walk form a key; REPEATS walks with places of their own make it likely that
similar sequences share a key.

Windows start at every STRIDE-th word of a document, and an item has a window at each phase of that
stride, at every SEGMENT words, so that a passage meets one of them wherever it stands and wherever
it was edited. An item of fewer than LONG words has too few windows for that: it is cut into one
piece more than it may have edits, of which one is left whole by any allowed edits, and pieces are
looked up at every word of a document. So no passage of such an item is missed; of longer ones,
RECALL at least are found at the most edits allowed. Windows and pieces that share a key with an item
are compared with it exactly: the edit distance of the item's words to the best matching run of words
of the document.

A character of a script that is written without spaces is a word.

Benchmarks are held by every task in groups of bounded size; documents are read once per group.
Texts are never shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.tables import in_small_batches
from ledgerlake.llm.words import Block, blocks, mix

#: Edits allowed, as a share of an item's words.
EDITS = 0.2
#: Words from which on items are found by walks, and the share of their passages to be found.
LONG = 40
RECALL = 0.99
STRIDE = 4
SEGMENT = 8
#: Walks, their steps, and places sampled of each.
REPEATS = 10
STEPS = 16
SAMPLES = 4
#: Characters of benchmark items held by a task at a time.
GROUP_CHARS = 4_000_000

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
_EDGE = np.zeros(256, bool)
_EDGE[[b for b in range(128) if not chr(b).isalnum()]] = True
#: Lead bytes of characters, and of them with the byte that follows, of scripts without spaces.
_ALONE = np.zeros(256, bool)
_ALONE[0xE3:0xEA] = True
_ALONE_PAIR = np.zeros(1 << 16, bool)
for _lead, _low, _high in ((0xE0, 0xB8, 0xBB), (0xE1, 0x80, 0x82), (0xE1, 0x9E, 0x9F), (0xF0, 0xA0, 0xBF)):
    _ALONE_PAIR[(_lead << 8) + _low : (_lead << 8) + _high + 1] = True
_TABLE = 1 << 20
_SIDE_BY_SIDE = 1 << 15


def _split(block: Block) -> None:
    """Makes a word of each character of a script without spaces, and of what stands between them."""
    data, start, end = block.data, block.start, block.end
    pair = data[:-1].astype(np.int64) << 8 | data[1:]
    at = np.flatnonzero(np.append(_ALONE[data[:-1]] | _ALONE_PAIR[pair], False)) if len(data) else start[:0]
    if not len(at):
        return
    size = np.where(data[at] == 0xF0, 4, 3)
    cuts = np.unique(np.concatenate([at, at + size]))
    inside = np.searchsorted(start, cuts, "right") - 1
    cuts = cuts[(cuts > start[inside]) & (cuts < end[inside])]
    block.start = np.sort(np.concatenate([start, cuts]))
    block.end = np.sort(np.concatenate([end, cuts]))
    block.word_ptr = np.searchsorted(block.start, block.offsets)


def _words(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words without marks at their ends, and per text the number of its first word.

    Words of marks alone are left out.
    """
    block.find_words()
    _split(block)
    start, end, some = block.without_marks(_EDGE)
    ptr = np.concatenate([[0], np.cumsum(some)])[block.word_ptr]
    return block.hashes(start[some], end[some]), ptr


def _places() -> np.ndarray:
    """Sampled steps of each walk, one from each third of it, by rule."""
    r, k = np.arange(REPEATS)[:, None], np.arange(SAMPLES)[None, :]
    low, high = k * STEPS // SAMPLES, (k + 1) * STEPS // SAMPLES
    h = mix((r * SAMPLES + k + 1).astype(_U) * _ODD)
    return low + (h % (high - low).astype(_U)).astype(np.int64)


def keys(words: np.ndarray, start: np.ndarray, end: np.ndarray, repeat: int) -> np.ndarray:
    """Keys of the walk number `repeat` over the windows words[start:end]; beyond the end is nothing."""
    turns = mix(words + np.array([repeat + 1], _U) * _ODD)
    padded, turns = np.append(words, _U(0)), np.append(turns, _U(0))
    places = _places()[repeat]
    out = np.full(len(start), repeat + 1, _U)
    for low in range(0, len(start), _SIDE_BY_SIDE):
        some = slice(low, low + _SIDE_BY_SIDE)
        at, stop = start[some].copy(), end[some]
        key = out[some]
        for t in range(int(places.max()) + 1):
            here = np.where(at < stop, at, len(words))
            if t in places:
                key *= _ODD
                key += padded[here]
            at += ((turns[here] >> _U(t)) & _U(1)).astype(np.int64)
        out[some] = mix(key)
    return out


def piece_keys(words: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """Keys of the pieces of `size` words from each start."""
    out = np.full(len(start), size, _U)
    for k in range(size):
        out = mix(out * _ODD + words[start + k])
    return out


def pieces_of(size: int) -> np.ndarray:
    """Where the pieces of an item begin, and its end: one piece more than it may have edits."""
    return np.arange(int(EDITS * size) + 2) * size // (int(EDITS * size) + 1)


class Keys:
    """Keys of windows or pieces of items, with the items and where in them these stand."""

    def __init__(self, of: np.ndarray, item: np.ndarray, phase: np.ndarray):
        order = np.argsort(of, kind="stable")
        self.keys, self.item, self.phase = of[order], item[order], phase[order]
        self.likely = np.zeros(_TABLE, bool)
        self.likely[(of & _U(_TABLE - 1)).astype(np.int64)] = True

    def meet(self, of: np.ndarray, row: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Rows (text, item, word where the item would start) of the keys `of` at `start`."""
        some = np.flatnonzero(self.likely[(of & _U(_TABLE - 1)).astype(np.int64)])
        low = np.searchsorted(self.keys, of[some], "left")
        many = np.searchsorted(self.keys, of[some], "right") - low
        at = np.repeat(np.arange(len(some)), many)
        entry = low[at] + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
        window = some[at]
        return np.stack([row[window], self.item[entry], start[window] - self.phase[entry]], 1)


class Items:
    """A group of benchmark items with the keys of their windows, or of their pieces."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        self.ids, self.words = [], []
        for block in blocks(pa.array(texts, pa.string())):
            words, ptr = _words(block)
            for k in range(block.rows):
                line = words[ptr[k] : ptr[k + 1]]
                if len(line) and ids[block.first + k] is not None:
                    self.ids.append(ids[block.first + k])
                    self.words.append(line)
        size = np.array([len(x) for x in self.words], np.int64)
        ends = np.cumsum(size)
        flat = np.concatenate([np.zeros(0, _U), *self.words])
        windows, parts = [], {}
        for k, line in enumerate(self.words):
            if len(line) >= LONG:
                windows += [(k, at + p) for at in range(0, len(line) - SEGMENT + 1, SEGMENT) for p in range(STRIDE)]
            else:
                cuts = pieces_of(len(line)).tolist()
                for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                    parts.setdefault(high - low, []).append((k, low))
        item, phase = np.array(windows, np.int64).reshape(-1, 2).T
        start = (ends - size)[item] + phase if len(item) else item
        end = ends[item] if len(item) else item
        self.walks = [
            Keys(keys(flat, start, end, repeat), item, phase) for repeat in range(REPEATS if len(item) else 0)
        ]
        self.pieces = {}
        for n, places in sorted(parts.items()):
            item, phase = np.array(places, np.int64).T
            self.pieces[n] = Keys(piece_keys(flat, (ends - size)[item] + phase, n), item, phase)

    def _candidates(self, words: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        """Rows (text, item, word where the item would start), distinct."""
        size = np.diff(ptr)
        found = [np.zeros((0, 3), np.int64)]
        count = (size + STRIDE - 1) // STRIDE
        row = np.repeat(np.arange(len(size)), count)
        start = ptr[row] + (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
        end = ptr[row + 1]
        for repeat, held in enumerate(self.walks):
            found.append(held.meet(keys(words, start, end, repeat), row, start))
        for n, held in self.pieces.items():
            count = np.maximum(size - n + 1, 0)
            row = np.repeat(np.arange(len(size)), count)
            start = ptr[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            found.append(held.meet(piece_keys(words, start, n), row, start))
        return np.unique(np.concatenate(found), axis=0)

    def search(self, texts: pa.Array) -> list[tuple[int, int, int, int, int, int]]:
        """(text, item id, edits, words of the item, first word, end) of every passage found.

        Of several runs of words at one item in one text the nearest counts, then the first.
        """
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        if not self.words:
            return []
        for block in blocks(texts):
            words, ptr = _words(block)
            candidates = self._candidates(words, ptr)
            candidates = candidates[np.argsort(candidates[:, 1], kind="stable")]
            for some in np.split(candidates, np.flatnonzero(np.diff(candidates[:, 1])) + 1):
                if not len(some):
                    continue
                k = int(some[0, 1])
                line = self.words[k]
                slack = int(EDITS * len(line)) + STRIDE
                for low in range(0, len(some), 2048):
                    part = some[low : low + 2048]
                    first = np.maximum(part[:, 2] - slack, ptr[part[:, 0]])
                    near = holds(line, words, first, ptr[part[:, 0] + 1], len(line) + 2 * slack)
                    part, first = part[near], first[near]
                    if not len(part):
                        continue
                    edits, start, end = nearest(line, words, first, ptr[part[:, 0] + 1], len(line) + 2 * slack)
                    for j in np.flatnonzero(edits <= EDITS * len(line)).tolist():
                        row = int(part[j, 0])
                        base = int(ptr[row])
                        this = (int(edits[j]), int(start[j]) - base, int(end[j]) - base)
                        at = (block.first + row, k)
                        best[at] = min(best.get(at, this), this)
        return [(row, self.ids[k], e, len(self.words[k]), a, b) for (row, k), (e, a, b) in sorted(best.items())]


def holds(line: np.ndarray, words: np.ndarray, first: np.ndarray, stop: np.ndarray, wide: int) -> np.ndarray:
    """Whether windows hold enough distinct words of `line`: an edit takes away one at most."""
    distinct = np.unique(line)
    at = first[:, None] + np.arange(wide)
    text = words[np.minimum(at, len(words) - 1)]
    of = np.minimum(np.searchsorted(distinct, text), len(distinct) - 1)
    row, column = np.nonzero((distinct[of] == text) & (at < stop[:, None]))
    seen = np.zeros((len(first), len(distinct)), bool)
    seen[row, of[row, column]] = True
    return len(distinct) - seen.sum(1) <= EDITS * len(line)


def nearest(
    line: np.ndarray, words: np.ndarray, first: np.ndarray, stop: np.ndarray, wide: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fewest edits between `line` and a run of words within `wide` words from `first`, and the run.

    Columns of the usual table are worked through for all windows together; a run may start and end
    anywhere in its window.
    """
    at = first[:, None] + np.arange(wide)
    inside = at < stop[:, None]
    text = words[np.where(inside, at, 0)]
    steps = np.arange(wide + 1)
    edits = np.zeros((len(first), wide + 1), np.int64)
    begin = np.tile(steps, (len(first), 1))
    for w in line:
        change = edits[:, :-1] + ~((text == w) & inside)
        drop = edits[:, 1:] + 1
        now = np.empty_like(edits)
        now[:, 0] = edits[:, 0] + 1
        now[:, 1:] = np.minimum(change, drop)
        start = begin.copy()
        start[:, 1:] = np.where(change <= drop, begin[:, :-1], begin[:, 1:])
        # an extra word of the text costs one: the least of what stands before, by distance
        level = now - steps
        least = np.minimum.accumulate(level, 1)
        source = np.maximum.accumulate(np.where(level == least, steps, 0), 1)
        edits, begin = least + steps, np.take_along_axis(start, source, 1)
    # beyond the end of the text there is no run
    over = steps > (stop - first)[:, None]
    edits = np.where(over, len(line) + 1, edits)
    end = edits.argmin(1)
    rows = np.arange(len(first))
    return edits[rows, end], first + begin[rows, end], first + end


def _groups(benchmark: DataFrame):
    """Groups of items, each of about GROUP_CHARS characters, one at a time."""
    in_small_batches(benchmark.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(
        F.col("item_id").isNotNull() & F.col("text").isNotNull()
    )
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    groups = chars // GROUP_CHARS + 1
    for k in range(groups):
        rows = (
            items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == k)
            .distinct()
            .orderBy("item_id", "text")
            .toPandas()
        )
        yield Items(rows["item_id"].tolist(), rows["text"].tolist())


def _search(df: DataFrame, items: Items) -> DataFrame:
    def search(batches):
        for batch in batches:
            found = items.search(batch["text"])
            columns = list(zip(*found, strict=True)) or [[]] * 6
            ids = batch["doc_id"].take(pa.array(columns[0], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, *(pa.array(c, pa.int64()) for c in columns[1:])],
                names=["doc_id", "item_id", "edits", "item_words", "first_word", "end_word"],
            )

    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        search,
        "doc_id long, item_id long, edits long, item_words long, first_word long, end_word long",
    )


def passages(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, edits, item_words, first_word, end_word: the items found in each document.

    Words are counted without those of marks alone; end_word is exclusive. A document has one row per
    item, for the run of words with the fewest edits. NULL and empty texts hold nothing, and so do
    items that are NULL or have no word. An item of fewer than 5 words must stand as it is. Repeated documents have rows each, items
    that repeat an item_id with another text are searched each. Empty tables give an empty result.
    """
    found = None
    for items in _groups(benchmark):
        rows = _search(df, items)
        found = rows if found is None else found.unionByName(rows)
    return found


def clean(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of df without a benchmark passage, with all columns."""
    for items in _groups(benchmark):

        def keep(batches, items=items):
            for batch in batches:
                held = np.ones(batch.num_rows, bool)
                held[[row for row, *_ in items.search(batch["text"])]] = False
                yield batch.filter(pa.array(held))

        df = df.mapInArrow(keep, df.schema)
    return df
