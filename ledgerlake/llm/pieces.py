"""SentencePiece encoding and decoding: Aho-Corasick automaton over pieces, single-pass Viterbi.

The automaton is built from the pieces and scores of a model file. A text is read once; at every
position the automaton's state and its output links give all pieces that end there, longest first,
and each relaxes the best score of that position. Of equal scores the longer piece stays. A
character that is no piece of its own can be an unknown one, which is written as its bytes.

A piece has spaces at its start only, so a text falls apart into units, each of spaces and what
follows up to the next space, without changing the best path. The distinct units of a slice of texts
are worked through side by side, as arrays; single long units go through the same automaton one
character at a time.

Scores are taken from the file as they are. Those of a file whose pieces were found by merging are
ranks, and the best path is the one with the best sum of them, not the sequence of merges.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType

from ledgerlake.llm.tables import in_small_batches
from ledgerlake.llm.words import Block, blocks

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Units longer than this are read one character at a time.
LONG = 40
#: Distinct units worked through side by side.
SIDE_BY_SIDE = 1 << 15
#: Bytes looked at together: the more, the more units repeat. Rows encoded and decoded together.
BLOCK_BYTES = 1 << 21
ROWS = 512
_SPACE = "▁"
_NONE = -np.inf


class Automaton:
    """States of all piece prefixes; state 0 is the root."""

    def __init__(self, pieces: list[tuple[str, int, float]], byte_ids: list[int]):
        """pieces: text (spaces as spaces), id, score."""
        chars = sorted({c for text, _, _ in pieces for c in text})
        self.chars = np.array([ord(c) for c in chars], np.int64)
        number = {c: k + 1 for k, c in enumerate(chars)}
        self.width = len(chars) + 1
        goto: list[dict[int, int]] = [{}]
        depth, piece, score = [0], [-1], [0.0]
        for text, of, value in pieces:
            state = 0
            for c in text:
                after = goto[state].get(number[c])
                if after is None:
                    after = goto[state][number[c]] = len(goto)
                    goto.append({})
                    depth.append(depth[state] + 1)
                    piece.append(-1)
                    score.append(0.0)
                state = after
            piece[state], score[state] = of, value
        fail, link = [0] * len(goto), [0] * len(goto)
        queue = deque(goto[0].values())
        while queue:
            state = queue.popleft()
            link[state] = fail[state] if piece[fail[state]] >= 0 else link[fail[state]]
            for c, after in goto[state].items():
                back = fail[state]
                while back and c not in goto[back]:
                    back = fail[back]
                fail[after] = goto[back].get(c, 0)
                if fail[after] == after:
                    fail[after] = 0
                queue.append(after)
        edges = sorted((s * self.width + c, t) for s, out in enumerate(goto) for c, t in out.items())
        self.edge = np.array([k for k, _ in edges], np.int64)
        self.target = np.array([t for _, t in edges], np.int64)
        self.fail, self.link = np.array(fail), np.array(link)
        self.depth, self.piece, self.score = np.array(depth), np.array(piece), np.array(score)
        self.single = np.zeros(self.width, bool)
        for text, _, _ in pieces:
            if len(text) == 1:
                self.single[number[text]] = True
        self.unknown = min((v for _, _, v in pieces), default=0.0) - 10
        self.byte_ids = np.array(byte_ids, np.int64)
        #: whether pieces have spaces at their start only
        self.splits = all(" " not in text.lstrip(" ") for text, _, _ in pieces)
        known = set(chars)
        self.stops = np.array([chr(b) not in known for b in range(128)] + [False] * 128)

    def classes(self, points: np.ndarray) -> np.ndarray:
        """Numbers of characters, 0 for those in no piece."""
        at = np.minimum(np.searchsorted(self.chars, points), len(self.chars) - 1)
        return np.where(self.chars[at] == points, at + 1, 0)

    def _step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        state = np.where(c == 0, 0, state)
        left = np.flatnonzero(c)
        while len(left):
            key = state[left] * self.width + c[left]
            at = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            hit = self.edge[at] == key
            state[left[hit]] = self.target[at[hit]]
            left = left[~hit]
            left = left[state[left] > 0]
            state[left] = self.fail[state[left]]
            # at the root a missing edge stays at the root
            if len(left) and not state[left].any():
                key = c[left]
                at = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
                state[left] = np.where(self.edge[at] == key, self.target[at], 0)
                break
        return state

    def many(self, c: np.ndarray, points: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best paths of units of falling size, given as lines of character numbers.

        Returns ids end to end and how many each unit has; an unknown character is -1 - its code.
        """
        n, wide = c.shape
        best = np.full((n, wide + 1), _NONE)
        best[:, 0] = 0
        back = np.ones((n, wide + 1), np.int64)
        taken = np.zeros((n, wide + 1), np.int64)
        state = np.zeros(n, np.int64)
        for p in range(wide):
            m = int(np.searchsorted(-size, -p))  # units longer than p
            rows = np.arange(m)
            state[:m] = self._step(state[:m], c[:m, p])
            at = np.where(self.piece[state[:m]] >= 0, state[:m], self.link[state[:m]])
            some = rows
            while True:
                some = some[at[some] > 0]
                if not len(some):
                    break
                s = at[some]
                score = best[some, p + 1 - self.depth[s]] + self.score[s]
                up = score > best[some, p + 1]
                better, s_up = some[up], s[up]
                best[better, p + 1] = score[up]
                back[better, p + 1] = self.depth[s_up]
                taken[better, p + 1] = self.piece[s_up]
                at[some] = self.link[s]
            alone = np.flatnonzero(~self.single[c[:m, p]])
            score = best[alone, p] + self.unknown
            up = alone[score > best[alone, p + 1]]
            best[up, p + 1] = best[up, p] + self.unknown
            back[up, p + 1] = 1
            taken[up, p + 1] = -1 - points[up, p]
        path = np.zeros((n, wide), np.int64)
        count, pos = np.zeros(n, np.int64), size.copy()
        left = np.flatnonzero(pos)
        while len(left):
            count[left] += 1
            path[left, wide - count[left]] = taken[left, pos[left]]
            pos[left] -= back[left, pos[left]]
            left = left[pos[left] > 0]
        keep = np.arange(wide) >= wide - count[:, None]
        return path[keep], count

    def one(self, c: list[int], points: list[int]) -> list[int]:
        """The best path of a single unit."""
        if not hasattr(self, "_next"):
            self._next = dict(zip(self.edge.tolist(), self.target.tolist(), strict=True))
            self._lists = [x.tolist() for x in (self.fail, self.link, self.depth, self.piece, self.score)]
        fail, link, depth, piece, value = self._lists
        best, back, taken = [0.0], [0], [0]
        state = 0
        for p, k in enumerate(c):
            while True:
                after = self._next.get(state * self.width + k) if k else None
                if after is not None or not state:
                    break
                state = fail[state]
            state = after or 0
            top, length, of = _NONE, 1, 0
            at = state if piece[state] >= 0 else link[state]
            while at:
                score = best[p + 1 - depth[at]] + value[at]
                if score > top:
                    top, length, of = score, depth[at], piece[at]
                at = link[at]
            if not self.single[k] and best[p] + self.unknown > top:
                top, length, of = best[p] + self.unknown, 1, -1 - points[p]
            best.append(top)
            back.append(length)
            taken.append(of)
        out, pos = [], len(c)
        while pos:
            out.append(taken[pos])
            pos -= back[pos]
        return out[::-1]

    def written(self, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unknown characters replaced by the ids of their bytes."""
        unknown = np.flatnonzero(ids < 0)
        if not len(unknown):
            return ids, count
        raw = [chr(-1 - x).encode("utf-8", "replace") for x in ids[unknown].tolist()]
        size = np.ones(len(ids), np.int64)
        size[unknown] = [len(x) for x in raw]
        out = np.repeat(ids, size)
        out[np.repeat(ids < 0, size)] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        of = np.repeat(np.arange(len(count)), count)
        return out, np.bincount(of, size, minlength=len(count)).astype(np.int64)


def load(model_file: str = MODEL) -> tuple[Automaton, list[bytes]]:
    """The automaton, and the bytes that each id stands for. Reads the file on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces, stands, byte_ids = [], [], [0] * 256
    for k in range(model.get_piece_size()):
        text = model.id_to_piece(k)
        if model.is_byte(k):
            byte_ids[int(text[3:5], 16)] = k
            stands.append(bytes([int(text[3:5], 16)]))
        elif model.is_control(k) or model.is_unused(k):
            stands.append(b"")
        elif model.is_unknown(k):
            stands.append(" ⁇ ".encode())
        else:
            pieces.append((text.replace(_SPACE, " "), k, float(model.get_score(k))))
            stands.append(text.replace(_SPACE, " ").encode())
    return Automaton(pieces, byte_ids), stands


def _units(block: Block, automaton: Automaton) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each unit, and per text the number of its first unit."""
    data = block.data
    first = np.zeros(len(data) + 1, bool)
    if automaton.splits and len(data):
        space = data == 0x20
        first[1:-1] = space[1:] & ~space[:-1]
        # a character of no piece is a unit of its own
        stop = automaton.stops[data]
        first[:-1] |= stop
        first[1:] |= stop
    first[block.offsets] = True
    first[-1] = False
    start = np.flatnonzero(first)
    return start, np.searchsorted(start, block.offsets)


def _paths(texts: list[str], automaton: Automaton) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of many distinct units end to end; per unit where its ids begin and how many they are."""
    size = np.array([len(x) for x in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    numbers = automaton.classes(points)
    at = np.concatenate([[0], np.cumsum(size)])
    ids, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    order = np.argsort(-size, kind="stable")
    long = int(np.searchsorted(-size[order], -LONG))
    for k in order[:long].tolist():
        a, b = at[k], at[k + 1]
        ids.append(np.array(automaton.one(numbers[a:b].tolist(), points[a:b].tolist()), np.int64))
        counts.append(np.array([len(ids[-1])]))
    for low in range(long, len(order), SIDE_BY_SIDE):
        some = order[low : low + SIDE_BY_SIDE]
        wide = max(1, int(size[some].max()))
        inside = np.arange(wide) < size[some][:, None]
        where = np.where(inside, at[some][:, None] + np.arange(wide), 0)
        line, code = np.where(inside, numbers[where], 0), np.where(inside, points[where], 0)
        found, count = automaton.many(line, code, size[some])
        ids.append(found)
        counts.append(count)
    flat, count = automaton.written(np.concatenate(ids), np.concatenate(counts))
    begin, of_unit = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    begin[order], of_unit[order] = np.cumsum(count) - count, count
    return flat, begin, of_unit


def encode_batch(texts: pa.Array, automaton: Automaton) -> pa.ListArray:
    """Ids of each text; a space is put before a text that isn't empty."""
    texts = pc.fill_null(texts, "")
    led = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(" ", texts, ""))
    out, counts = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
    for block in blocks(led, BLOCK_BYTES):
        start, ptr = _units(block, automaton)
        end = np.append(start[1:], len(block.data))[: len(start)]
        hashes = block.hashes(start, end, lower=False)
        _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
        raw = block.data.tobytes()
        units = [raw[a:b].decode() for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        if units:
            ids, begin, count = _paths(units, automaton)
            size = count[number]
            shift = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            out.append(ids[np.repeat(begin[number], size) + shift])
        else:
            size = np.zeros(0, np.int64)
        sums = np.concatenate([[0], np.cumsum(size)])
        counts.append(sums[ptr[1:]] - sums[ptr[:-1]])
    ends = np.cumsum(np.concatenate(counts)).astype(np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate(out).astype(np.int32))


def decode_batch(ids: pa.ListArray, stands: list[bytes]) -> pa.Array:
    """The text of each list of ids, without the space put before it. NULL is the empty text.

    Bytes that are no UTF-8, and ids outside the vocabulary, become replacement characters.
    """
    size = np.array([len(x) for x in stands], np.int64)
    begin = np.cumsum(size) - size
    data = np.frombuffer(b"".join(stands), np.uint8)
    flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    counts = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    valid = (flat >= 0) & (flat < len(stands))
    if not valid.all():
        lost = "�".encode()
        stands, flat = [*stands, lost], np.where(valid, flat, len(stands))
        return decode_batch(pa.ListArray.from_arrays(np.append(0, np.cumsum(counts)).astype(np.int32), flat), stands)
    wide = size[flat]
    ends = np.cumsum(wide)
    shift = np.arange(wide.sum()) - np.repeat(ends - wide, wide)
    raw = data[np.repeat(begin[flat], wide) + shift].tobytes()
    bounds = np.append(0, ends)[np.append(0, np.cumsum(counts))].tolist()
    texts = (raw[a:b].decode("utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:], strict=True))
    return pa.array([x[1:] if x.startswith(" ") else x for x in texts], pa.string())


def encoded(df: DataFrame, model_file: str = MODEL) -> DataFrame:
    """The rows with ids (array<int>), n_pieces and round_trip: whether decoding gives the text again.

    A NULL text is encoded as an empty one, which has no ids. Columns of these three names are
    replaced, all others are kept; rows are encoded one by one, so repeated rows stay repeated, and
    an empty table gives an empty result.
    """
    in_small_batches(df.sparkSession)
    automaton, stands = load(model_file)
    kept = [c for c in df.columns if c not in ("ids", "n_pieces", "round_trip")]

    def encode(batches):
        for batch in batches:
            at = 0
            while at < batch.num_rows or batch.num_rows == at == 0:
                some = batch.slice(at, ROWS)
                ids = encode_batch(some["text"], automaton)
                back = decode_batch(ids, stands)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(some[c] for c in kept),
                        ids,
                        pc.list_value_length(ids),
                        pc.equal(back, pc.fill_null(some["text"], "").cast(pa.string())),
                    ],
                    names=[*kept, "ids", "n_pieces", "round_trip"],
                )
                at += ROWS
                if not batch.num_rows:
                    break

    schema = df.select(*kept).schema.add("ids", ArrayType(IntegerType())).add("n_pieces", IntegerType()).add(
        "round_trip", BooleanType()
    )
    return df.select(*kept).mapInArrow(encode, schema)


def decoded(df: DataFrame, model_file: str = MODEL) -> DataFrame:
    """The rows of (.., ids) with `text` decoded from the ids; NULL ids give the empty text."""
    in_small_batches(df.sparkSession)
    _, stands = load(model_file)
    kept = [c for c in df.columns if c != "text"]

    def decode(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in kept), decode_batch(batch["ids"], stands)], names=[*kept, "text"]
            )

    return df.select(*kept).mapInArrow(decode, df.select(*kept).schema.add("text", StringType()))


def encode_ids(df: DataFrame, model_file: str = MODEL) -> DataFrame:
    """doc_id, n_pieces, ids, round_trip of every document."""
    found = encoded(df.select(F.col("doc_id").cast("long"), "text"), model_file)
    return found.select("doc_id", "n_pieces", "ids", "round_trip")
