"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Random indexing gives every word a fixed sparse random vector; the vector of a word is the sum of
those of its neighbours, over the whole corpus. Each word stands in two places: as itself (hashed to
WORD_SLOTS) and as its outline, which tells case, digits, marks, length and whether it repeats the
word before (SHAPE_SLOTS). Sums are integers, so they don't depend on the order of tasks, and the
table has a fixed size.

A document is the mean of its words' vectors and of their outlines'. A network with one hidden
layer is fitted on a bounded sample of labelled rows; a temperature fitted on a part kept aside
makes its outputs probabilities.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.labelled import look_up, remainder, sample
from ledgerlake.llm.tables import in_small_batches
from ledgerlake.llm.words import Block, blocks, mix

WORD_SLOTS = 1 << 13
SHAPE_SLOTS = 1 << 10
SLOTS = WORD_SLOTS + SHAPE_SLOTS
DIMS = 24
#: Non-zero entries of a random vector, and neighbours looked at on each side.
ENTRIES = 4
WINDOW = 2
#: Labelled rows the network is fitted on at most.
SAMPLE_ROWS = 20_000
HIDDEN = 32
EPOCHS = 40
THRESHOLD = 0.7
#: Bytes of text whose words' vectors are held at a time: some 400 bytes a word.
BLOCK = 1 << 18
FEATURES = 2 * DIMS + 2

_U = np.uint64


def _random_vectors() -> np.ndarray:
    """Ternary vectors by rule: entry and sign come from a hash of slot and number."""
    out = np.zeros((SLOTS, DIMS), np.int32)
    slot = np.arange(SLOTS, dtype=_U)
    for k in range(ENTRIES):
        h = mix(slot * _U(ENTRIES) + _U(k + 1))
        np.add.at(
            out,
            (np.arange(SLOTS), (h % _U(DIMS)).astype(np.int64)),
            np.where((h >> _U(40)) & _U(1), 1, -1),
        )
    return out


def _slots(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Per word its slot, and the slot of its outline."""
    words = block.word_hashes()
    data = block.data
    upper = (data >= 65) & (data <= 90)
    lower = (data >= 97) & (data <= 122)
    digit = (data >= 48) & (data <= 57)
    mark = ~(upper | lower | digit) & (data < 128)
    count = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    inside = lambda sums: sums[block.end] - sums[block.start]
    size = block.end - block.start
    uppers, marks = inside(count(upper)), inside(count(mark))
    same = np.zeros(len(words), bool)
    same[1:] = words[1:] == words[:-1]
    # bits: many capitals, any digit, marks (0 to 3 and more), length, repeated word
    shape = (np.minimum(uppers, 2) + 3 * (inside(count(digit)) > 0)).astype(np.int64)
    shape = shape * 4 + np.minimum(marks, 3)
    shape = shape * 6 + np.minimum(np.log2(np.maximum(size, 1)).astype(np.int64), 5)
    shape = shape * 2 + same
    return (words & _U(WORD_SLOTS - 1)).astype(np.int64), WORD_SLOTS + shape % SHAPE_SLOTS


def _context(df: DataFrame) -> np.ndarray:
    """Sum of the random vectors of all neighbours, for each slot, over all texts."""

    def count(batches):
        index = _random_vectors()
        total = np.zeros((SLOTS, DIMS), np.int64)
        for batch in batches:
            for block in blocks(batch["text"], BLOCK):
                word, shape = _slots(block)
                of = np.repeat(np.arange(block.rows), np.diff(block.word_ptr))
                own = index[word] + index[shape]
                near = np.zeros_like(own)
                for d in range(1, WINDOW + 1):
                    if len(own) > d:
                        together = (of[d:] == of[:-d])[:, None]
                        near[d:] += own[:-d] * together
                        near[:-d] += own[d:] * together
                for slot in (word, shape):
                    order = np.argsort(slot, kind="stable")
                    first = np.flatnonzero(np.diff(slot[order], prepend=-1))
                    if len(first):
                        total[slot[order][first]] += np.add.reduceat(near[order], first, axis=0)
        used = np.flatnonzero(total.any(1))
        for at in range(0, len(used), 2048):
            some = used[at : at + 2048]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some), *(pa.array(total[some, d]) for d in range(DIMS))],
                names=["slot", *(f"d{d}" for d in range(DIMS))],
            )

    columns = [f"d{d}" for d in range(DIMS)]
    found = (
        df.select("text")
        .mapInArrow(count, "slot long, " + ", ".join(f"{c} long" for c in columns))
        .groupBy("slot")
        .agg(*(F.sum(c).alias(c) for c in columns))
        .toPandas()
    )
    out = np.zeros((SLOTS, DIMS))
    out[found["slot"].to_numpy(np.int64)] = found[columns].to_numpy(np.float64)
    return out


def word_vectors(df: DataFrame) -> np.ndarray:
    """A unit vector for each slot, less the direction that all have in common."""
    context = _context(df)
    norm = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    unit = norm(context)
    seen = context.any(1)
    for part in (slice(0, WORD_SLOTS), slice(WORD_SLOTS, SLOTS)):
        if seen[part].any():
            unit[part] -= unit[part][seen[part]].mean(0)
    return (norm(unit) * seen[:, None]).astype(np.float32)


def _pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Per text the means of its words' vectors and outlines, and how many words there are."""
    rows = [np.zeros((0, FEATURES), np.float32)]
    for block in blocks(texts, BLOCK):
        slots = _slots(block)
        n = np.diff(block.word_ptr)
        x = np.zeros((block.rows, FEATURES), np.float32)
        some = np.flatnonzero(n)
        for k, slot in enumerate(slots):
            if len(some):
                sums = np.add.reduceat(vectors[slot], block.word_ptr[some], axis=0)
                x[some, k * DIMS : (k + 1) * DIMS] = sums / n[some, None]
        x[:, -2] = np.log1p(n) / 8
        x[:, -1] = n == 0
        rows.append(x)
    return np.concatenate(rows)


def _labelled_features(df: DataFrame, vectors: np.ndarray, ids: np.ndarray) -> DataFrame:
    """doc_id, x of the documents whose ids are in the bounded sample."""

    def pool(batches):
        for batch in batches:
            known = look_up(ids, batch["doc_id"].to_numpy(zero_copy_only=False)) >= 0
            some = batch.filter(pa.array(known))
            flat = _pooled(some["text"], vectors).ravel()
            ends = np.arange(0, len(flat) + 1, FEATURES, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [some["doc_id"], pa.ListArray.from_arrays(ends, flat)], names=["doc_id", "x"]
            )

    return (
        df.select(F.col("doc_id").cast("long"), "text")
        .where(F.col("doc_id").isNotNull())
        .mapInArrow(pool, "doc_id long, x array<float>")
    )


class Network:
    """tanh layer and logistic output, with a temperature; fitted by Adam from a fixed seed."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS):
        self.base = float(y.mean()) if len(y) else 0.5
        self.fitted = len(y) >= 10 and 0 < y.sum() < len(y)
        if not self.fitted:
            return
        draw = np.random.default_rng(0)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        x = (x - self.mean) / self.scale
        aside = draw.random(len(y)) < 0.2
        w = [
            draw.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)),
            np.zeros(hidden),
            draw.normal(0, 1 / np.sqrt(hidden), hidden),
            np.zeros(1),
        ]
        self.w = w
        m, v, t = [0 * a for a in w], [0 * a for a in w], 0
        fit_x, fit_y = x[~aside], y[~aside]
        for _ in range(epochs):
            order = draw.permutation(len(fit_y))
            for at in range(0, len(order), 128):
                some = order[at : at + 128]
                h = np.tanh(fit_x[some] @ w[0] + w[1])
                err = (1 / (1 + np.exp(-(h @ w[2] + w[3]))) - fit_y[some]) / len(some)
                back = np.outer(err, w[2]) * (1 - h * h)
                grads = [fit_x[some].T @ back + 1e-5 * w[0], back.sum(0), h.T @ err, err.sum()]
                t += 1
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    w[k] -= 3e-3 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.temperature = 1.0
        if aside.any() and 0 < y[aside].sum() < aside.sum():
            logit = self._logit(x[aside])
            loss = lambda c: np.logaddexp(0, np.where(y[aside] == 1, -1, 1) * logit / c).mean()
            self.temperature = min(np.geomspace(0.3, 10, 60), key=loss)

    def _logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.tanh(x @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3], -50, 50)

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), self.base)
        logit = self._logit((x - self.mean) / self.scale)
        return 1 / (1 + np.exp(-logit / self.temperature))


def fit(df: DataFrame, labels: DataFrame, sample_rows: int) -> tuple[np.ndarray, Network]:
    """Word vectors of the corpus, and a network fitted on the labelled sample."""
    in_small_batches(df.sparkSession)
    ids, y = sample(labels, "quality", remainder(F.col("doc_id"), 4) != 2, sample_rows)
    vectors = word_vectors(df)
    known = (
        _labelled_features(df, vectors, ids).dropDuplicates(["doc_id"]).orderBy("doc_id").toPandas()
    )
    x = np.stack(known["x"].to_list()) if len(known) else np.zeros((0, FEATURES))
    found = look_up(ids, known["doc_id"].to_numpy(np.int64))
    return vectors, Network(x.astype(np.float64), y[found].astype(np.float64))


def score(df: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of (doc_id, text).

    Labels are learned from `sample_rows` rows of labels (doc_id, quality) at most, and never from
    the held-out fold. NULL, empty and blank texts have the score of a document without words. If
    labels are missing or all alike, every score is their mean, 0.5 without any. Rows that repeat a
    doc_id are scored each. An empty table gives an empty result; other columns are ignored.
    """
    vectors, network = fit(df, labels, sample_rows)

    def judge(batches):
        for batch in batches:
            x = _pooled(batch["text"], vectors).astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(network.probability(x))], names=["doc_id", "score"]
            )

    found = df.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        judge, "doc_id long, score double"
    )
    return found.select(
        "doc_id",
        (remainder(F.col("doc_id"), 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def accepted(df: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows that are predicted to be good, with all columns. Texts stay where they are read."""
    vectors, network = fit(df, labels, sample_rows)

    def keep(batches):
        for batch in batches:
            x = _pooled(batch["text"], vectors).astype(np.float64)
            yield batch.filter(pa.array(network.probability(x) >= THRESHOLD))

    return df.mapInArrow(keep, df.schema)
