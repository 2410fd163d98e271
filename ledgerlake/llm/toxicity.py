"""Toxic passages by maximum-scoring segments, aggregated by extreme-value calibration.

Every token has a log-odds score of toxic against clean, with Dirichlet priors: a word's prior has
the weight of its frequency in the whole corpus and the odds of its longest stem (its first 7
letters), which has those of the next shorter one, and so on. Words and stems are known by hashes of 64
bits: those of the labelled sample are held, each with its own counts, so a word that the sample lacks is
judged by its longest stem that it has, however large the corpus. Scores are lowered by a multiple of
their standard error and by an offset, which makes chance segments negative on average.

One linear scan (Ruzzo and Tompa) finds all maximal-scoring segments of a text. Chance maxima of
such sums follow an extreme-value law; its two parameters are fitted on clean rows of the sample. A
segment of score s in a text of n tokens is expected K * n * exp(-lambda * s) times by chance, and
significant if that is EVALUE at most. A text is judged by the chance of its best segments together,
as many of all it has as make that least, through a rising curve over the logarithm that is fitted on a
part of the sample kept aside.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.labelled import look_up, remainder, sample
from ledgerlake.llm.tables import cut
from ledgerlake.llm.words import Block, blocks, mix

#: Letters of stems.
STEMS = (4, 5, 6, 7)
#: Labelled rows that class counts are taken from at most.
SAMPLE_ROWS = 20_000
#: Weight of all priors of words, dealt by corpus frequency, and what any word or stem has at least.
PRIOR = 2_000.0
LEAST = 6.0
CAUTION = 1.5
OFFSET = 1.0
EVALUE = 0.01
THRESHOLD = 0.7

_U = np.uint64
_EDGE = np.zeros(256, bool)  # bytes that are no part of a word at its ends
_EDGE[[b for b in range(128) if not chr(b).isalnum()]] = True


def _tokens(block: Block) -> np.ndarray:
    """Per word, without marks at its ends, the keys of its stems and its own: one line each."""
    block.find_words()
    data = block.data
    start, end, _ = block.without_marks(_EDGE)
    if not len(start):
        return np.zeros((len(STEMS) + 1, 0), _U)
    lead = (data & 0xC0) != 0x80
    at = np.append(np.flatnonzero(lead), len(data))
    number = (np.cumsum(lead) - 1)[start]
    ends = [np.minimum(at[np.minimum(number + k, len(at) - 1)], end) for k in STEMS]
    hashed = block.hashes(np.tile(start, len(STEMS) + 1), np.concatenate([*ends, end]))
    return mix(hashed.reshape(len(STEMS) + 1, -1) + np.arange(len(STEMS) + 1, dtype=_U)[:, None])


def _of_classes(df: DataFrame, ids: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """Keys of words and stems in the sample, ascending, if each is a word's, and how many of its clean
    and toxic texts hold it.
    """
    spark = df.sparkSession
    known = spark.createDataFrame(zip(ids.tolist(), y.tolist(), strict=True), "doc_id long, y int")

    def count(batches):
        for batch in batches:
            kind = batch["y"].to_numpy()
            for block in blocks(batch["text"]):
                tokens = _tokens(block)
                key, number = np.unique(tokens, return_inverse=True)
                number = number.reshape(tokens.shape)
                row = np.repeat(np.arange(block.rows), np.diff(block.word_ptr))
                once = np.unique(number * block.rows + row[None, :])
                toxic = kind[block.first + once % block.rows] == 1 if len(once) else once > 0
                held = once // max(block.rows, 1)
                bad = np.bincount(held[toxic], minlength=len(key))
                word = np.zeros(len(key), bool)
                word[number[-1]] = True
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key.view(np.int64)),
                        pa.array(word),
                        pa.array(np.bincount(held, minlength=len(key)) - bad),
                        pa.array(bad),
                    ],
                    names=["key", "word", "clean", "toxic"],
                )

    # the sample has a bounded number of rows, whatever the corpus
    found = (
        df.select(F.col("doc_id").cast("long"), "text")
        .join(F.broadcast(known), "doc_id")
        .select("y", "text")
        .mapInArrow(count, "key long, word boolean, clean long, toxic long")
        .groupBy("key")
        .agg(F.max("word").alias("word"), *(F.sum(c).cast("int").alias(c) for c in ("clean", "toxic")))
        .toArrow()
    )
    key = found["key"].to_numpy().view(_U)
    order = np.argsort(key)
    return key[order], *(found[c].to_numpy()[order] for c in ("word", "clean", "toxic"))


def _of_corpus(df: DataFrame, held: np.ndarray) -> tuple[np.ndarray, int]:
    """How often each held word is in all documents, and all their words."""

    def count(batches):
        total, words = np.zeros(len(held), np.int64), 0
        for batch in batches:
            for block in blocks(batch["text"]):
                own = _tokens(block)[-1]
                words += len(own)
                key, times = np.unique(own, return_counts=True)
                at = look_up(held, key)
                total[at[at >= 0]] += times[at >= 0]
        used = np.flatnonzero(total)
        for k in range(0, len(used), 1 << 16):
            some = used[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["at", "every"])
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([words])], names=["at", "every"])

    found = (
        df.select("text").mapInArrow(count, "at long, every long").groupBy("at").agg(F.sum("every").alias("every"))
    ).toArrow()
    at, every = found["at"].to_numpy(), found["every"].to_numpy()
    out = np.zeros(len(held), np.int64)
    out[at[at >= 0]] = every[at >= 0]
    return out, int(every[at < 0].sum())


class Odds:
    """Scores of tokens from the counts of corpus, clean and toxic rows.

    All levels have Dirichlet priors over the two classes: a stem is drawn to the next shorter one,
    the shortest to the classes' shares, a word to its longest stem, the stronger the more frequent
    the word is in the corpus. What was never seen scores nothing.
    """

    def __init__(self, keys: np.ndarray, word: np.ndarray, clean: np.ndarray, toxic: np.ndarray):
        self.keys, self.word = keys, word
        # one line more, of nothing, for what is not held
        self.clean, self.toxic = (np.append(x, 0).astype(np.int32) for x in (clean, toxic))
        n = [int(x[word].sum()) for x in (clean, toxic)]
        self.known = all(n)
        self.share = n[1] / max(1, sum(n))
        self.weight = np.full(len(keys) + 1, LEAST)

    def frequencies(self, df: DataFrame) -> None:
        """Takes the weights of words from their share of all documents."""
        every, words = _of_corpus(df, self.keys[self.word])
        self.weight[:-1][self.word] += PRIOR * every / max(1, words)
        # tasks that score need no more than keys, counts and weights
        self.word = None

    def scores(self, tokens: np.ndarray) -> np.ndarray:
        distinct, number = np.unique(tokens[-1], return_inverse=True)
        if not len(distinct):
            return np.zeros(0)
        # stems follow from the word, so each distinct word is scored once
        first = np.zeros(len(distinct), np.int64)
        first[number] = np.arange(len(number))
        tokens = tokens[:, first]
        odds = np.full(len(distinct), self.share)
        for line in tokens[:-1]:
            at = look_up(self.keys, line)
            clean, bad = self.clean[at], self.toxic[at]
            odds = (bad + LEAST * odds) / (clean + bad + LEAST)
        at = look_up(self.keys, tokens[-1])
        weight = self.weight[at]
        clean, bad = self.clean[at] + weight * (1 - odds), self.toxic[at] + weight * odds
        error = np.sqrt(1 / (clean + 0.5) + 1 / (bad + 0.5))
        even = np.log(self.share / (1 - self.share))
        return (np.log(bad / clean) - even - CAUTION * error - OFFSET)[number]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of one sequence, in order.

    Only positive scores start or end a segment, so what lies between them enters as its sum.
    Each candidate remembers the sums before and after it, and looks back over candidates until one
    starts lower; each is merged or passed at most once.
    """
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    open_: list[tuple[int, int, float, float]] = []
    for at in np.flatnonzero(scores > 0).tolist():
        new = (at, at + 1, float(sums[at]), float(sums[at + 1]))
        while True:
            k = len(open_) - 1
            passed = []
            while k >= 0 and open_[k][2] >= new[2]:
                passed.append(k)
                k -= 1
            if k < 0 or open_[k][3] >= new[3]:
                open_.append(new)
                break
            new = (open_[k][0], new[1], open_[k][2], new[3])
            del open_[k:]
    return [(a, b, right - left) for a, b, left, right in open_]


def _found(df: DataFrame, odds: Odds) -> DataFrame:
    """doc_id, n (tokens), all segments of every document."""

    def find(batches):
        for batch in batches:
            n, held = [], []
            for block in blocks(batch["text"]):
                scores = odds.scores(_tokens(block))
                for a, b in zip(block.word_ptr[:-1].tolist(), block.word_ptr[1:].tolist(), strict=True):
                    found = segments(scores[a:b]) if (scores[a:b] > 0).any() else []
                    n.append(b - a)
                    held.append([{"start": i, "end": j, "score": s} for i, j, s in found])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array(n, pa.int64()),
                    pa.array(held, kind),
                ],
                names=["doc_id", "n", "segments"],
            )

    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        find,
        "doc_id long, n long, segments array<struct<start:int,end:int,score:double>>",
    )


def chance_law(best: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """lambda and K of the extreme-value law: a chance text of n tokens has segments of a score
    above s in number K * n * exp(-lambda * s) on average. From texts that are clean.
    """
    some = best > 0
    if some.sum() < 10:
        return 1.0, 1 / max(1.0, float(n.sum()))
    return float(1 / np.mean(best[some])), float(some.sum() / n.sum())


def unlikely(scores: np.ndarray, ptr: np.ndarray, n: np.ndarray, lam: float, k: float) -> np.ndarray:
    """-ln of the chance that a clean text of n tokens has segments as good as the r best, for the r
    that makes it least likely (sum statistics of segment scores); 0 without any segment.

    The segments of text i are scores[ptr[i]:ptr[i + 1]], in any order.
    """
    out = np.zeros(len(n))
    if not len(scores):
        return out
    text = np.repeat(np.arange(len(n)), np.diff(ptr))
    falling = scores[np.lexsort((-scores, text))]
    each = lam * falling - np.log(k * np.maximum(n, 1))[text]
    total = np.concatenate([[0.0], np.cumsum(each)])
    sums = total[1:] - total[ptr[text]]
    r = np.arange(len(text)) - ptr[text] + 1
    ln_factorial = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, r.max() + 1)))])
    some = np.maximum(sums, 1e-9)
    tail = -some + (r - 1) * np.log(some) - ln_factorial[r] - ln_factorial[r - 1]
    # for one segment the exact law, for more its tail, where it holds
    one = np.log(-np.expm1(-np.exp(np.minimum(-sums, 50))) + 1e-300)
    chance = np.where(r == 1, one, tail)
    np.maximum.at(out, text, np.where((r == 1) | (sums > r), -chance - np.log(r), 0.0))
    return out


def rising(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (x, share of y) of the non-decreasing curve nearest to the data (pooled neighbours)."""
    at, group = np.unique(x, return_inverse=True)
    size = np.bincount(group).astype(np.float64)
    pools: list[list[float]] = []
    for a, n, ones in zip(at, size, np.bincount(group, y), strict=True):
        pools.append([a * n, n, ones])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [u + v for u, v in zip(pools[-1], last, strict=True)]
    sums = np.array(pools)
    return sums[:, 0] / sums[:, 1], (sums[:, 2] + y.mean()) / (sums[:, 1] + 1)


def score(df: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages and passages for every row of (doc_id, text).

    Passages are the significant segments, as token positions with their scores. Labels are learned
    from `sample_rows` rows of labels (doc_id, toxic) at most, never from the held-out fold; token
    frequencies are those of all documents. NULL, empty and blank texts have no tokens and a best
    score of 0. If labels are missing or all alike, every score is their mean (0 without any) and
    there are no passages. Rows that repeat a doc_id are scored each. Other columns are ignored.
    """
    ids, y = sample(labels, "toxic", remainder(F.col("doc_id"), 3) != 1, sample_rows)
    # every third row of the sample is kept aside: its own words would flatter the calibration
    aside = np.arange(len(ids)) % 3 == 0
    odds = Odds(*_of_classes(df, ids[~aside], y[~aside]))
    held_out = (remainder(F.col("doc_id"), 3) == 1).alias("held_out")
    none = F.array().cast("array<struct<start:int,end:int,score:double>>")
    if not odds.known:
        return df.select(
            F.col("doc_id").cast("long"),
            held_out,
            F.lit(float(y.mean()) if len(y) else 0.0).alias("score"),
            F.lit(int(len(y) > 0 and y.mean() >= THRESHOLD)).alias("predicted"),
            F.lit(0).alias("n_passages"),
            none.alias("passages"),
        )
    odds.frequencies(df)
    found = cut(_found(df, odds))

    ids, y = ids[aside], y[aside]

    def labelled(batches):
        for batch in batches:
            at = look_up(ids, batch["doc_id"].to_numpy(zero_copy_only=False))
            yield batch.filter(pa.array(at >= 0))

    known = (
        found.select("doc_id", "n", F.transform("segments", lambda s: s["score"]).alias("scores"))
        .where(F.col("doc_id").isNotNull())
        .mapInArrow(labelled, "doc_id long, n long, scores array<double>")
        .dropDuplicates(["doc_id"])
        .orderBy("doc_id")
        .toPandas()
    )
    of = y[look_up(ids, known["doc_id"].to_numpy(np.int64))]
    n = known["n"].to_numpy(np.float64)
    held = [np.asarray(x, np.float64) for x in known["scores"]]
    best = np.array([x.max(initial=0.0) for x in held])
    lam, k = chance_law(best[of == 0], n[of == 0])
    ptr = np.cumsum([0, *map(len, held)])
    flat = np.concatenate([np.zeros(0), *held])
    knots, shares = rising(unlikely(flat, ptr, n, lam, k), of.astype(np.float64))

    def judge(batches):
        for batch in batches:
            ptr = np.append(0, np.cumsum(batch["segments"].value_lengths().to_numpy()))
            scores = batch["segments"].flatten().field("score").to_numpy()
            x = unlikely(scores, ptr, batch["n"].to_numpy(), lam, k)
            # a little of the logarithm itself tells rows of one share apart
            judged = 0.999 * np.interp(x, knots, shares) + 0.001 * x / (1 + x)
            expected = np.maximum(batch["n"].to_numpy(), 1) * k / EVALUE
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(judged), pa.array(np.log(expected) / lam), batch["segments"]],
                names=["doc_id", "score", "bar", "segments"],
            )

    kind = found.schema["segments"].dataType.simpleString()
    significant = F.filter("segments", lambda s: s["score"] >= F.col("bar"))
    return found.mapInArrow(
        judge, f"doc_id long, score double, bar double, segments {kind}"
    ).select(
        "doc_id",
        held_out,
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        F.size(significant).alias("n_passages"),
        significant.alias("passages"),
    )
