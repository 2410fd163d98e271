"""Language by known words first, backing off to character n-grams for unseen words.

A model holds, per language, the relative frequency of the words and of the character n-grams (with
word bounds) that are most frequent in some language. A known word scores its log frequency in each
language. An unseen word is scored by its longest n-grams that are known: all of its 4-grams that the
model has, else its 3-grams, 2-grams, single characters. The language with the highest sum wins.

All languages are measured over the same keys: what a language hasn't shown has the frequency that
it has in the mean of all languages, with the weight of UNSEEN words per key of the model. A language
with few learning rows is thus near that mean and takes no text that another language knows better.

Everything is counted over all learning rows. Only the model has a size limit (WORDS and GRAMS
entries): it is held by every task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.labelled import remainder
from ledgerlake.llm.tables import cut
from ledgerlake.llm.words import Block, blocks, mix

WORDS = 1 << 17
GRAMS = 1 << 17
LONGEST = 4
#: Words per key of the model that the mean of all languages counts for in each of them.
UNSEEN = 0.5
#: A softmax over sums of thousands of words is 0 or 1; this many words of evidence count.
EVIDENCE = 20

#: Bytes looked at together; more repeat more words.
BLOCK = 1 << 21

_U = np.uint64
_EDGE = np.zeros(256, bool)
_EDGE[[b for b in range(128) if not chr(b).isalpha()]] = True


class Vocabulary:
    """Words without marks at their ends: hashes of the distinct ones, and where these stand."""

    def __init__(self, block: Block, start: np.ndarray, end: np.ndarray):
        hashes = block.hashes(start, end)
        self.words, first, self.number = np.unique(hashes, return_index=True, return_inverse=True)
        self.block, self.start, self.end = block, start[first], end[first]

    @classmethod
    def of_texts(cls, block: Block) -> Vocabulary:
        """Those of a block of texts; `row` has the text of each occurrence."""
        block.find_words()
        # what has no letter at all says nothing
        start, end, some = block.without_marks(_EDGE)
        row = np.repeat(np.arange(block.rows), np.diff(block.word_ptr))
        out = cls(block, start[some], end[some])
        out.row = row[some]
        return out

    def grams(self, n: int, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-grams of characters of the chosen words, and the word of each.

        For n > 1 a word is taken with a bound before and after it.
        """
        data = self.block.data
        at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        number = np.searchsorted(at, np.stack([self.start[which], self.end[which]]))
        size = number[1] - number[0]
        pad = 1 if n > 1 else 0
        count = np.maximum(size + 2 * pad - n + 1, 0)
        word = np.repeat(np.arange(len(which)), count)
        k = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count) - pad
        low, high = np.maximum(k, 0), np.minimum(k + n, size[word])
        a, b = at[number[0][word] + low], at[number[0][word] + high]
        bounds = (k < 0) + 2 * (k + n > size[word])
        hashes = self.block.hashes(a, b) if len(word) else np.zeros(0, _U)
        return mix(hashes + (bounds * 8 + n).astype(_U)), word


def _word_counts(df: DataFrame) -> DataFrame:
    """lang, word, seen: counts over all learning rows."""

    def count(batches):
        for batch in batches:
            langs = np.array(batch["lang"].to_pylist(), object)
            for block in blocks(batch["text"], BLOCK):
                of_row = langs[block.first : block.first + block.rows]
                held = Vocabulary.of_texts(block)
                texts = block.texts(held.start, held.end)
                for lang in dict.fromkeys(of_row):
                    seen = np.bincount(
                        held.number[of_row[held.row] == lang], minlength=len(held.words)
                    )
                    which = np.flatnonzero(seen)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([lang] * len(which), pa.string()),
                            texts.take(pa.array(which)),
                            pa.array(seen[which], pa.int64()),
                        ],
                        names=["lang", "word", "seen"],
                    )

    return (
        df.select("text", "lang")
        .mapInArrow(count, "lang string, word string, seen long")
        .groupBy("lang", "word")
        .agg(F.sum("seen").alias("seen"))
    )


def _learned(df: DataFrame) -> DataFrame:
    """lang, n (0 for words), key, seen: counts over all learning rows.

    N-grams are taken from the distinct words, with the words' counts.
    """

    def spread(batches):
        for batch in batches:
            langs = np.array(batch["lang"].to_pylist(), object)
            counts = batch["seen"].to_numpy()
            for block in blocks(batch["word"], BLOCK):
                here = slice(block.first, block.first + block.rows)
                for lang in dict.fromkeys(langs[here]):
                    rows = np.flatnonzero(langs[here] == lang)
                    held = Vocabulary(block, block.offsets[rows], block.offsets[rows + 1])
                    seen = np.bincount(held.number, counts[here][rows]).astype(np.int64)
                    yield counted(lang, 0, held.words, seen)
                    for n in range(1, LONGEST + 1):
                        grams, word = held.grams(n, np.arange(len(seen)))
                        keys, number = np.unique(grams, return_inverse=True)
                        sums = np.bincount(number, seen[word], minlength=len(keys))
                        yield counted(lang, n, keys, sums.astype(np.int64))

    def counted(lang, n, keys, seen):
        return pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * len(keys), pa.string()),
                pa.array(np.full(len(keys), n, np.int32)),
                pa.array(keys.view(np.int64)),
                pa.array(seen, pa.int64()),
            ],
            names=["lang", "n", "key", "seen"],
        )

    return (
        _word_counts(df)
        .mapInArrow(spread, "lang string, n int, key long, seen long")
        .groupBy("lang", "n", "key")
        .agg(F.sum("seen").alias("seen"))
    )


class Model:
    """Log frequencies of keys per language, for words and for each length of n-grams."""

    def __init__(self, learned: DataFrame, words: int, grams: int):
        sums = (
            learned.groupBy("lang", "n")
            .agg(F.sum("seen").alias("every"))
            .toPandas()
        )
        self.langs = sorted(set(sums["lang"]))
        every = {(a, b): c for a, b, c in sums.itertuples(index=False)}
        self.tables = {}
        totals = learned.join(
            F.broadcast(self._totals(learned, sums)), ["lang", "n"]
        ).withColumn("share", F.col("seen") / F.col("every"))
        for n, limit in ((0, words), *((n, grams) for n in range(1, LONGEST + 1))):
            kept = (
                totals.where(F.col("n") == n)
                .groupBy("key")
                .agg(F.max("share").alias("most"))
                .orderBy(F.desc("most"), "key")
                .limit(limit)
            )
            rows = (
                totals.where(F.col("n") == n)
                .join(kept.select("key"), "key", "left_semi")
                .select("key", "lang", "seen")
                .toPandas()
            )
            keys = np.unique(rows["key"].to_numpy(np.int64).view(_U))
            seen = np.zeros((len(keys), len(self.langs)))
            at = np.searchsorted(keys, rows["key"].to_numpy(np.int64).view(_U))
            of = np.array([self.langs.index(x) for x in rows["lang"]], np.int64)
            seen[at, of] = rows["seen"].to_numpy(np.float64)
            size = np.array([every.get((x, n), 0) for x in self.langs], np.float64)
            weight = UNSEEN * len(keys)
            mean = (seen / np.maximum(size, 1)).sum(1, keepdims=True) / max(1, len(self.langs))
            table = np.log(seen + weight * mean) - np.log(size + weight) if len(keys) else seen
            self.tables[n] = (keys, table.astype(np.float32))

    @staticmethod
    def _totals(learned: DataFrame, sums) -> DataFrame:
        """Totals per language and length; as many rows as there are languages, times five."""
        rows = [(a, int(b), int(c)) for a, b, c in sums.itertuples(index=False)]
        return learned.sparkSession.createDataFrame(rows, "lang string, n int, every long")

    def _known(self, n: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        held, table = self.tables[n]
        if not len(held):
            return np.zeros(len(keys), bool), np.zeros((len(keys), len(self.langs)), np.float32)
        at = np.minimum(np.searchsorted(held, keys), len(held) - 1)
        return held[at] == keys, table[at]

    def word_scores(self, held: Vocabulary) -> np.ndarray:
        """Per distinct word a score for each language; 0 for words nothing is known of."""
        known, out = self._known(0, held.words)
        out = np.where(known[:, None], out, np.float32(0))
        left = np.flatnonzero(~known)
        for n in range(LONGEST, 0, -1):
            if not len(left):
                break
            grams, word = held.grams(n, left)
            seen, scores = self._known(n, grams)
            some = np.bincount(word[seen], minlength=len(left))
            for k in range(len(self.langs)):
                sums = np.bincount(word[seen], scores[seen, k], minlength=len(left))
                out[left, k] = sums / np.maximum(some, 1)
            left = left[some == 0]
        return out

    def judge(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Per text the number of its language and the probability of it."""
        best, share = [np.zeros(0, np.int64)], [np.zeros(0)]
        for block in blocks(texts, BLOCK):
            held = Vocabulary.of_texts(block)
            scores = self.word_scores(held)
            sums = np.stack(
                [
                    np.bincount(held.row, scores[held.number, k], minlength=block.rows)
                    for k in range(len(self.langs))
                ],
                1,
            )
            n = np.bincount(held.row, minlength=block.rows)
            scaled = sums * (np.minimum(n, EVIDENCE) / np.maximum(n, 1))[:, None]
            odds = np.exp(scaled - scaled.max(1, keepdims=True))
            best.append(sums.argmax(1))
            share.append(odds.max(1) / odds.sum(1))
        return np.concatenate(best), np.concatenate(share)


def identify(df: DataFrame, words: int = WORDS, grams: int = GRAMS) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of (doc_id, text, lang).

    Learned from rows with a language outside the held-out fold. A text that is NULL or has no
    letter is `und` with score 0, and so is every text if there is nothing to learn from. Ties go to
    the language that sorts first. The score is the probability of the language for EVIDENCE words
    of the kind the text has. Rows that repeat a doc_id are judged each. Other columns are ignored.
    """
    fold = remainder(F.col("doc_id"), 5) == 0
    learning = df.where(~fold & F.col("lang").isNotNull() & F.col("text").isNotNull())
    learned = cut(_learned(learning))
    model = Model(learned, words, grams)
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if not model.langs:
        return df.select(
            "doc_id", fold.alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score")
        )

    def judge(batches):
        for batch in batches:
            best, share = model.judge(batch["text"])
            names = pa.array(model.langs, pa.string()).take(pa.array(best))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["lettered"], names, pa.array(share)],
                names=["doc_id", "lettered", "lang", "score"],
            )

    found = df.select(F.col("doc_id").cast("long"), lettered.alias("lettered"), "text").mapInArrow(
        judge, "doc_id long, lettered boolean, lang string, score double"
    )
    return found.select(
        "doc_id",
        fold.alias("held_out"),
        F.when(F.col("lettered"), F.col("lang")).otherwise("und").alias("lang_pred"),
        F.when(F.col("lettered"), F.col("score")).otherwise(0.0).alias("score"),
    )
