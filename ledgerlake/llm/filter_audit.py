"""What filters do to each other: every order of five filters, from one count of failure masks.

A document's failures are a mask of one bit per filter. Whatever the order, each step's outcome for
the document (kept, removed here, failing but removed earlier) follows from its mask alone, so rows
are counted by part, mask and label first. Each mask then maps to one wide integer with a field of
64 bits for every outcome of every step of every order; a part's integer is the sum over its masks,
each multiplied by its count. No field can run over while a part has fewer than 2^63 rows, so the
sum is unpacked as plain counters.

Copies (E) need the least id of each distinct text. Texts are known by their SHA-256; ids are reduced
to the least one per digest with partial aggregation, and met again on digest and id together, so
that a text which a third of all rows share is no hot key. Repeated rows are counted before they
are shuffled.
"""

from __future__ import annotations

from functools import cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.tables import stored

LETTERS = "ABCDE"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BLANKS = " \t\n\x0b\x0c\r"
_FIELD = 64
_KINDS = ("kept", "removed", "redundant")

AUDIT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def _bit(failing: Column, letter: str) -> Column:
    return F.when(failing, 1 << LETTERS.index(letter)).otherwise(0)


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, mask) of every row, with the failures A to D that its text decides."""
    words = F.split(F.btrim("text", F.lit(_BLANKS)), r"[\x20\x09-\x0D]+")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    ).withColumn("words", words)
    # a blank text splits into one empty piece
    blank = (F.size("words") == 1) & (F.element_at("words", 1) == "")
    counted = rows.select(
        "doc_id",
        "part",
        F.unhex(F.sha2("text", 256)).alias("digest"),
        (F.size("words") - blank.cast("int")).alias("n"),
        F.size(F.array_distinct("words")).alias("distinct"),
        F.length("text").alias("points"),
        F.length(F.translate("text", _UPPER, "")).alias("others"),
        F.col("text").rlike("[#$%&*|]").alias("marked"),
    )
    as_long = lambda c: F.col(c).cast("long")
    mask = (
        _bit(F.col("n") < 50, "A")
        + _bit(as_long("distinct") * 100 < as_long("n") * 65, "B")
        + _bit((as_long("points") - F.col("others")) * 100 > as_long("points") * 5, "C")
        + _bit(F.col("marked"), "D")
    )
    return counted.select("doc_id", "part", "digest", mask.alias("mask"))


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): rows of each part by full mask and label."""
    facts = stored(failures(docs), "op11-failures")
    rows = facts.groupBy("digest", "doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    least = (
        facts.groupBy("digest")
        .agg(F.min("doc_id").alias("doc_id"))
        .where("doc_id IS NOT NULL")
        .withColumn("least", F.lit(True))
    )
    copy = F.col("doc_id").isNotNull() & F.col("least").isNull()
    judged = (
        rows.join(least, ["digest", "doc_id"], "left")
        .select("doc_id", "part", (F.col("mask") + _bit(copy, "E")).alias("mask"), "n")
        .groupBy("doc_id", "part", "mask")
        .agg(F.sum("n").alias("n"))
    )
    told = (
        labels.where("doc_id IS NOT NULL")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.expr("quality <=> 1")).alias("good"), F.max(F.expr("toxic <=> 1")).alias("toxic"))
    )
    return (
        judged.join(told, "doc_id", "left")
        .groupBy(
            "part",
            "mask",
            F.coalesce("good", F.lit(False)).alias("good"),
            F.coalesce("toxic", F.lit(False)).alias("toxic"),
        )
        .agg(F.sum("n").alias("n"))
    )


@cache
def orders(letters: str = LETTERS) -> tuple[str, ...]:
    return tuple("".join(p) for p in permutations(letters))


@cache
def wide_counter(mask: int, letters: str = LETTERS) -> int:
    """The integer of one row with this mask: a field per order, step and kind, then one per filter.

    A step's kinds are kept, removed and redundant. The field of a filter tells that the row fails
    it and no other.
    """
    fields = []
    for order in orders(letters):
        earlier = 0
        for letter in order:
            own = 1 << letters.index(letter)
            gone, fails = bool(mask & earlier), bool(mask & own)
            fields += [not gone and not fails, fails and not gone, fails and gone]
            earlier |= own
    fields += [mask == 1 << k for k in range(len(letters))]
    return sum(1 << (_FIELD * k) for k, one in enumerate(fields) if one)


def unpack(total: int, letters: str = LETTERS) -> tuple[np.ndarray, np.ndarray]:
    """Counters by (order, step, kind), and by filter, out of a sum of wide counters."""
    n, steps = len(letters), len(orders(letters)) * len(letters)
    size = len(_KINDS) * steps + n
    fields = np.frombuffer(total.to_bytes(size * _FIELD // 8, "little"), "<i8")
    return fields[:-n].reshape(-1, n, len(_KINDS)), fields[-n:]


def _part_audit(part: pa.Table) -> pa.Table:
    every = good = toxic = 0
    columns = (part[c].to_pylist() for c in ("mask", "good", "toxic", "n"))
    for mask, is_good, is_toxic, n in zip(*columns, strict=True):
        counted = wide_counter(mask) * n
        every += counted
        good += counted if is_good else 0
        toxic += counted if is_toxic else 0
    steps, only = unpack(every)
    lost = [unpack(x)[0][:, :, 1].ravel() for x in (good, toxic)]
    at = np.array([[LETTERS.index(c) for c in order] for order in orders()])
    removed = steps[:, :, 1]
    shapley = np.array([removed[at == k].sum() for k in range(len(LETTERS))])
    count = at.size
    return pa.table(
        {
            "part": pa.array([part["part"][0].as_py()] * count, pa.string()),
            "filter_order": [o for o in orders() for _ in LETTERS],
            "step": pa.array(list(range(1, len(LETTERS) + 1)) * len(orders()), pa.int32()),
            **{kind: steps[:, :, k].ravel() for k, kind in enumerate(_KINDS)},
            "unique_fails": only[at.ravel()],
            "good_lost": lost[0],
            "toxic_lost": lost[1],
            "shapley": shapley[at.ravel()],
        }
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every step of every order of the filters A to E, per source: see AUDIT for the columns.

    A fails under 50 words, B under 65 distinct words in a hundred, C above 5 capitals A-Z in a
    hundred characters, D any of #$%&*|, E a text that a smaller doc_id has as well, anywhere in
    the table. A NULL text is the empty text, a NULL source the part "" (as an empty source is). A
    row without an id is never a copy, nor is another one its copy. Rows repeated with one id and
    text are each counted, and none of them is the other's copy. Labels of an id that has several
    count if one of them is 1; rows without a label lose nothing. An empty table gives no rows.
    Only doc_id, text and source are read, whatever other columns are named.
    """
    return masks(docs, labels).groupBy("part").applyInArrow(_part_audit, AUDIT)
