"""Small inputs with everything that may go wrong: NULLs, empty and long texts, copies, clashing names."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

DDL = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHING = ["key", "token", "rep", "comp", "bucket", "row", "score", "bits", "found", "ids", "at", "n", "x"]


def documents(spark, rows):
    """Rows (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(*r, *(("en", "web")[len(r) - 2 :] if len(r) < 4 else ())) for r in rows]
    data = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in full]
    df = spark.createDataFrame(data, DDL)
    return df.withColumns({c: F.lit("clash") for c in CLASHING})


def prose(rng: random.Random, words: int, vocabulary: int = 3000) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


def odd_texts() -> list:
    rng = random.Random(5)
    return [
        (901, None),
        (902, ""),
        (903, " \n\t "),
        (904, "one"),
        (905, "one"),
        (906, "Zwölf Boxkämpfer jagen 日本語 \U0001f600"),
        (907, prose(rng, 20_000)),
        (None, "text without an id"),
        (904, "one"),
    ]


def collected(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]
