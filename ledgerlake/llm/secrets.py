"""Secret scan with multipart credential linking.

Base finds are strong by their form: assignments to telling names, access ids, long hex runs. Parts
of a credential that are weak alone (an account name, a mixed token, an endpoint) are only reported
where they complement each other: every identifier opens a scope around itself, weak secrets that
lie in a scope are reported together with a weak identifier that opened it, and endpoints in the
scope of an identifier that has a secret there. Scopes and parts meet in an interval join: both are
dealt into buckets of text positions and joined on text and bucket, so that a join group is at most
a bucket of one text, however long the text is and however many parts it holds.

All of it is SQL expressions. A text of interest is keyed by its checksum, so copies are worked out
once, and texts without any telling word leave the plan after one search.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.tables import cut

#: Fixed values of the base finds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 8, "access": 16, "hex": 32}

#: Parts that count only together.
ACCOUNT = r"""(?i)\b(?:user(?:name)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})"""
TOKEN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{16,}"
ENDPOINT = r"""(?i)\b(?:https?|ftp|s3|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp)://[^\s"'<>]+|\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"""

KINDS = ["assign", "access", "hex", "linked_account", "linked_secret", "linked_endpoint"]
SCOPE = 200

#: A text without a match of this has no find of any kind: links start from an identifier.
_TELLING = (
    r"(?i:password|passwd|secret|token|api_?key|user|login|account|client_?id|access_?key)"
    r"|AKIA[A-Z0-9]|[0-9a-f]{32}"
)


def _found(text: Column, kind: str, pattern: str, value_group: int = 0) -> Column:
    """Array of what lies before each match, the match, and its value; the tail comes last."""
    every = F.lit(pattern)
    return F.transform(
        F.arrays_zip(
            F.split(text, pattern, -1).alias("gap"),
            F.regexp_extract_all(text, every, F.lit(0)).alias("hit"),
            F.regexp_extract_all(text, every, F.lit(value_group)).alias("value"),
        ),
        lambda x: F.struct(
            F.lit(kind).alias("kind"),
            F.length(x["gap"]).alias("gap"),
            F.length(x["hit"]).alias("hit"),
            F.length(x["value"]).alias("value"),
        ),
    )


def _placed(texts: DataFrame, found: list[Column]) -> DataFrame:
    """key, kind, start, end, value: the matches with their positions in code points."""
    before = Window.partitionBy("key", "kind").orderBy("at")
    return (
        texts.select("key", F.explode(F.array(*found)).alias("of_kind"))
        .select("key", F.posexplode("of_kind").alias("at", "x"))
        .select("key", "at", "x.*")
        .withColumn("end", F.sum(F.col("gap") + F.coalesce(F.col("hit"), F.lit(0))).over(before))
        .where(F.col("hit").isNotNull())
        .select("key", "kind", (F.col("end") - F.col("hit")).alias("start"), "end", "value")
    )


def _least() -> Column:
    kind = F.col("kind")
    return F.coalesce(*(F.when(kind == k, F.lit(n)) for k, n in LEAST.items()))


def _touching(left: DataFrame, right: DataFrame, width: int) -> DataFrame:
    """Interval join: rows of both sides (key, lo, hi, ..) of one text whose intervals touch.

    Every interval is put into all buckets it touches, which are few: intervals are matches and
    scopes. A pair that shares several buckets is taken in the first one.
    """
    dealt = lambda x, lo, hi: x.withColumn(
        "bucket", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width)))
    )
    shared = F.floor(F.greatest("lo", "other_lo") / width)
    return (
        dealt(left, "lo", "hi")
        .join(dealt(right, "other_lo", "other_hi"), ["key", "bucket"])
        .where((F.col("lo") <= F.col("other_hi")) & (F.col("other_lo") <= F.col("hi")))
        .where(F.col("bucket") == shared)
        .drop("bucket")
    )


def _linked(texts: DataFrame, base: DataFrame, scope: int) -> DataFrame:
    """key, kind, start, end of weak parts that complement each other in a scope."""
    account = _placed(texts, [_found(F.col("text"), "account", ACCOUNT)])
    opening = base.where(F.col("kind") == "access").unionByName(account)
    keys = opening.select("key").distinct()
    near = texts.join(keys, "key", "left_semi")
    parts = _placed(
        near,
        [_found(F.col("text"), "secret", TOKEN), _found(F.col("text"), "endpoint", ENDPOINT)],
    )
    scopes = opening.select(
        "key",
        F.col("kind").alias("opened_by"),
        F.col("start").alias("id_start"),
        F.col("end").alias("id_end"),
        F.greatest(F.col("start") - scope, F.lit(0)).alias("lo"),
        (F.col("end") + scope).alias("hi"),
    )
    ends = lambda x: x.select(
        "key", "kind", "start", "end", F.col("start").alias("other_lo"), F.col("end").alias("other_hi")
    )
    secrets = parts.where(F.col("kind") == "secret")
    strong = base.where(F.col("kind").isin("assign", "hex"))
    met = _touching(scopes, ends(secrets.unionByName(strong)), scope).where(
        # the identifier itself is no secret of its own
        (F.col("end") <= F.col("id_start")) | (F.col("start") >= F.col("id_end"))
    )
    owners = met.select("key", "opened_by", "id_start", "id_end", "lo", "hi").distinct()
    endpoints = _touching(owners, ends(parts.where(F.col("kind") == "endpoint")), scope)
    named = lambda x, kind, start, end: x.select(
        "key", F.lit(kind).alias("kind"), F.col(start).alias("start"), F.col(end).alias("end")
    )
    weak = (
        named(owners.where(F.col("opened_by") == "account"), "linked_account", "id_start", "id_end")
        .unionByName(named(met.where(F.col("kind") == "secret"), "linked_secret", "start", "end"))
        .unionByName(named(endpoints, "linked_endpoint", "start", "end"))
        .distinct()
    )
    # what a base find already covers is not reported again
    covered = _touching(
        weak.withColumns({"lo": F.col("start"), "hi": F.col("end") - 1}),
        base.select("key", F.col("start").alias("other_lo"), (F.col("end") - 1).alias("other_hi")),
        scope,
    ).select("key", "kind", "start", "end")
    return weak.join(covered.distinct(), ["key", "kind", "start", "end"], "left_anti")


def _key(text: Column) -> Column:
    return F.when(text.rlike(_TELLING), F.md5(text.cast("binary")))


def _by_text(texts: DataFrame, scope: int) -> DataFrame:
    """key, found: per text all its finds as sorted (start, kind number, end)."""
    base = (
        _placed(
            texts,
            [
                _found(F.col("text"), "assign", ASSIGN, 2),
                _found(F.col("text"), "access", ACCESS),
                _found(F.col("text"), "hex", HEX),
            ],
        )
        .where(F.col("value") >= _least())
        .select("key", "kind", "start", "end", "value")
    )
    base = cut(base)
    found = base.select("key", "kind", "start", "end").unionByName(_linked(texts, base, scope))
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    return found.groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("start", number.alias("no"), "end"))).alias("found")
    )


def _marks(found: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.concat_ws(
        ",",
        F.transform(
            found,
            lambda x: F.concat_ws(
                ":",
                F.element_at(kinds, x["no"]),
                x["start"].cast("string"),
                x["end"].cast("string"),
            ),
        ),
    )


def scan(df: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, found, spans and counts for every row of (doc_id, text).

    `found` is an array of (start, no, end): code points, end exclusive, `no` counting KINDS from 1.
    A NULL text is an empty one; both have no finds. Equal rows have equal results. An empty table
    gives an empty result, other columns are ignored. Finds of one kind are leftmost and do not
    overlap; finds of different kinds may.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = cut(df.select("doc_id", _key(text).alias("key")))
    texts = cut(
        df.select(text.alias("text"))
        .withColumn("key", _key(F.col("text")))
        .where(F.col("key").isNotNull())
        .groupBy("key")
        .agg(F.first("text").alias("text"))
    )
    nothing = "array<struct<start:bigint,no:int,end:bigint>>"
    clean = keyed.where(F.col("key").isNull()).select(
        "doc_id", F.array().cast(nothing).alias("found")
    )
    told = keyed.where(F.col("key").isNotNull()).join(_by_text(texts, scope), "key", "left")
    found = clean.unionByName(
        told.select("doc_id", F.coalesce("found", F.array().cast(nothing)).alias("found"))
    )
    count = lambda no: F.size(F.filter("found", lambda x: x["no"] == no)).cast("long")
    base = F.filter("found", lambda x: x["no"] <= len(LEAST))
    return found.select(
        "doc_id",
        "found",
        count(1).alias("n_assign"),
        count(2).alias("n_access"),
        count(3).alias("n_hex"),
        F.sha2(_marks(base), 256).alias("base_sha256"),
        _marks(F.col("found")).alias("spans"),
    )


def redacted(df: DataFrame, mark: str = "[secret]", scope: int = SCOPE) -> DataFrame:
    """The rows with every find replaced by the mark; overlapping finds give one mark.

    A column n_chars is counted anew for texts that were searched, other columns stay as they are.
    NULL texts and texts without finds are unchanged.
    """
    key = _key(F.col("text"))
    texts = cut(
        df.select("text")
        .where(key.isNotNull())
        .groupBy(key.alias("key"))
        .agg(F.first("text").alias("text"))
    )
    # per text the pieces between finds: sorted by start, a find hides what lies before its end
    seen = F.struct(F.lit(0).cast("long").alias("end"), F.lit("").alias("done"))
    step = lambda acc, x: F.struct(
        F.greatest(acc["end"], x["end"]).alias("end"),
        F.when(x["start"] < acc["end"], acc["done"])
        .otherwise(
            F.concat(
                acc["done"],
                F.substring(
                    F.col("text"), (acc["end"] + 1).cast("int"), (x["start"] - acc["end"]).cast("int")
                ),
                F.lit(mark),
            )
        )
        .alias("done"),
    )
    rest = lambda acc: F.concat(
        acc["done"],
        F.substring(F.col("text"), (acc["end"] + 1).cast("int"), F.length("text")),
    )
    cleaned = (
        _by_text(texts, scope)
        .join(texts, "key")
        .select("key", F.aggregate("found", seen, step, rest).alias("_cleaned"))
    )
    told = df.where(key.isNotNull())
    changed = told.join(
        cleaned.select(F.col("key").alias("_found_key"), "_cleaned"),
        _key(told["text"]) == F.col("_found_key"),
        "left",
    )
    text = F.coalesce("_cleaned", told["text"])
    new = {"text": text.alias("text"), "n_chars": F.length(text).cast("long").alias("n_chars")}
    kept = [new.get(c, told[c]) for c in df.columns]
    return df.where(key.isNull()).unionByName(changed.select(*kept))
