"""Proportional stratified interleaving: every shard gets the mixture of the whole.

Rows of a stratum are put in a seeded random order. Rank r of n becomes the fraction (r + u) / n, where u
is drawn for each stratum from [0, 1), all rows are sorted by fraction, and the sorted sequence is cut
into shards of equal row counts. A run of consecutive rows then holds each stratum in proportion, up to
one row for each stratum that its bounds cut; as every stratum has its own u, these odd rows, and
strata of a row or two, spread evenly over all shards.

Ranks come without sorting a stratum in one task: the order key is a hash, its leading bits are a
bucket of some thousand rows, and a rank is the rows of earlier buckets plus the rank inside the own
bucket. Only counts per bucket are summed up, in two levels, so that no task sees more than about
the square root of the number of buckets. A source holding a third of all rows is just more buckets.
Equal rows are counted first and then numbered, so copies of one row spread over buckets too.
Only ids, sizes and checksums are shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.tables import cut

SHARDS = 40
SEED = 20240229
BUCKET_ROWS = 4096
OVERHEAD = 16
#: Copies of one row that a task numbers at a time.
COPIES = 4096


def _rows_before(counts: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """Adds to (keys, bucket, rows): rows in earlier buckets of the same keys, and in all."""
    parts = counts.withColumn("_part", F.shiftright("bucket", bits // 2))
    inside = Window.partitionBy(*keys, "_part").orderBy("bucket")
    across = Window.partitionBy(*keys).orderBy("_part")
    totals = (
        parts.groupBy(*keys, "_part")
        .agg(F.sum("rows").alias("_in_part"))
        .withColumn("_earlier", F.sum("_in_part").over(across) - F.col("_in_part"))
        .withColumn("total", F.sum("_in_part").over(Window.partitionBy(*keys)))
    )
    return (
        parts.withColumn("_inside", F.sum("rows").over(inside) - F.col("rows"))
        .join(totals, [*keys, "_part"])
        .select(*keys, "bucket", (F.col("_inside") + F.col("_earlier")).alias("before"), "total")
    )


def _rank(rows: DataFrame, keys: list[str], bits: int, order: list[Column]) -> DataFrame:
    """Adds `rank` from 0 in the given order, and `total`. `bucket` must follow that order."""
    counts = rows.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("rows"))
    inside = Window.partitionBy(*keys, "bucket").orderBy(*order)
    return (
        rows.withColumn("_in", F.row_number().over(inside) - 1)
        .join(_rows_before(counts, keys, bits), [*keys, "bucket"])
        .withColumn("rank", F.col("before") + F.col("_in"))
        .drop("before", "_in", "bucket")
    )


def _unit(*columns: Column) -> Column:
    """A number of [0, 1) drawn by hash."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") / float(1 << 53)


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds `copy`, from 0, to tell equal rows apart; a row with very many copies is dealt over tasks."""
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_copies"))
    runs = counted.withColumn("_run", F.explode(F.expr(f"sequence(0, (_copies - 1) div {COPIES})")))
    return (
        runs.repartition(*rows.columns, "_run")
        .withColumn(
            "copy",
            F.explode(F.expr(f"sequence(_run * {COPIES}, least(_copies, (_run + 1) * {COPIES}) - 1)")),
        )
        .drop("_copies", "_run")
    )


def interleave(
    df: DataFrame,
    shards: int = SHARDS,
    stratum: str = "source",
    seed: int = SEED,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """doc_id, stratum_key, size, text_crc32, shard, slot for every row of (doc_id, text, stratum).

    Shards are numbered from 0, slots count from 0 inside a shard without gaps, and row counts of
    shards differ by one at most. A NULL stratum is a stratum of its own. A NULL text has no bytes
    and the checksum of the empty text. Equal rows are separate rows and get separate slots. An empty table gives an empty result. Other columns,
    whatever their names, are ignored.
    """
    named = F.col(stratum).cast("string")
    text = F.coalesce(F.col("text"), F.lit(""))
    measured = df.select(
        F.col("doc_id"),
        F.when(named.isNull(), "none").otherwise(F.concat(F.lit("="), named)).alias("stratum_key"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = cut(
        _numbered(measured).withColumn(
            "shuffled",
            F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size", "copy"), 1),
        )
    )
    n = rows.count()
    bits = max(0, (n // bucket_rows).bit_length())
    own = ["shuffled", "doc_id", "text_crc32", "size", "copy"]
    ranked = _rank(
        rows.withColumn("bucket", F.shiftright("shuffled", 63 - bits)),
        ["stratum_key"],
        bits,
        [F.col(c) for c in own],
    )
    fraction = (F.col("rank") + _unit(F.lit(seed), F.col("stratum_key"))) / F.col("total")
    spread = ranked.withColumn("fraction", fraction).drop("rank", "total")
    spread = spread.withColumn(
        "bucket", F.least(F.floor(F.col("fraction") * (1 << bits)), F.lit((1 << bits) - 1))
    )
    placed = _rank(
        spread.withColumn("_all", F.lit(0)),
        ["_all"],
        bits,
        [F.col(c) for c in ["fraction", "stratum_key", *own]],
    )
    shard = F.expr(f"rank * {shards} div {max(n, 1)}")
    first = F.expr(f"(shard * {n} + {shards - 1}) div {shards}")
    return (
        placed.withColumn("shard", shard)
        .withColumn("slot", F.col("rank") - first)
        .select("doc_id", "stratum_key", "size", "text_crc32", F.col("shard").cast("int"), "slot")
    )
