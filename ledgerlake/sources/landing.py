"""Audit of landed files: what should be there, what is there, and whether it is whole.

Everything works on small listings (one row per monthly source), never on file contents.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from string import Formatter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.spec import Layout

_LOOKUP_THREADS = 16
SKIP = "skip"
REFRESH = "refresh"


class MissingFilesError(FileNotFoundError):
    """Expected sources that are not in the landing area."""


class IntegrityError(ValueError):
    """Landed bytes that differ from the known total."""


def requested_grid(spark: SparkSession, partitions: Sequence[tuple[str, str]]) -> DataFrame:
    """The requested (scope, month) pairs, given as parameters, as a table."""
    return spark.createDataFrame(list(partitions), "scope string, month string")


def month_grid(bounds: DataFrame, first: str, last: str) -> DataFrame:
    """Every month between two ``yyyy-MM`` columns, for each row of ``bounds``."""

    def start(column: str) -> Column:
        return F.to_date(F.concat(F.col(column), F.lit("-01")))

    every_month = F.sequence(start(first), start(last), F.expr("INTERVAL '1' MONTH"))
    return bounds.select("scope", F.explode(every_month).alias("_first_day")).select(
        "scope", F.date_format("_first_day", "yyyy-MM").alias("month")
    )


def manifest(grid: DataFrame, layout: Layout, root: str) -> DataFrame:
    """Expected files: scope, month, file, path."""
    values = {
        "scope": F.col("scope"),
        "month": F.col("month"),
        "year": F.substring("month", 1, 4),
        "root": F.lit(root.rstrip("/")),
    }
    values["file"] = _filled(layout.file, values)
    return grid.select(
        "scope", "month", values["file"].alias("file"), _filled(layout.path, values).alias("path")
    )


def _filled(template: str, values: dict[str, Column]) -> Column:
    parts = []
    for text, name, _, _ in Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name:
            parts.append(values[name])
    return F.concat(*parts)


def listing(spark: SparkSession, root: str | list[str]) -> DataFrame:
    """Path and size of each file below ``root``, or below several. The contents are not read.

    A file of zero bytes is not listed, so it counts as absent: there is nothing in it to load.
    Listed sizes would spread the files over one task per 128 MB although only file status is
    looked up, so the listing is packed into a few tasks.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", "length").coalesce(spark.sparkContext.defaultParallelism)


def requested_listing(spark: SparkSession, expected: DataFrame) -> DataFrame:
    """The same for the paths of a manifest only, wherever else files lie below the root.

    The driver asks once for each requested path whether it is there; Spark lists what lies below
    them, as a distributed job where they are many.
    """
    paths = [row["path"] for row in expected.select("path").distinct().collect()]

    def there(path: str) -> bool:
        hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)

    with ThreadPoolExecutor(_LOOKUP_THREADS) as pool:
        found = sorted(p for p, is_there in zip(paths, pool.map(there, paths), strict=True) if is_there)
    if not found:
        return spark.createDataFrame([], "path string, length long")
    return listing(spark, found)


def source_sizes(files: DataFrame, layout: Layout) -> DataFrame:
    """Bytes per landed source, adding up the part files of a folder."""
    pattern = layout.pattern()
    return (
        files.select(
            F.regexp_extract("path", pattern, 1).alias("scope"),
            F.regexp_extract("path", pattern, 2).alias("month"),
            "length",
        )
        .filter(F.col("month") != "")
        .groupBy("scope", "month")
        .agg(F.sum("length").alias("local_bytes"))
    )


def inventory(expected: DataFrame, sizes: DataFrame) -> DataFrame:
    """Expected files with their size; NULL where the file is absent."""
    return expected.join(sizes, ["scope", "month"], "left")


def missing(expected: DataFrame, sizes: DataFrame) -> DataFrame:
    """Expected files that are absent."""
    return expected.join(sizes, ["scope", "month"], "left_anti")


def require_all(expected: DataFrame, sizes: DataFrame) -> None:
    """Raise before any write when an expected source is absent. The list is one row per source."""
    absent = sorted(row["path"] for row in missing(expected, sizes).select("path").collect())
    if absent:
        raise MissingFilesError(f"{len(absent)} expected source(s) missing: " + ", ".join(absent))


def refresh_decisions(files: DataFrame, local: str, expected: str) -> DataFrame:
    """Skip only what has a known size equal to the known expected size."""
    same = F.coalesce(F.col(local) == F.col(expected), F.lit(False))
    return files.withColumn("status", F.when(same, SKIP).otherwise(REFRESH))


def integrity(files: DataFrame, totals: DataFrame, full_scope: bool = True) -> DataFrame:
    """Whether each scope is whole: full scope, nothing absent, bytes equal to the known total.

    ``files`` has (scope, month, local_bytes), ``totals`` has (scope, expected_bytes). A scope
    without files or without a known total is not whole.
    """
    found = files.groupBy("scope").agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col("local_bytes").isNull()).alias("missing_files"),
        F.sum("local_bytes").alias("local_bytes"),
    )
    whole = (
        F.lit(full_scope)
        & (F.col("files") > 0)
        & (F.col("missing_files") == 0)
        & (F.col("local_bytes") == F.col("expected_bytes"))
    )
    return found.join(totals, "scope", "full").select(
        "scope",
        F.coalesce("files", F.lit(0)).alias("files"),
        F.coalesce("missing_files", F.lit(0)).alias("missing_files"),
        "local_bytes",
        "expected_bytes",
        F.coalesce(whole, F.lit(False)).alias("intact"),
    )


def landing_intact(checked: DataFrame) -> bool:
    """Verdict over all scopes of ``integrity``; an empty landing is not whole."""
    row = checked.agg(F.every("intact").alias("all_intact")).first()
    return bool(row["all_intact"])


def require_intact(checked: DataFrame) -> None:
    """Raise when a scope of ``integrity`` is not whole. At most one row per scope is read."""
    broken = [row.asDict() for row in checked.filter(~F.col("intact")).collect()]
    if broken:
        raise IntegrityError("; ".join(map(str, broken)))


def outcome_summary(decided: DataFrame, local: str) -> DataFrame:
    """Files and bytes by decision."""
    return decided.groupBy("status").agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(local), F.lit(0)).alias("bytes")
    )
