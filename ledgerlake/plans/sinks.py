"""Writing tables: partition overwrite that can be repeated, full overwrite, published views."""

from __future__ import annotations

import re
import threading
from collections.abc import Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Target = tuple[str | None, ...]
_LOOKUP_THREADS = 16
_OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"
#: By Spark's defaults a split packs at most 32 files, each of one partition with two outcomes.
_MOST_OPEN_FILES = 64
_writing: dict[SparkSession, int] = {}
_writing_lock = threading.Lock()


class EmptyTargetError(ValueError):
    """A partition that was to be replaced got no rows."""


def is_target(columns: Sequence[str], targets: Sequence[Target]) -> Column:
    """Whether the columns hold one of the listed values; a NULL is a value like others."""

    def row(values: Sequence[Column]) -> Column:
        return F.struct(*(v.cast("string").alias(f"v{i}") for i, v in enumerate(values)))

    return row([F.col(c) for c in columns]).isin([row([F.lit(v) for v in t]) for t in targets])


def only_targets(df: DataFrame, columns: Sequence[str], targets: Sequence[Target]) -> DataFrame:
    """``df`` itself, failing at run time on a row outside the listed partitions.

    The check is part of the value of a partition column, which only the writer asks for: a filter
    could be moved below a join and then fail on rows that the join removes.
    """
    first = columns[0]
    told = F.concat_ws("/", *(F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in columns))
    outside = F.raise_error(F.concat(F.lit("row outside the target partitions: "), told))
    kind = df.schema[first].dataType
    return df.withColumn(
        first, F.when(is_target(columns, targets), F.col(first)).otherwise(outside.cast(kind))
    )


@contextmanager
def open_side_by_side(spark: SparkSession) -> Iterator[None]:
    """Writes by partition without a sort: a task keeps a file open for each partition it meets.

    Spark otherwise sorts all rows of a split by partition, whose memory and spill follow the width
    of the rows and not the bytes written. Rows of partitions beyond the number of open files are
    sorted as before. A number that the session has set itself stays.
    """
    with _writing_lock:
        own = spark in _writing or int(spark.conf.get(_OPEN_FILES)) <= 0
        if own:
            _writing[spark] = _writing.get(spark, 0) + 1
            spark.conf.set(_OPEN_FILES, str(_MOST_OPEN_FILES))
    try:
        yield
    finally:
        # the last of several writes side by side takes the setting back
        with _writing_lock:
            if own:
                _writing[spark] -= 1
                if not _writing[spark]:
                    del _writing[spark]
                    spark.conf.unset(_OPEN_FILES)


def write_partitions(
    df: DataFrame,
    path: str,
    partition_cols: Sequence[str],
    targets: Sequence[Target],
    when_empty: str = "delete",
    rebalance: bool = False,
) -> None:
    """Replace exactly the target partitions and leave all others as they are; no targets, no change.

    For folders that no catalog knows. A run that breaks off between the write and the removal
    of emptied targets leaves old rows in these: tables are better kept as a ``stores.Store``.

    ``targets`` hold values of the leading partition columns. A target that gets no rows loses
    its old ones (or raises, with ``when_empty="raise"``). Dynamic overwrite is asked for on a
    path write: ``insertInto`` would ignore the option and replace the whole table.

    Rows are written where they are read, without a shuffle or a sort. ``rebalance`` adds a shuffle
    for inputs whose rows are not grouped by partition; it splits partitions that are too large.
    """
    if not targets:
        return
    spark = df.sparkSession
    before = _one_file_per_leaf(spark, path, partition_cols, targets)
    guarded = only_targets(df, partition_cols[: len(targets[0])], targets)
    if rebalance:
        guarded = guarded.hint("rebalance", *partition_cols)
    with open_side_by_side(spark):
        (
            guarded.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*partition_cols)
            .parquet(path)
        )
    # A rewritten leaf has only new files, so one old file left means it got no rows.
    stale = [leaf for leaf, file in before.items() if _exists(spark, file)]
    if stale and when_empty == "raise":
        raise EmptyTargetError("no rows for: " + ", ".join(sorted(stale)))
    for leaf in stale:
        delete(spark, leaf)


def overwrite(df: DataFrame, path: str) -> None:
    """Replace rows and schema of an unpartitioned table."""
    df.write.mode("overwrite").parquet(path)


def overwrite_table(df: DataFrame, name: str, path: str) -> None:
    """Replace rows and schema of a catalog table kept at ``path``."""
    df.write.mode("overwrite").option("path", path).saveAsTable(name)


def create_schema(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {name}")


def register_table(
    spark: SparkSession, name: str, path: str, ddl: str, partition_cols: Sequence[str]
) -> None:
    """Catalog table over partitioned files, with declared types and the partitions now there.

    A table of that name that lies elsewhere raises: its files would be read instead.
    """
    partitioning = ", ".join(partition_cols)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({ddl}) USING parquet "
        f"PARTITIONED BY ({partitioning}) LOCATION '{path}'"
    )
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").filter("col_name = 'Location'")
    location = described.first()["data_type"]
    if without_scheme(location) != without_scheme(path):
        raise ValueError(f"table {name} already lies in {location}, not in {path}")
    spark.sql(f"MSCK REPAIR TABLE {name} SYNC PARTITIONS")
    spark.catalog.refreshTable(name)


def publish_view(
    spark: SparkSession, name: str, query: str, comments: Mapping[str, str] | None = None
) -> None:
    """Create or replace a saved query; ``comments`` maps its columns to descriptions."""
    columns = ""
    if comments:
        described = ", ".join(f"`{c}` COMMENT '{quoted(text)}'" for c, text in comments.items())
        columns = f" ({described})"
    spark.sql(f"CREATE OR REPLACE VIEW {name}{columns} AS {query}")


def views_in(spark: SparkSession, schema: str) -> DataFrame:
    return spark.sql(f"SHOW VIEWS IN {schema}")


def quoted(text: str) -> str:
    """Text for a SQL literal in single quotes."""
    return text.replace("\\", "\\\\").replace("'", "\\'")


def without_scheme(path: str) -> str:
    return re.sub(r"^[a-z0-9]+:/*", "/", path).rstrip("/").replace("//", "/")


# --- file system, through the session's own Hadoop client -----------------------------------


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def _exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = _file_system(spark, path)
    return fs.exists(hadoop_path)


def delete(spark: SparkSession, path: str) -> None:
    fs, hadoop_path = _file_system(spark, path)
    fs.delete(hadoop_path, True)


def delete_if_empty(spark: SparkSession, path: str, below: str) -> None:
    """Deletes folders without content, from the given one up, as far as they lie below another."""
    while without_scheme(path).startswith(without_scheme(below) + "/"):
        fs, hadoop_path = _file_system(spark, path)
        if fs.exists(hadoop_path) and len(fs.listStatus(hadoop_path)):
            return
        fs.delete(hadoop_path, False)
        path = path.rpartition("/")[0]


def folders_in(spark: SparkSession, path: str, prefix: str) -> list[str]:
    fs, hadoop_path = _file_system(spark, path)
    if not fs.exists(hadoop_path):
        return []
    found = (s.getPath() for s in fs.listStatus(hadoop_path))
    return [p.toString() for p in found if p.getName().startswith(prefix)]


def unescaped(spark: SparkSession):
    """What turns a partition value in the name of a folder back into the value."""
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName


def leaf_folders(spark: SparkSession, folder: str, levels: int) -> dict[tuple[str, ...], str]:
    """Folders that many levels below, by the names on the way. One listing per folder."""
    level = {(): folder}
    for _ in range(levels):
        with ThreadPoolExecutor(_LOOKUP_THREADS) as pool:
            below = pool.map(lambda item: (item[0], folders_in(spark, item[1], "")), level.items())
            level = {
                (*way, path.rpartition("/")[2]): path
                for way, paths in below
                for path in paths
                if "=" in path.rpartition("/")[2]
            }
    return level


def _one_file_per_leaf(
    spark: SparkSession, path: str, partition_cols: Sequence[str], targets: Sequence[Target]
) -> dict[str, str]:
    """Leaf folders below the targets, each with one of its data files, looked up side by side."""
    # the names that Spark gives to folders, with its escapes and its name for NULL
    named = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils

    def look_up(target: Target) -> dict[str, str]:
        found: dict[str, str] = {}
        parts = zip(partition_cols, target, strict=False)
        folder = "/".join(named.getPartitionPathString(c, v) for c, v in parts)
        _collect_leaves(spark, f"{path}/{folder}", len(partition_cols) - len(target), found)
        return found

    with ThreadPoolExecutor(_LOOKUP_THREADS) as pool:
        return {k: v for found in pool.map(look_up, targets) for k, v in found.items()}


def _collect_leaves(spark: SparkSession, folder: str, levels: int, found: dict[str, str]) -> None:
    fs, hadoop_path = _file_system(spark, folder)
    if not fs.exists(hadoop_path):
        return
    # an iterator: one file of a leaf is enough, however many there are
    statuses = fs.listStatusIterator(hadoop_path)
    while statuses.hasNext():
        status = statuses.next()
        name = status.getPath().getName()
        if levels == 0 and not name.startswith(("_", ".")):
            found[folder] = status.getPath().toString()
            return
        if levels > 0 and "=" in name:
            _collect_leaves(spark, f"{folder}/{name}", levels - 1, found)
