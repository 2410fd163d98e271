"""Incremental arrival: new files of the landing folder, each source of which is loaded anew.

The file source of Structured Streaming remembers in its checkpoint which files it has seen. A
triggered run takes all new ones, finds the (scope, month) sources they belong to, and loads these as
a whole; other partitions are neither read nor written. A batch that is repeated after a failure
replaces the same partitions by the same rows, so every file counts once.

A source that is published again must come as new files, as writers of part files give it; one file
overwritten under its old name is not seen as new. Only names and sizes pass through the stream.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ledgerlake.plans import batch
from ledgerlake.spec import Dataset

#: What the binary file source calls its columns; its schema is fixed.
_FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving_files(spark: SparkSession, landing_root: str, files_per_batch: int = 0) -> DataFrame:
    """Stream of (path, length) of files below the root."""
    reader = spark.readStream.format("binaryFile").schema(_FILES)
    reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(landing_root).select("path", "length")


def touched_sources(files: DataFrame, dataset: Dataset) -> list[batch.Partition]:
    """The declared sources that some files belong to; other files are left alone."""
    pattern = dataset.layout.pattern()
    found = (
        files.select(
            F.regexp_extract("path", pattern, 1).alias("scope"),
            F.regexp_extract("path", pattern, 2).alias("month"),
        )
        .filter(F.col("scope").isin(list(dataset.sources)) & (F.col("month") != ""))
        .distinct()
        .collect()
    )
    return sorted((row["scope"], row["month"]) for row in found)


def load_arrivals(
    spark: SparkSession,
    dataset: Dataset,
    landing_root: str,
    warehouse: batch.Warehouse,
    checkpoint: str,
    files_per_batch: int = 0,
    run_ts: datetime | None = None,
    loaded: Callable[[int, list[batch.Partition]], None] | None = None,
) -> StreamingQuery:
    """Loads what has arrived since the last call, and ends; ``awaitTermination`` tells of failures.

    ``loaded`` is told each batch and its sources.
    """
    batch_of = arriving_files(spark, landing_root, files_per_batch)

    def take(files: DataFrame, number: int) -> None:
        sources = touched_sources(files, dataset)
        # the session of the stream, so that its settings hold
        batch.load(files.sparkSession, dataset, landing_root, warehouse, sources, run_ts)
        if loaded:
            loaded(number, sources)

    return (
        batch_of.writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
