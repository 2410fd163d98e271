"""Reading monthly sources whose schemas drift.

Schemas are never merged. The footers of all files are read on the executors and grouped by distinct
schema; a folder whose files differ is several sources, each checked and read with its own schema.
Sources that share scope and physical schema are then read by one scan, so the plan grows with the
number of schema variants and not with the number of files.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlake.spec import Dataset, Layout

_FOOTER_THREADS = 16
#: Schemes that Arrow opens by itself; other stores are looked up by Spark, a file at a time.
_ARROW_SCHEMES = {"": "", "file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "gs": "gs"}


@dataclass(frozen=True)
class LandedSource:
    """Files of one (scope, month) with the same schema: the whole path, or the listed files of it."""

    scope: str
    month: str
    path: str
    schema: StructType
    files: tuple[str, ...] = ()

    @property
    def paths(self) -> tuple[str, ...]:
        return self.files or (self.path,)


def _arrow_uri(path: str) -> str | None:
    scheme, _, rest = path.partition(":")
    if not rest or "/" in scheme:
        return "file://" + path
    known = _ARROW_SCHEMES.get(scheme)
    return f"{known}:///{rest.lstrip('/')}" if known == "file" else known and f"{known}:{rest}"


def _described(path: str) -> str:
    """Names and physical types of a Parquet file, from its footer."""
    filesystem, inside = pa.fs.FileSystem.from_uri(_arrow_uri(path))
    schema = pq.ParquetFile(inside, filesystem=filesystem).schema
    columns = (schema.column(i) for i in range(len(schema)))
    return "; ".join(f"{c.path} {c.physical_type} {c.logical_type}" for c in columns)


def _footers(spark: SparkSession, dataset: Dataset, paths: Sequence[str]) -> DataFrame:
    """scope, month, path, footer of every file below the paths, looked up on the executors."""
    pattern = dataset.layout.pattern()

    def describe(batches):
        for batch in batches:
            footer = [_described(path) for path in batch["path"].to_pylist()]
            yield batch.append_column("footer", pa.array(footer, pa.string()))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    return files.select(
        F.regexp_extract("path", pattern, 1).alias("scope"),
        F.regexp_extract("path", pattern, 2).alias("month"),
        "path",
    ).mapInArrow(describe, "scope string, month string, path string, footer string")


def landed_sources(
    spark: SparkSession,
    dataset: Dataset,
    root: str,
    partitions: Iterable[tuple[str, str]],
) -> list[LandedSource]:
    """The requested (scope, month) sources, once per distinct schema among their files.

    The driver gets one row per source and distinct schema, and file names only of sources whose
    files differ.
    """
    wanted = {(s, m): dataset.layout.source_path(root, s, m) for s, m in partitions}
    if not wanted:
        return []
    if _arrow_uri(root) is None:
        return _one_by_one(spark, wanted)
    footers = _footers(spark, dataset, sorted(wanted.values())).cache()
    try:
        kinds = footers.groupBy("scope", "month", "footer").agg(F.min("path").alias("path")).collect()
        schemas: dict[tuple[str, str], list] = {}
        for kind in kinds:
            schemas.setdefault((kind["scope"], kind["month"]), []).append(kind)
        mixed = {key for key, found in schemas.items() if len(found) > 1}
        files: dict[tuple[str, str, str], list[str]] = {}
        if mixed:
            listed = F.struct("scope", "month").isin(
                [F.struct(F.lit(s).alias("scope"), F.lit(m).alias("month")) for s, m in mixed]
            )
            for row in footers.filter(listed).collect():
                files.setdefault((row["scope"], row["month"], row["footer"]), []).append(row["path"])
    finally:
        footers.unpersist()

    def look_up(kind) -> LandedSource:
        key = (kind["scope"], kind["month"])
        own = tuple(sorted(files.get((*key, kind["footer"]), ())))
        return LandedSource(*key, wanted[key], spark.read.parquet(kind["path"]).schema, own)

    chosen = [k for key in wanted for k in sorted(schemas.get(key, ()), key=lambda k: k["footer"])]
    with ThreadPoolExecutor(_FOOTER_THREADS) as pool:
        return list(pool.map(look_up, chosen))


def _one_by_one(spark: SparkSession, wanted: dict[tuple[str, str], str]) -> list[LandedSource]:
    """The same for stores that only Spark opens: each file's schema is asked for by itself."""

    def look_up(item) -> list[LandedSource]:
        (scope, month), path = item
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        kinds: dict[str, tuple[StructType, list[str]]] = {}
        for file in sorted(r["path"] for r in listed.select("path").collect()):
            schema = spark.read.parquet(file).schema
            kinds.setdefault(schema.json(), (schema, []))[1].append(file)
        return [
            LandedSource(scope, month, path, schema, tuple(files) if len(kinds) > 1 else ())
            for schema, files in kinds.values()
        ]

    with ThreadPoolExecutor(_FOOTER_THREADS) as pool:
        return [source for found in pool.map(look_up, wanted.items()) for source in found]


@dataclass(frozen=True)
class Variant:
    """Sources of one scope that share a physical schema and a spelling of the columns."""

    scope: str
    spelling: tuple[tuple[str, str], ...]
    schema: StructType
    sources: tuple[LandedSource, ...]

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(*(p for s in self.sources for p in s.paths))


def file_month(layout: Layout) -> Column:
    """Month in the path of the file a row was read from.

    Evaluated for every row, so the text before the month is searched for; the regular
    expression of the layout costs about as much as decoding the row.
    """
    path = F.col("_metadata.file_path")
    marker = layout.month_marker()
    if marker is None:
        return F.regexp_extract(path, layout.pattern(), 2)
    return F.substring(F.substring_index(path, marker, -1), 1, len("yyyy-MM"))


def variants(sources: Sequence[LandedSource], dataset: Dataset) -> list[Variant]:
    groups: dict[tuple, list[LandedSource]] = {}
    for source in sources:
        spelling = dataset.source(source.scope).spelling(source.month, dataset.table)
        key = (source.scope, tuple(spelling.items()), source.schema.json())
        groups.setdefault(key, []).append(source)
    return [
        Variant(scope, spelling, members[0].schema, tuple(members))
        for (scope, spelling, _), members in groups.items()
    ]
