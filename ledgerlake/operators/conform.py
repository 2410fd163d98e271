"""Turning drifting sources into one canonical table, keeping every row."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlake.sources.files import LandedSource, file_month, variants
from ledgerlake.spec import Dataset, SourceSpec, TableSpec

UNEXPECTED = "unexpected"
MISSING = "missing"


class DriftError(ValueError):
    """A source whose columns are not the declared ones."""


def column_drift(
    columns: Iterable[str], source: SourceSpec, month: str, table: TableSpec
) -> list[tuple[str, str]]:
    """Columns that differ from the declared set, letter case included, as (column, kind)."""
    found, declared = set(columns), set(source.spelling(month, table).values())
    return [(c, UNEXPECTED) for c in sorted(found - declared)] + [
        (c, MISSING) for c in sorted(declared - found)
    ]


def drift_rows(sources: Iterable[LandedSource], dataset: Dataset) -> list[tuple[str, ...]]:
    return [
        (s.scope, s.month, s.path, column, kind)
        for s in sources
        for column, kind in column_drift(
            s.schema.names, dataset.source(s.scope), s.month, dataset.table
        )
    ]


def drift_report(
    spark: SparkSession, sources: Iterable[LandedSource], dataset: Dataset
) -> DataFrame:
    """One row per column that is unexpected in a source or missing from it."""
    return spark.createDataFrame(
        drift_rows(sources, dataset),
        "scope string, month string, path string, column_name string, kind string",
    )


def require_no_drift(sources: Sequence[LandedSource], dataset: Dataset) -> None:
    drift = drift_rows(sources, dataset)
    if drift:
        listed = "; ".join(f"{path}: {kind} column {column}" for _, _, path, column, kind in drift)
        raise DriftError(f"columns differ from the declared set: {listed}")


def rename(df: DataFrame, source: SourceSpec, month: str, table: TableSpec) -> DataFrame:
    """Canonical names for the columns a source spells differently."""
    spelled = {raw: name for name, raw in source.spelling(month, table).items() if raw != name}
    return df.withColumnsRenamed({raw: n for raw, n in spelled.items() if raw in df.columns})


def fill_absent(df: DataFrame, source: SourceSpec, table: TableSpec) -> DataFrame:
    """Typed NULL for the canonical columns a source does not have."""
    return df.withColumns({c: F.lit(None).cast(table.columns[c]) for c in source.absent})


def strict_cast(name: str, to_type: str, schema: StructType, alias: str | None = None) -> Column:
    """Cast that fails on overflow in every session, ANSI mode or not."""
    column = F.col(f"`{name}`")
    if schema[name].dataType.simpleString() == to_type:
        return column.alias(alias or name)
    tried = column.try_cast(to_type)
    broken = F.raise_error(
        F.concat(F.lit(f"{name} does not fit {to_type}: "), column.cast("string"))
    ).cast(to_type)
    fits = tried.isNotNull() | column.isNull()
    return F.when(fits, tried).otherwise(broken).alias(alias or name)


def canonical_cast(df: DataFrame, table: TableSpec) -> DataFrame:
    """Declared types for the canonical data columns, in canonical order."""
    return df.select(
        *(strict_cast(c, t, df.schema) for c, t in table.columns.items()),
        *(F.col(c) for c in df.columns if c not in table.columns),
    )


def conform(
    df: DataFrame,
    source: SourceSpec,
    table: TableSpec,
    spelling: dict[str, str],
    month: Column,
) -> DataFrame:
    """Renames, typed NULLs, casts, lineage and column order in one projection."""
    data = [
        strict_cast(spelling[name], to_type, df.schema, alias=name)
        if name in spelling
        else F.lit(None).cast(to_type).alias(name)
        for name, to_type in table.columns.items()
    ]
    return df.select(
        *data,
        F.lit(source.name).alias(table.scope),
        month.alias(table.month),
        F.current_timestamp().alias(table.loaded_at),
    )


def conform_sources(
    spark: SparkSession, sources: Sequence[LandedSource], dataset: Dataset
) -> DataFrame:
    """Union of all sources by name: no row filtered, no duplicate removed."""
    require_no_drift(sources, dataset)
    parts = []
    for variant in variants(sources, dataset):
        only_month = variant.sources[0].month if len(variant.sources) == 1 else None
        month = F.lit(only_month) if only_month else file_month(dataset.layout)
        parts.append(
            conform(
                variant.read(spark),
                dataset.source(variant.scope),
                dataset.table,
                dict(variant.spelling),
                month,
            )
        )
    return reduce(DataFrame.unionByName, parts)


def partition_counts(df: DataFrame, table: TableSpec, name: str = "linhas") -> DataFrame:
    """Rows per scope and file month. On the partitioned table this reads footers only."""
    return df.groupBy(table.scope, table.month).agg(F.count(F.lit(1)).alias(name))


def total_count(df: DataFrame, name: str = "linhas") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def exclusive_columns(
    df: DataFrame, sources: Iterable[SourceSpec], table: TableSpec, name: str = "linhas"
) -> DataFrame:
    """Rows where a source carries a value in a column it must not have; 0 when conformed."""
    wrong = reduce(
        lambda a, b: a | b,
        (
            (F.col(table.scope) == s.name) & F.col(column).isNotNull()
            for s in sources
            for column in s.absent
        ),
    )
    return df.agg(F.count_if(wrong).alias(name))
