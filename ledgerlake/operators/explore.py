"""Exploration of a table: checks, summaries and percentiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    DataType,
    DecimalType,
    DoubleType,
    IntegralType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from ledgerlake.operators import selection
from ledgerlake.spec import Check


def run_checks(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """Every check in a single scan: (check, observed, expected, confirmed)."""
    row = df.agg(*(F.expr(c.observed_sql).alias(f"_{i}") for i, c in enumerate(checks)))
    verdicts = [
        F.struct(
            F.lit(c.name).alias("check"),
            F.col(f"_{i}").cast("string").alias("observed"),
            F.lit(c.expected).alias("expected"),
            F.coalesce(c.holds(F.col(f"_{i}")), F.lit(False)).alias("confirmed"),
        )
        for i, c in enumerate(checks)
    ]
    return row.select(F.inline(F.array(*verdicts)))


def exact_percentiles(
    df: DataFrame, by: Sequence[str], wanted: Mapping[str, Sequence[float]]
) -> DataFrame:
    """(by.., column_name, fraction, value): exact at every size, for `by` of few values.

    See ``selection.select_ranks``. Columns of one type keep it; whole numbers of several types come
    as longs, any others together as doubles.
    """
    types = [df.schema[c].dataType for c in wanted]
    if len(set(types)) == 1:
        value_type = types[0]
    else:
        value_type = LongType() if all(isinstance(t, IntegralType) for t in types) else DoubleType()
    found = selection.select_ranks(df, by, wanted).values
    told = float if isinstance(value_type, DoubleType) else lambda v: v
    rows = [
        (*group, column, fraction, told(value))
        for group, values in found.items()
        for (column, fraction), value in values.items()
    ]
    schema = StructType([StructField(c, df.schema[c].dataType) for c in by])
    schema = schema.add("column_name", "string").add("fraction", "double").add("value", value_type)
    return df.sparkSession.createDataFrame(rows, schema)


_QUARTILES = {"25%": 0.25, "50%": 0.5, "75%": 0.75}


def _summary_type(kind: DataType) -> DataType:
    """Double where it holds every value exactly; else long, or a decimal that holds a count too."""
    if isinstance(kind, LongType):
        return kind
    if isinstance(kind, DecimalType):
        return DecimalType(38, min(kind.scale, 18)) if kind.precision <= 20 else kind
    return DoubleType()


def numeric_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, minimum, exact quartiles and maximum of each column: one row per statistic."""
    found = selection.select_ranks(df, [], {c: list(_QUARTILES.values()) for c in columns})
    schema = StructType([StructField("summary", StringType())])
    for c in columns:
        schema = schema.add(c, _summary_type(df.schema[c].dataType))

    def statistic(name: str, c: str):
        bounds = found.bounds[()][c]
        value = {"count": bounds.count, "min": bounds.least, "max": bounds.greatest}.get(name)
        if name in _QUARTILES:
            value = found.values[()].get((c, _QUARTILES[name]))
        kind = schema[c].dataType
        if value is None:
            return None
        return float(value) if isinstance(kind, DoubleType) else Decimal(value) if isinstance(kind, DecimalType) else value

    rows = [(s, *(statistic(s, c) for c in columns)) for s in ("count", "min", *_QUARTILES, "max")]
    return df.sparkSession.createDataFrame(rows, schema)


def percentiles(
    df: DataFrame,
    by: str,
    requested: Mapping[str, tuple[str, Sequence[float]]],
    means: Mapping[str, str],
) -> DataFrame:
    """Exact percentile arrays and plain means per group, for groups that are few.

    ``requested`` maps an output name to (column, fractions), ``means`` an output name to a column. A
    group without values has NULL in place of an array.
    """
    wanted: dict[str, list[float]] = {}
    for column, fractions in requested.values():
        wanted.setdefault(column, []).extend(f for f in fractions if f not in wanted[column])
    averages = {name: F.avg(column) for name, column in means.items()}
    found = selection.select_ranks(df, [by], wanted, averages)
    schema = StructType([StructField(by, df.schema[by].dataType)])
    for name, (column, _) in requested.items():
        schema = schema.add(name, ArrayType(df.schema[column].dataType))
    kinds = df.select(*(c.alias(n) for n, c in averages.items())).schema if averages else []
    for field in kinds:
        schema = schema.add(field)
    rows = [
        (
            *group,
            *(
                [values[column, f] for f in fractions] if (column, fractions[0]) in values else None
                for column, fractions in requested.values()
            ),
            *found.extra[group].values(),
        )
        for group, values in found.values.items()
    ]
    return df.sparkSession.createDataFrame(rows, schema)


def null_and_zero_counts(df: DataFrame, by: str, column: str) -> DataFrame:
    return df.groupBy(by).agg(
        F.count_if(F.col(column).isNull()).alias("nulls"),
        F.count_if(F.col(column) == 0).alias("zeros"),
    )


def code_matches_null(
    df: DataFrame, code_column: str, code: int, null_column: str, name: str = "mismatches"
) -> DataFrame:
    """Rows where 'has this code' and 'is NULL there' disagree; 0 when they coincide."""
    has_code = F.coalesce(F.col(code_column) == code, F.lit(False))
    return df.agg(
        F.count_if(has_code).alias("with_code"),
        F.count_if(has_code != F.col(null_column).isNull()).alias(name),
    )
