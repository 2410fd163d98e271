"""Runs a registered query in Spark and its SQL in DuckDB and compares all values."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')"
        )
    return connection


def _value(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    return value


def _rows(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_value(row[i]) for i in order) for row in rows)


def differences(spark_df, connection, sql: str) -> list[str]:
    """Empty when columns, types of the values and all rows agree exactly."""
    cursor = connection.execute(sql)
    columns = [d[0] for d in cursor.description]
    expected = _rows(columns, cursor.fetchall())
    found = _rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    problems = []
    if sorted(columns) != sorted(spark_df.columns):
        problems.append(f"columns {sorted(spark_df.columns)} != {sorted(columns)}")
    if found != expected:
        only_spark = list((found - expected).items())[:3]
        only_sql = list((expected - found).items())[:3]
        problems.append(
            f"rows {found.total()} vs {expected.total()}; spark {only_spark}; sql {only_sql}"
        )
    kinds_found = {tuple(type(v).__name__ for v in row) for row in found}
    kinds_expected = {tuple(type(v).__name__ for v in row) for row in expected}
    if not problems and kinds_found != kinds_expected:
        problems.append(f"value types {kinds_found} != {kinds_expected}")
    return problems
