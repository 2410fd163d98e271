"""Keyed comparison of two small results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    measures: Mapping[str, tuple[str, str]],
    tolerance: float,
    nulls_agree: bool = False,
) -> DataFrame:
    """Both results side by side per key: value left, value right, difference, ok.

    Keys on one side only stay in the result and are not ok; neither is a NULL measure, but for one
    that is NULL on both sides if ``nulls_agree``.
    ``measures`` maps a name to its column on the left and on the right.
    """
    a, b = left.alias("a"), right.alias("b")
    same_key = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    columns, verdicts = [], []
    for name, (left_column, right_column) in measures.items():
        x, y = F.col(f"a.{left_column}"), F.col(f"b.{right_column}")
        difference = F.abs(x - y)
        columns += [
            x.alias(f"{name}_left"),
            y.alias(f"{name}_right"),
            difference.alias(f"{name}_diff"),
        ]
        both_missing = x.isNull() & y.isNull() & F.lit(nulls_agree)
        verdicts.append(F.coalesce(difference <= tolerance, both_missing))
    ok = verdicts[0]
    for verdict in verdicts[1:]:
        ok = ok & verdict
    joined = a.join(b, same_key, "full")
    return joined.select(
        *(F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys), *columns, ok.alias("ok")
    )


class ComparisonError(AssertionError):
    """Results that should be equal and are not."""


def require_ok(compared: DataFrame, what: str, shown: int = 20) -> None:
    """Raise when a key of a comparison is not ok, naming some of these."""
    broken = compared.filter(~F.col("ok")).take(shown)
    if broken:
        raise ComparisonError(f"{what}: " + "; ".join(str(r.asDict()) for r in broken))


def fingerprint(df: DataFrame, without: Sequence[str] = ()) -> DataFrame:
    """One row (rows, added, mixed) that does not depend on the order of the rows.

    The sum and the exclusive or of two 64-bit hashes of each row, over all columns but some. Tables
    that differ in one row, or in how often it occurs, differ in it, up to chance.
    """
    columns = [F.col(f"`{c}`") for c in sorted(df.columns) if c not in without]
    # a NULL leaves the hash of a row as it is, so it is told by a flag beside the value
    told = [x for c in columns for x in (c, c.isNull())]
    first, second = F.xxhash64(*told), F.xxhash64(F.lit(1), *told)
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(first.cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)").alias("added"),
        F.coalesce(F.bit_xor(second), F.lit(0)).alias("mixed"),
    )


def volume_at_grains(
    counts: DataFrame, expected: DataFrame, scope: str, month: str, total: str
) -> DataFrame:
    """Rows per scope and month, per scope and over all, against what is expected of some of these.

    ``counts`` is (scope, month, rows), ``expected`` is (scope, month, expected) at any grain: a NULL
    month expects something of the whole scope, a NULL scope as well of all rows. Expectations need
    not add up, nor be there for each cell: where none is, the status is UNKNOWN. An expected cell
    without rows has 0. A NULL scope or month of ``counts`` is a value like others.
    """
    # cells are told apart by their grain, as NULL is a value among the finest ones
    grain = (
        F.when(F.col(scope).isNull(), 3).when(F.col(month).isNull(), 1).otherwise(0)
    )
    found = (
        counts.rollup(scope, month)
        .agg(F.grouping_id(scope, month).alias("_grain"), F.sum("rows").alias("rows"))
        .select("_grain", scope, month, "rows", F.lit(None).cast("long").alias("expected"))
    )
    asked = expected.select(
        grain.cast("long").alias("_grain"),
        scope,
        month,
        F.lit(0).cast("long").alias("rows"),
        F.col("expected").cast("long").alias("expected"),
    )
    cells = found.unionByName(asked).groupBy("_grain", scope, month)
    known = F.col("expected").isNotNull()
    return cells.agg(F.sum("rows").alias("rows"), F.sum("expected").alias("expected")).select(
        F.when(F.col("_grain") == 3, F.lit(total)).otherwise(F.col(scope)).alias(scope),
        F.when(F.col("_grain") > 0, F.lit(total)).otherwise(F.col(month)).alias(month),
        "rows",
        "expected",
        F.when(known & (F.col("rows") == F.col("expected")), "OK")
        .when(known, "DIVERGE")
        .otherwise("UNKNOWN")
        .alias("status"),
    )


def deviation(
    actual: DataFrame,
    expected: DataFrame,
    key: str,
    value: str,
    expected_value: str,
    tolerance: float,
    digits: int = 2,
) -> DataFrame:
    """Signed deviation from an expected value per key; a missing side is not ok."""
    joined = actual.select(key, value).join(expected.select(key, expected_value), key, "full")
    difference = F.round(F.col(value) - F.col(expected_value), digits)
    return joined.select(
        key,
        value,
        expected_value,
        difference.alias("desvio"),
        F.coalesce(F.abs(difference) <= tolerance, F.lit(False)).alias("ok"),
    )


def volume_against_expected(
    counts: DataFrame, expected: DataFrame, scope: str, month: str, total: str
) -> DataFrame:
    """Rows against expected rows per scope and month, with totals per scope and overall.

    ``counts`` is (scope, month, rows), ``expected`` is (scope, month, expected); a key on one
    side only counts as 0 on the other.
    """
    both = counts.select(scope, month, "rows", F.lit(0).cast("long").alias("expected")).unionByName(
        expected.select(
            scope, month, F.lit(0).cast("long").alias("rows"), F.col("expected").cast("long")
        )
    )
    level = F.grouping_id(scope, month)
    return (
        both.rollup(scope, month)
        .agg(
            level.alias("_level"),
            F.sum("rows").alias("rows"),
            F.sum("expected").alias("expected"),
        )
        .select(
            F.when(F.col("_level") == 3, F.lit(total)).otherwise(F.col(scope)).alias(scope),
            F.when(F.col("_level") > 0, F.lit(total)).otherwise(F.col(month)).alias(month),
            "rows",
            "expected",
            F.when(F.col("rows") == F.col("expected"), "OK").otherwise("DIVERGE").alias("status"),
        )
    )
