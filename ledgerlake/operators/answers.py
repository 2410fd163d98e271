"""Business questions on the clean table.

Results are not sorted here: most feed a further step, and a reader sorts once at the end.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.timeparts import days_in_month

Scopes = Mapping[str, Sequence[str] | None]


def group_average(
    df: DataFrame, group: str, measure: str, digits: int, mean: str, count: str
) -> DataFrame:
    """Rounded mean and number of rows per group."""
    return df.groupBy(group).agg(
        F.round(F.avg(measure), digits).alias(mean),
        F.count(F.lit(1)).alias(count),
    )


def _scope_labels(member: str, scopes: Scopes) -> Column:
    """Labels of the scopes a row of ``member`` belongs to."""
    return F.array_compact(
        F.array(
            *(
                F.lit(label)
                if members is None
                else F.when(F.col(member).isin(list(members)), F.lit(label))
                for label, members in scopes.items()
            )
        )
    )


def scoped_average(
    df: DataFrame,
    group: str,
    member: str,
    measure: str,
    scopes: Scopes,
    digits: int,
    label: str,
    mean: str,
    count: str,
) -> DataFrame:
    """Mean per group for several overlapping scopes, from one scan.

    Sums and counts are taken per group and member first; the scopes then only combine that
    small result, so no input row is read or copied once per scope.
    """
    per_member = df.groupBy(group, member).agg(
        F.sum(measure).alias("_sum"),
        F.count(measure).alias("_known"),
        F.count(F.lit(1)).alias("_rows"),
    )
    return (
        per_member.withColumn(label, F.explode(_scope_labels(member, scopes)))
        .groupBy(label, group)
        .agg(
            F.round(F.try_divide(F.sum("_sum"), F.sum("_known")), digits).alias(mean),
            F.sum("_rows").alias(count),
        )
        .select(label, group, mean, count)
    )


def _in_scope(member: str, members: Sequence[str] | None, measure: str) -> Column:
    value = F.col(measure)
    return value if members is None else F.when(F.col(member).isin(list(members)), value)


def scopes_side_by_side(
    df: DataFrame, group: str, member: str, measure: str, scopes: Scopes, digits: int, prefix: str
) -> DataFrame:
    """One mean column per scope, one row per group that occurs in any scope."""
    return df.groupBy(group).agg(
        *(
            F.round(F.avg(_in_scope(member, members, measure)), digits).alias(prefix + label)
            for label, members in scopes.items()
        )
    )


def pivot_scopes(
    averages: DataFrame, group: str, label: str, mean: str, scopes: Sequence[str], prefix: str
) -> DataFrame:
    """Long scoped averages as one column per scope."""
    return (
        averages.groupBy(group)
        .pivot(label, list(scopes))
        .agg(F.max(mean))
        .withColumnsRenamed({s: prefix + s for s in scopes})
    )


def occupancy_and_demand(
    df: DataFrame, group: str, member: str, measure: str, scopes: Scopes, month: str
) -> DataFrame:
    """Mean per row and sum per day of ``month``, per scope, in one pass."""
    days = days_in_month(month)
    columns = []
    for label, members in scopes.items():
        value = _in_scope(member, members, measure)
        columns.append(F.round(F.avg(value), 3).alias(f"ocupacao_{label}"))
        columns.append(F.round(F.sum(value) / days, 1).alias(f"demanda_{label}"))
    return df.groupBy(group).agg(*columns)


def _extremes(df: DataFrame, group: str, measures: Sequence[str], pick: Column) -> DataFrame:
    """One row (measure, group, value) per measure."""
    long = df.select(
        group, F.expr(_stacked(measures)).alias("measure", "value")
    ).filter(F.col("value").isNotNull())
    return (
        long.groupBy("measure")
        .agg(pick.alias("_pick"))
        .select("measure", f"_pick.{group}", "_pick.value")
    )


def _stacked(measures: Sequence[str]) -> str:
    pairs = ", ".join(f"'{m}', CAST(`{m}` AS DOUBLE)" for m in measures)
    return f"stack({len(measures)}, {pairs})"


def peaks(df: DataFrame, group: str, measures: Sequence[str]) -> DataFrame:
    """Group with the highest value of each measure; the smallest group wins a tie."""
    row = F.struct(F.col(group), F.col("value"))
    return _extremes(df, group, measures, F.max_by(row, F.struct("value", -F.col(group))))


def troughs(df: DataFrame, group: str, measures: Sequence[str]) -> DataFrame:
    """Group with the lowest value of each measure; the smallest group wins a tie."""
    row = F.struct(F.col(group), F.col("value"))
    return _extremes(df, group, measures, F.min_by(row, F.struct("value", group)))


def ablation(
    df: DataFrame, group: Column, measure: str, scenarios: Mapping[str, str], digits: int = 2
) -> DataFrame:
    """Mean per group under several filters, one column each, in one scan and without joins.

    A group stays when any scenario has rows for it; a scenario without rows gives NULL.
    """
    return df.groupBy(group).agg(
        *(
            F.round(F.avg(F.when(F.expr(condition), F.col(measure))), digits).alias(name)
            for name, condition in scenarios.items()
        )
    )


def growth(averages: DataFrame, period: str, mean: str, digits: int = 2) -> DataFrame:
    """Percentage from the first to the last period."""
    first, last = F.min_by(mean, period), F.max_by(mean, period)
    return averages.agg(
        F.min(period).alias("first_period"),
        F.max(period).alias("last_period"),
        first.alias("first_value"),
        last.alias("last_value"),
        F.round((F.try_divide(last, first) - 1) * 100, digits).alias("growth_pct"),
    )


def widest_gap(side_by_side: DataFrame, group: str, a: str, b: str, digits: int = 3) -> DataFrame:
    """Largest absolute difference of two columns and the (smallest) group where it occurs."""
    gap = F.round(F.abs(F.col(a) - F.col(b)), digits)
    return (
        side_by_side.select(group, gap.alias("gap"))
        .filter(F.col("gap").isNotNull())
        .agg(
            F.max("gap").alias("gap"),
            F.max_by(group, F.struct("gap", -F.col(group))).alias(group),
        )
    )
