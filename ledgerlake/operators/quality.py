"""Classify rows by the first rule they break, split them, count them, and prove the counts.

Row operators (``classify``, ``clean_rows``, ``rejected_rows``, ``project``) contain no action
and keep no state. Counting always aggregates per scope first, so every later step works on a
handful of rows, however skewed the scopes are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.spec import MetricSpec, OutputSpec, Rule


#: Differing rows that an error message names.
_SHOWN = 20


class ReconciliationError(AssertionError):
    """Counts that do not add up."""


# --- row operators ------------------------------------------------------------------------


def first_violation(rules: Sequence[Rule]) -> Column:
    """Name of the first broken rule, NULL when none is."""
    return F.coalesce(*(F.when(F.expr(r.violation_sql), F.lit(r.name)) for r in rules))


def classify(df: DataFrame, rules: Sequence[Rule], out: str) -> DataFrame:
    return df.withColumn(out, first_violation(rules))


def clean_rows(classified: DataFrame, reason: str) -> DataFrame:
    return classified.filter(F.col(reason).isNull())


def rejected_rows(classified: DataFrame, reason: str) -> DataFrame:
    return classified.filter(F.col(reason).isNotNull())


def project(df: DataFrame, output: OutputSpec) -> DataFrame:
    return df.select(
        *(F.expr(c.expression or f"`{c.name}`").cast(c.type).alias(c.name) for c in output.columns)
    )


def broken_by_rule(df: DataFrame, rule: Rule, by: Sequence[str]) -> DataFrame:
    """Rows and broken rows of one rule on its own, whatever the other rules say."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.expr(rule.violation_sql)).alias("broken"),
    )


# --- counts per scope with a total --------------------------------------------------------


def with_total(counts: DataFrame, by: str, total: str, values: Mapping[str, Column]) -> DataFrame:
    """Aggregates of ``counts`` per scope and over all scopes, as (scope, values...).

    ``counts`` is already aggregated (few rows). A row with the total's label always comes out,
    also for an empty input: a seed row keeps the rollup from having nothing to roll up. A NULL
    scope stays NULL, told from the total by ``grouping``; a scope that carries the total's label
    would be counted twice and raises.
    """
    seed = counts.sparkSession.range(1).select(F.lit(True).alias("_seed"))
    rolled = (
        counts.withColumn("_seed", F.lit(False))
        .unionByName(seed, allowMissingColumns=True)
        .rollup(by)
        .agg(
            F.grouping(by).alias("_all"),
            F.count_if(~F.col("_seed")).alias("_found"),
            *(column.alias(name) for name, column in values.items()),
        )
        .filter((F.col("_all") == 1) | (F.col("_found") > 0))
    )
    clash = F.raise_error(F.lit(f"a scope is named like the total: {total}")).cast("string")
    scope = (
        F.when(F.col("_all") == 1, F.lit(total))
        .when(F.col(by) == total, clash)
        .otherwise(F.col(by))
    )
    return rolled.select(scope.alias(by), *values)


def _summed(count: str, where: Column | None = None) -> Column:
    counted = F.col(count) if where is None else F.when(where, F.col(count))
    return F.coalesce(F.sum(counted), F.lit(0))


def scope_counts(df: DataFrame, by: str, total: str, name: str = "rows") -> DataFrame:
    """Rows per scope and in total, counted on the table itself."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    return with_total(counts, by, total, {name: _summed("_n")})


def added_scope_counts(counts: DataFrame, by: str, total: str, name: str) -> DataFrame:
    """The same from kept counts in a column of that name."""
    added = counts.groupBy(by).agg(F.sum(name).alias("_n"))
    return with_total(added, by, total, {name: _summed("_n")})


# --- metrics ------------------------------------------------------------------------------


def metric_names(rules: Sequence[Rule], names: MetricSpec) -> list[str]:
    return [names.input_rows, *(r.name for r in rules), names.clean_rows]


def quality_metrics(
    classified: DataFrame,
    rules: Sequence[Rule],
    names: MetricSpec,
    reason: str,
    run_ts: datetime | None = None,
) -> DataFrame:
    """Long metrics (run_ts, metric, scope, value): input, rejects per rule, clean.

    Rows are counted per scope and reason in one pass. The input is counted as such, not added
    up from the other metrics.
    """
    counts = classified.groupBy(names.scope, reason).agg(F.count(F.lit(1)).alias("rows"))
    return metrics_of_counts(counts, rules, names, reason, run_ts)


def metrics_of_counts(
    counts: DataFrame,
    rules: Sequence[Rule],
    names: MetricSpec,
    reason: str,
    run_ts: datetime | None = None,
) -> DataFrame:
    """The same from (scope, reason, rows), where a row without a reason counts clean rows."""
    counts = counts.select(names.scope, reason, F.col("rows").alias("_n"))
    values = {names.input_rows: _summed("_n")}
    values |= {r.name: _summed("_n", F.col(reason) == r.name) for r in rules}
    clean = ~F.col("_seed") & F.col(reason).isNull()
    values[names.clean_rows] = _summed("_n", clean)
    wide = with_total(counts, names.scope, names.total, values)
    stamp = F.current_timestamp() if run_ts is None else F.lit(run_ts).cast("timestamp")
    return wide.unpivot(names.scope, list(values), names.metric, names.value).select(
        stamp.alias(names.run_ts), names.metric, names.scope, names.value
    )


def metric_values(metrics: DataFrame, names: MetricSpec) -> DataFrame:
    """The metrics without the time of the run."""
    return metrics.select(names.metric, names.scope, names.value)


def metrics_of(metrics: DataFrame, names: MetricSpec, scope: str) -> DataFrame:
    return metrics.filter(F.col(names.scope) == scope).select(names.metric, names.value)


def _metric_sums(metrics: DataFrame, names: MetricSpec) -> dict[str, Column]:
    """Input, clean and rejected rows as aggregates over long metrics."""
    metric, value = F.col(names.metric), F.col(names.value)

    def added(where: Column) -> Column:
        return F.coalesce(F.sum(F.when(where, value)), F.lit(0))

    return {
        "input": added(metric == names.input_rows),
        "clean": added(metric == names.clean_rows),
        "rejected": added(metric.startswith(names.rejected_prefix)),
    }


# --- reconciliation -----------------------------------------------------------------------


def reconcile(metrics: DataFrame, input_counts: DataFrame, names: MetricSpec) -> DataFrame:
    """Independently counted input against clean plus rejected, per scope and in total.

    ``input_counts`` is (scope, rows) from ``scope_counts`` on the input table.
    """
    counted = "_counted"
    rows = metrics.select(names.scope, names.metric, names.value).unionByName(
        input_counts.select(
            names.scope, F.lit(counted).alias(names.metric), F.col("rows").alias(names.value)
        )
    )
    sums = _metric_sums(rows, names)
    sums["input"] = F.coalesce(
        F.sum(F.when(F.col(names.metric) == counted, F.col(names.value))), F.lit(0)
    )
    return _with_difference(
        rows.groupBy(names.scope).agg(*(c.alias(n) for n, c in sums.items())),
        "input",
        ("clean", "rejected"),
    )


def reconcile_metrics(metrics: DataFrame, names: MetricSpec) -> DataFrame:
    """The same identity from the stored metrics alone."""
    sums = _metric_sums(metrics, names)
    grouped = metrics.groupBy(names.scope).agg(*(c.alias(n) for n, c in sums.items()))
    return _with_difference(grouped, "input", ("clean", "rejected")).select(
        names.scope, F.col("diff").alias("diferenca")
    )


def partition_check(
    input_counts: DataFrame, clean_counts: DataFrame, rejected_counts: DataFrame, by: str
) -> DataFrame:
    """Stored clean and quarantine rows against the input; each argument is (scope, rows)."""
    sides = {"input": input_counts, "clean": clean_counts, "rejected": rejected_counts}
    labelled = reduce(
        DataFrame.unionByName,
        (
            df.select(by, F.lit(side).alias("_side"), F.col("rows"))
            for side, df in sides.items()
        ),
    )
    grouped = labelled.groupBy(by).agg(
        *(_summed("rows", F.col("_side") == side).alias(side) for side in sides)
    )
    return _with_difference(grouped, "input", ("clean", "rejected"))


def partition_check_rollup(
    metrics: DataFrame, clean: DataFrame, rejected: DataFrame, names: MetricSpec
) -> DataFrame:
    """The partition check with the input taken from the stored metrics."""
    stored = metrics.filter(F.col(names.metric) == names.input_rows).select(
        names.scope, F.col(names.value).alias("rows")
    )
    return partition_check(
        stored,
        scope_counts(clean, names.scope, names.total),
        scope_counts(rejected, names.scope, names.total),
        names.scope,
    )


def reason_check(
    rejected: DataFrame, metrics: DataFrame, names: MetricSpec, reason: str
) -> DataFrame:
    """Quarantine rows per reason against the metric of that name; absent on a side counts 0."""
    held = rejected.groupBy(reason).agg(F.count(F.lit(1)).alias("rows"))
    return reason_check_of_counts(held, metrics, names, reason)


def reason_check_of_counts(
    rejected: DataFrame, metrics: DataFrame, names: MetricSpec, reason: str
) -> DataFrame:
    """The same from (reason, rows)."""
    stored = metrics.filter(
        (F.col(names.scope) == names.total)
        & F.col(names.metric).startswith(names.rejected_prefix)
    ).select(
        F.col(names.metric).alias(reason),
        F.lit(0).cast("long").alias("quarantine"),
        F.col(names.value).alias("metric"),
    )
    held = rejected.select(
        reason, F.col("rows").alias("quarantine"), F.lit(0).cast("long").alias("metric")
    )
    both = (
        stored.unionByName(held)
        .groupBy(reason)
        .agg(F.sum("quarantine").alias("quarantine"), F.sum("metric").alias("metric"))
    )
    return _with_difference(both, "metric", ("quarantine",))


def _with_difference(df: DataFrame, whole: str, parts: Sequence[str]) -> DataFrame:
    return df.withColumn("diff", reduce(lambda d, p: d - F.col(p), parts, F.col(whole)))


def require_zero_difference(checked: DataFrame, what: str) -> None:
    """Raise when a check has a difference, with the number of differing rows and some of them.

    The error has the whole table of differences as ``differences``.
    """
    broken = checked.filter(~F.col("diff").eqNullSafe(F.lit(0)))
    shown = broken.take(_SHOWN)
    if shown:
        told = "; ".join(str(r.asDict()) for r in shown)
        error = ReconciliationError(f"{what}: {broken.count()} rows differ, among them {told}")
        error.differences = broken
        raise error


def clean_yield(reconciled: DataFrame, by: str, digits: int = 4) -> DataFrame:
    """Share of the input that is clean; NULL for an empty input."""
    return reconciled.select(
        by,
        "input",
        "clean",
        F.round(F.try_divide("clean", "input"), digits).alias("aproveitamento"),
    )


def cleaning_impact(metrics: DataFrame, names: MetricSpec, digits: int = 4) -> DataFrame:
    """Input, clean, rejected, yield and whether the sums close, per scope."""
    sums = _metric_sums(metrics, names)
    grouped = metrics.groupBy(names.scope).agg(*(c.alias(n) for n, c in sums.items()))
    closes = F.col("input") == F.col("clean") + F.col("rejected")
    return grouped.select(
        names.scope,
        "input",
        "clean",
        "rejected",
        F.round(F.try_divide("clean", "input"), digits).alias("aproveitamento"),
        closes.alias("reconciled"),
    )


# --- quarantine audit ---------------------------------------------------------------------


def reasons_by_scope(
    rejected: DataFrame, reason: str, by: str, scopes: Sequence[str]
) -> DataFrame:
    return rejected.groupBy(reason).agg(
        F.count(F.lit(1)).alias("total"),
        *(F.count_if(F.col(by) == s).alias(s) for s in scopes),
    )


def worst_rows(
    rejected: DataFrame,
    reason: str,
    rule_name: str,
    measure: str,
    columns: Sequence[str],
    n: int = 5,
) -> DataFrame:
    """The ``n`` lowest rows of one reason; ties are settled by the other columns."""
    order = [measure, *(c for c in columns if c != measure)]
    return (
        rejected.filter(F.col(reason) == rule_name).select(*columns).orderBy(*order).limit(n)
    )


def reason_by_source(
    rejected: DataFrame, reason: str, rule_name: str, month: str, name: str = "corridas"
) -> DataFrame:
    return (
        rejected.filter(F.col(reason) == rule_name)
        .groupBy(month)
        .agg(F.count(F.lit(1)).alias(name))
    )


def row_count(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


# --- contract -----------------------------------------------------------------------------


def contract_check(
    df: DataFrame, guarantees: Mapping[str, str], by: Sequence[str] = ()
) -> DataFrame:
    """Rows that break each guarantee, all counted in one scan: (by..., guarantee, broken)."""
    counted = df.groupBy(*by).agg(
        *(F.count_if(F.expr(violation)).alias(name) for name, violation in guarantees.items())
    )
    return counted.unpivot(list(by), list(guarantees), "guarantee", "broken")


def contract_witnesses(
    df: DataFrame, guarantees: Mapping[str, str], row_id: str, most: int = 3
) -> DataFrame:
    """Broken rows of each guarantee with up to ``most`` of their ids: (guarantee, broken, place, witness).

    The k-th witness is the id of least k-th hash among the rows that break the guarantee, so it does
    not depend on how the rows are dealt out, takes no more memory than the hash that is least so
    far, and comes from the scan that counts. An id may be the least by several hashes. A guarantee
    that no row breaks has no witness: one row with a NULL place.
    """
    text = F.col(row_id).cast("string")

    def least(violation: str, place: int) -> Column:
        hashed = F.md5(F.concat(text, F.lit(f"#{place}")).cast("binary"))
        return F.min(F.when(F.expr(violation), F.struct(hashed.alias("hash"), text.alias("id"))))

    counted = df.agg(
        *(
            F.struct(
                F.count_if(F.expr(v)).alias("broken"),
                F.array(*(least(v, k)["id"] for k in range(1, most + 1))).alias("ids"),
            ).alias(name)
            for name, v in guarantees.items()
        )
    )
    rows = counted.select(
        F.inline(
            F.array(*(F.struct(F.lit(g).alias("guarantee"), F.col(f"`{g}`").alias("found")) for g in guarantees))
        )
    )
    ids = F.filter("found.ids", lambda i: i.isNotNull())
    return rows.select("guarantee", "found.broken", F.posexplode_outer(ids).alias("place", "witness")).withColumn(
        "place", F.col("place") + 1
    )
