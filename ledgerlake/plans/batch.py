"""The whole run: landing check, conform, classify and split, reconcile, publish, answer.

Tables of a warehouse, each kept as a ``stores.Store`` below ``root``::

    conformed_store  every source row, by (scope, month)
    checked_store    every row once more in its published columns, by (scope, month, outcome)
    kept_counts      rows by (scope, month, kind, reason), a few rows per source
    dq_metrics       counts per scope and in total

Classification is written once: one scan of the conformed rows fills the clean and the rejected
side together, as partitions of one table, instead of one scan for each.

A run stages its partitions, counts what it staged, and checks these counts; nothing is published
before they agree. Counts of all other partitions come from kept_counts, so loading, metrics and
reconciliation read only files of the run, whatever else is stored. ``audit`` counts everything
again. The answers are views over all clean rows, and so is the comparison that a run ends with.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerlake import taxi
from ledgerlake.operators import answers, compare, conform, quality
from ledgerlake.plans import sinks, stores, views
from ledgerlake.sources import files, landing
from ledgerlake.spec import Dataset, OutputColumn

OUTCOME = "outcome"
CLEAN = "clean"
REJECTED = "rejected"
# Kept counts: rows of the conformed side, and of each outcome by reason.
KIND = "kind"
INPUT = "input"
REASON = "reason"

Partition = tuple[str, str]


def all_partitions(scopes: Sequence[str], months: Sequence[str]) -> list[Partition]:
    return [(s, m) for s in scopes for m in months]


@dataclass(frozen=True)
class Warehouse:
    """Where a run keeps its tables and under which names it publishes them."""

    root: str
    schema: str

    def name(self, table: str) -> str:
        return f"{self.schema}.{table}"

    def store(self, table: str, ddl: str, partition_cols: Sequence[str] = ()) -> stores.Store:
        return stores.Store(
            self.name(table), f"{self.root.rstrip('/')}/{table}", ddl, tuple(partition_cols)
        )

    def conformed(self, dataset: Dataset) -> stores.Store:
        table = dataset.table
        return self.store("conformed_store", table.ddl(), (table.scope, table.month))

    def checked(self, dataset: Dataset) -> stores.Store:
        table = dataset.table
        return self.store(
            "checked_store", checked_output(dataset).ddl(), (table.scope, table.month, OUTCOME)
        )

    def counts(self, dataset: Dataset) -> stores.Store:
        table = dataset.table
        return self.store(
            "kept_counts",
            f"`{table.scope}` string, `{table.month}` string, {KIND} string, {REASON} string, rows long",
        )

    def metrics(self, dataset: Dataset) -> stores.Store:
        names = dataset.metrics
        return self.store(
            views.METRICS,
            f"`{names.run_ts}` timestamp, `{names.metric}` string, `{names.scope}` string, "
            f"`{names.value}` long",
        )


def run(
    spark: SparkSession,
    dataset: Dataset,
    landing_root: str,
    warehouse: Warehouse,
    partitions: Sequence[Partition],
    hour_month: str,
    run_ts: datetime | None = None,
    check_answers: bool = True,
) -> dict[str, DataFrame]:
    """Run all steps for the given (scope, month) pairs; raises at the first check that fails.

    Up to the publication a failure leaves the stored tables as they were. ``check_answers`` compares
    the published answers, over all clean rows, with their second computation.
    """
    check_landing(spark, dataset, landing_root, partitions)
    sinks.create_schema(spark, warehouse.schema)
    load(spark, dataset, landing_root, warehouse, partitions, run_ts)
    publish_views(spark, dataset, warehouse)
    views.publish(spark, warehouse, hour_month)
    result = answer(spark, warehouse, hour_month)
    if check_answers:
        for name in PARITIES:
            compare.require_ok(result[name], f"{name}: answers differ from their second computation")
    return result


def check_landing(
    spark: SparkSession,
    dataset: Dataset,
    landing_root: str,
    partitions: Sequence[Partition],
) -> None:
    """Every source must be there; a scope whose declared months are all in the run must have its
    known bytes in these. A scope of which some are missing is not judged by bytes.
    """
    grid = landing.requested_grid(spark, partitions)
    expected = landing.manifest(grid, dataset.layout, landing_root)
    listed = landing.requested_listing(spark, expected)
    sizes = landing.source_sizes(listed, dataset.layout).cache()
    try:
        landing.require_all(expected, sizes)
        # totals are known for the declared months; others of the run are not judged by them
        judged = [
            (scope, month, total)
            for scope, total in dataset.expected_bytes.items()
            if set(dataset.months) <= {m for s, m in partitions if s == scope}
            for month in dataset.months
        ]
        if judged:
            known = spark.createDataFrame(judged, "scope string, month string, expected_bytes long")
            totals = known.select("scope", "expected_bytes").distinct()
            files = landing.inventory(expected, sizes).join(known, ["scope", "month"], "left_semi")
            landing.require_intact(landing.integrity(files, totals))
    finally:
        sizes.unpersist()


def conformed(spark: SparkSession, dataset: Dataset, warehouse: Warehouse) -> DataFrame:
    """The conformed table in canonical column order, with declared types."""
    return warehouse.conformed(dataset).read(spark).select(*dataset.table.all_columns)


def checked_output(dataset: Dataset):
    outcome = f"if({dataset.violated_rule} IS NULL, '{CLEAN}', '{REJECTED}')"
    return dataset.rejected.plus(OutputColumn(OUTCOME, "string", outcome))


def checked(spark: SparkSession, dataset: Dataset, warehouse: Warehouse) -> DataFrame:
    return warehouse.checked(dataset).read(spark).select(*checked_output(dataset).names)


def load(
    spark: SparkSession,
    dataset: Dataset,
    landing_root: str,
    warehouse: Warehouse,
    partitions: Sequence[Partition],
    run_ts: datetime | None = None,
) -> None:
    """Stage both layers for the given partitions, count and check them, then publish all tables."""
    if not partitions:
        return
    conformed_store, checked_store = warehouse.conformed(dataset), warehouse.checked(dataset)
    sources = files.landed_sources(spark, dataset, landing_root, partitions)
    rows = conform.conform_sources(spark, sources, dataset)
    conformed_store.open(spark, partitions)
    checked_store.open(spark, partitions)
    staged = [conformed_store.stage(spark, rows, partitions)]
    try:
        passed = Observation()
        staged.append(
            checked_store.stage(
                spark, _classified(staged[0].read(spark), dataset, passed), partitions
            )
        )
        counted = counts_of(*(layer.read(spark) for layer in staged), dataset).collect()
        _require_what_passed(counted, passed.get)
        counts = _all_counts(spark, dataset, warehouse, partitions, counted)
        metrics = quality.metrics_of_counts(
            _outcome_counts(counts, dataset), dataset.rules, dataset.metrics, REASON, run_ts
        )
        _require_consistent(metrics, counts, dataset)
    except Exception:
        for layer in staged:
            layer.discard(spark)
        raise
    # counts and metrics first in folders of their own: all four are published one after the other
    kept, told = warehouse.counts(dataset), warehouse.metrics(dataset)
    kept.open(spark)
    told.open(spark)
    small = [kept.stage(spark, counts.coalesce(1)), told.stage(spark, metrics.coalesce(1))]
    for layer in (*staged, *small):
        layer.store.publish(spark, layer)


def _classified(rows: DataFrame, dataset: Dataset, passed: Observation) -> DataFrame:
    """Published columns and outcome; rows by outcome and reason are observed in passing."""
    marked = quality.classify(rows, dataset.rules, dataset.violated_rule)
    reason = F.col(dataset.violated_rule)
    observed = marked.observe(
        passed,
        F.count_if(reason.isNull()).alias(CLEAN),
        *(F.count_if(reason == r.name).alias(r.name) for r in dataset.rules),
    )
    return quality.project(observed, checked_output(dataset))


def counts_of(conformed_rows: DataFrame, checked_rows: DataFrame, dataset: Dataset) -> DataFrame:
    """Rows by (scope, month, kind, reason): input from the one table, outcomes from the other."""
    by = [dataset.table.scope, dataset.table.month]
    reason = dataset.rejected.columns[-1].name
    taken = conformed_rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))
    split = checked_rows.groupBy(*by, OUTCOME, reason).agg(F.count(F.lit(1)).alias("rows"))
    return taken.select(
        *by, F.lit(INPUT).alias(KIND), F.lit(None).cast("string").alias(REASON), "rows"
    ).unionByName(
        split.select(*by, F.col(OUTCOME).alias(KIND), F.col(reason).alias(REASON), "rows")
    )


def _require_what_passed(counted: Sequence, passed: dict[str, int]) -> None:
    """Staged rows by reason against those that passed the classification."""
    seen: dict[str, int] = {}
    for row in counted:
        if row[KIND] != INPUT:
            name = row[REASON] or CLEAN
            seen[name] = seen.get(name, 0) + row["rows"]
    expected = {name: n for name, n in passed.items() if n}
    if seen != expected:
        raise quality.ReconciliationError(f"stored rows {seen} differ from classified {expected}")


def _all_counts(
    spark: SparkSession,
    dataset: Dataset,
    warehouse: Warehouse,
    partitions: Sequence[Partition],
    counted: Sequence,
) -> DataFrame:
    """Counts of this run in place of the kept ones of its partitions."""
    store = warehouse.counts(dataset)
    new = spark.createDataFrame([tuple(r) for r in counted], store.schema)
    if not store.exists(spark):
        return new
    in_run = sinks.is_target((dataset.table.scope, dataset.table.month), partitions)
    return store.read(spark).filter(~in_run).unionByName(new)


def _outcome_counts(counts: DataFrame, dataset: Dataset) -> DataFrame:
    """Classified rows by (scope, reason)."""
    return (
        counts.filter(F.col(KIND) != INPUT)
        .groupBy(dataset.table.scope, REASON)
        .agg(F.sum("rows").alias("rows"))
    )


def _side(counts: DataFrame, dataset: Dataset, kind: str) -> DataFrame:
    """Rows of one kind per scope and in total."""
    names = dataset.metrics
    return quality.added_scope_counts(
        counts.filter(F.col(KIND) == kind), names.scope, names.total, "rows"
    )


def _require_consistent(metrics: DataFrame, counts: DataFrame, dataset: Dataset) -> None:
    names = dataset.metrics
    per_reason = counts.filter(F.col(KIND) == REJECTED).groupBy(REASON).agg(F.sum("rows").alias("rows"))
    quality.require_zero_difference(
        quality.reason_check_of_counts(per_reason, metrics, names, REASON),
        "rejected rows per reason are not the stored metrics",
    )
    taken = _side(counts, dataset, INPUT)
    quality.require_zero_difference(
        quality.reconcile(metrics, taken, names), "input is not clean plus rejected"
    )
    quality.require_zero_difference(
        quality.partition_check(
            taken, *(_side(counts, dataset, side) for side in (CLEAN, REJECTED)), names.scope
        ),
        "stored clean and rejected rows are not the input",
    )


def audit(spark: SparkSession, dataset: Dataset, warehouse: Warehouse) -> None:
    """Count both stored tables again, whole; raise where they differ from the kept counts.

    This is the one check whose cost follows the history. It reads row counts from footers and one
    narrow column.
    """
    counted = counts_of(
        conformed(spark, dataset, warehouse), checked(spark, dataset, warehouse), dataset
    )
    kept = warehouse.counts(dataset).read(spark)
    keys = [dataset.table.scope, dataset.table.month, KIND, REASON]
    sides = kept.select(*keys, F.col("rows").alias("kept"), F.lit(0).cast("long").alias("stored"))
    both = sides.unionByName(
        counted.select(*keys, F.lit(0).cast("long").alias("kept"), F.col("rows").alias("stored"))
    )
    differing = both.groupBy(*keys).agg(F.sum("kept").alias("kept"), F.sum("stored").alias("stored"))
    quality.require_zero_difference(
        differing.withColumn("diff", F.col("kept") - F.col("stored")),
        "stored rows are not the kept counts",
    )
    metrics = warehouse.metrics(dataset).read(spark)
    _require_consistent(metrics, counted, dataset)


def publish_views(spark: SparkSession, dataset: Dataset, warehouse: Warehouse) -> None:
    """Views with exactly the published columns over the stored tables."""

    def columns(names) -> str:
        return ", ".join(f"`{n}`" for n in names)

    checked_store = warehouse.checked(dataset).name
    published = {
        views.CONFORMED: (
            f"SELECT {columns(dataset.table.all_columns)} FROM {warehouse.conformed(dataset).name}"
        ),
        views.TRIPS: (
            f"SELECT {columns(dataset.clean.names)} FROM {checked_store} "
            f"WHERE {OUTCOME} = '{CLEAN}'"
        ),
        views.REJECTED_TRIPS: (
            f"SELECT {columns(dataset.rejected.names)} FROM {checked_store} "
            f"WHERE {OUTCOME} = '{REJECTED}'"
        ),
    }
    for name, query in published.items():
        sinks.publish_view(spark, warehouse.name(name), query)


#: Comparisons among the answers, which a run requires to hold.
PARITIES = ("month_parity", "hour_parity")


def answer(spark: SparkSession, warehouse: Warehouse, hour_month: str) -> dict[str, DataFrame]:
    """The two answers through their views, and their comparison with a second computation."""
    trips = spark.table(warehouse.name(views.TRIPS))
    by_month = spark.table(warehouse.name(taxi.MONTH_VIEW)).orderBy(taxi.PICKUP_MONTH)
    by_hour = spark.table(warehouse.name(taxi.HOUR_VIEW)).orderBy(taxi.SCOPE, taxi.PICKUP_HOUR)
    month_again = views.month_average(trips)
    hour_again = answers.scopes_side_by_side(
        trips.filter(F.col(taxi.PICKUP_MONTH) == hour_month),
        taxi.PICKUP_HOUR,
        taxi.FLEET,
        "passenger_count",
        taxi.SCOPES,
        3,
        "media_",
    )
    hour_pivot = answers.pivot_scopes(
        by_hour, taxi.PICKUP_HOUR, taxi.SCOPE, taxi.HOUR_MEAN, list(taxi.SCOPES), "media_"
    )
    return {
        "month": by_month,
        "hour": by_hour,
        "month_parity": compare.compare(
            by_month,
            month_again,
            [taxi.PICKUP_MONTH],
            {"media": (taxi.MONTH_MEAN, taxi.MONTH_MEAN), "qtd": (taxi.TRIPS, taxi.TRIPS)},
            taxi.PARITY_TOLERANCE,
        ),
        "hour_parity": compare.compare(
            hour_pivot,
            hour_again,
            [taxi.PICKUP_HOUR],
            {s: (f"media_{s}", f"media_{s}") for s in taxi.SCOPES},
            taxi.PARITY_TOLERANCE,
            nulls_agree=True,  # an hour need not have trips of every scope
        ),
    }
