"""What reaches the files when the stored tables are read."""

import re

import pytest
from pyspark.sql import functions as F

from ledgerlake import taxi
from ledgerlake.operators import conform, quality
from ledgerlake.plans import batch, views
from ledgerlake.suite import fixtures

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def warehouse(spark):
    return fixtures.stored(spark, SF_DIR)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def read_schemas(df) -> list[set[str]]:
    found = re.findall(r"ReadSchema: struct<([^>]*)>", plan(df))
    return [{c.split(":")[0] for c in schema.split(",") if c} for schema in found]


def partition_filters(df) -> str:
    return " ".join(re.findall(r"PartitionFilters: \[(.*?)\], PushedFilters", plan(df)))


def pushed_filters(df) -> str:
    return " ".join(re.findall(r"PushedFilters: \[(.*?)\], ReadSchema", plan(df)))


def test_month_answer_reads_two_columns_of_the_clean_yellow_folders(spark, warehouse):
    df = spark.table(warehouse.name(taxi.MONTH_VIEW))
    assert read_schemas(df) == [{"total_amount", "pickup_year_month"}]
    assert "outcome" in partition_filters(df)
    assert "yellow" in partition_filters(df)


def test_hour_answer_scans_once_and_pushes_the_month(spark, warehouse):
    df = spark.table(warehouse.name(taxi.HOUR_VIEW))
    assert read_schemas(df) == [{"passenger_count", "pickup_year_month", "pickup_hour"}]
    assert f"EqualTo(pickup_year_month,{fixtures.HOUR_MONTH})" in pushed_filters(df)


def test_window_bounds_reach_the_conformed_files(spark, warehouse):
    start, end = fixtures.WINDOW
    df = batch.conformed(spark, fixtures.DATASET, warehouse).filter(
        f"{taxi.FLEET} = 'yellow' AND {taxi.PICKUP} >= TIMESTAMP_NTZ '{start}' "
        f"AND {taxi.PICKUP} < TIMESTAMP_NTZ '{end}'"
    )
    assert f"GreaterThanOrEqual({taxi.PICKUP}" in pushed_filters(df)
    assert f"LessThan({taxi.PICKUP}" in pushed_filters(df)
    assert "yellow" in partition_filters(df)


def test_counting_partitions_reads_no_column(spark, warehouse):
    stored = batch.conformed(spark, fixtures.DATASET, warehouse)
    assert read_schemas(conform.partition_counts(stored, taxi.TABLE)) == [set()]
    counts = quality.scope_counts(stored, taxi.FLEET, taxi.METRICS.total)
    assert read_schemas(counts) == [set()]


def test_metrics_of_the_stored_table_read_one_column(spark, warehouse):
    stored = batch.checked(spark, fixtures.DATASET, warehouse)
    df = quality.quality_metrics(
        stored, fixtures.DATASET.rules, taxi.METRICS, taxi.REJECT_REASON
    )
    assert read_schemas(df) == [{taxi.REJECT_REASON}]


def test_classifying_selected_partitions_prunes_folders_and_columns(spark, warehouse):
    chosen = F.concat_ws("/", taxi.FLEET, taxi.FILE_MONTH).isin(["yellow/1997-07"])
    source = batch.conformed(spark, fixtures.DATASET, warehouse).filter(chosen)
    marked = quality.classify(source, fixtures.DATASET.rules, taxi.VIOLATED_RULE)
    df = quality.project(marked, batch.checked_output(fixtures.DATASET))
    assert "concat_ws" in partition_filters(df)
    assert read_schemas(df) == [
        {"VendorID", taxi.PICKUP, taxi.DROPOFF, "passenger_count", "total_amount"}
    ]
    assert "Exchange" not in plan(df)


def test_conforming_shuffles_nothing(spark):
    sources = fixtures.landed_sources(spark, SF_DIR)
    df = conform.conform_sources(spark, sources, fixtures.DATASET)
    assert "Exchange" not in plan(df)
    assert plan(df).count("FileScan") == 3


def test_views_are_listed(spark, warehouse):
    listed = {r.viewName for r in spark.sql(f"SHOW VIEWS IN {warehouse.schema}").collect()}
    assert {views.TRIPS, views.REJECTED_TRIPS, taxi.MONTH_VIEW, taxi.HOUR_VIEW} <= listed
