"""Drift, renames, casts and the union of drifting sources."""

import pytest
from pyspark.sql import functions as F

from ledgerlake import taxi
from ledgerlake.operators import conform
from ledgerlake.sources import files
from ledgerlake.spec import Layout

DATASET = taxi.dataset()
TABLE = DATASET.table


def raw(spark, fleet, month, types=None, rows=2, **values):
    """Rows in the raw shape of one source; ``values`` override columns by canonical name."""
    spelling = DATASET.source(fleet).spelling(month, TABLE)
    types = types or {}
    columns = []
    for name, spelled in spelling.items():
        value = values.get(name, "2023-03-10 08:00" if "datetime" in name else 1)
        columns.append(F.lit(value).cast(types.get(name, TABLE.columns[name])).alias(spelled))
    return spark.range(rows).select(*columns)


def land(root, df, fleet, month):
    path = DATASET.layout.source_path(str(root), fleet, month)
    df.coalesce(1).write.parquet(path)


@pytest.fixture
def landing(spark, tmp_path):
    wide = {"VendorID": "bigint", "passenger_count": "double"}
    land(tmp_path, raw(spark, "yellow", "2023-01", wide, rows=3), "yellow", "2023-01")
    for month in ("2023-02", "2023-03"):
        narrow = {"passenger_count": "bigint"}
        land(tmp_path, raw(spark, "yellow", month, narrow, rows=2), "yellow", month)
    land(tmp_path, raw(spark, "green", "2023-01", rows=4), "green", "2023-01")
    return str(tmp_path)


PARTITIONS = [
    ("yellow", "2023-01"),
    ("yellow", "2023-02"),
    ("yellow", "2023-03"),
    ("green", "2023-01"),
]


def test_union_of_drifting_sources(spark, landing):
    sources = files.landed_sources(spark, DATASET, landing, PARTITIONS)
    df = conform.conform_sources(spark, sources, DATASET)
    assert [(f.name, f.dataType.simpleString()) for f in df.schema] == list(
        TABLE.all_columns.items()
    )
    counts = {tuple(r) for r in conform.partition_counts(df, TABLE).collect()}
    assert counts == {
        ("yellow", "2023-01", 3),
        ("yellow", "2023-02", 2),
        ("yellow", "2023-03", 2),
        ("green", "2023-01", 4),
    }
    assert conform.total_count(df).first()[0] == 11
    nulls = df.groupBy("taxi_type").agg(F.count("airport_fee"), F.count("ehail_fee"))
    assert {tuple(r) for r in nulls.collect()} == {("yellow", 7, 0), ("green", 0, 4)}
    exclusive = conform.exclusive_columns(df, DATASET.sources.values(), TABLE)
    assert exclusive.first()[0] == 0
    assert conform.exclusive_columns(
        df.withColumn("airport_fee", F.lit(1.0)), DATASET.sources.values(), TABLE
    ).first()[0] == 4


def test_one_scan_per_schema_variant(spark, landing):
    sources = files.landed_sources(spark, DATASET, landing, PARTITIONS)
    assert len(files.variants(sources, DATASET)) == 3


def test_layout_without_marker_reads_the_month_too(spark, landing, tmp_path):
    assert files.file_month(Layout("f", "{root}/{scope}/{month}")) is not None
    path = DATASET.layout.source_path(landing, "green", "2023-01")
    df = spark.read.parquet(path)
    by_pattern = F.regexp_extract("_metadata.file_path", DATASET.layout.pattern(), 2)
    found = df.select(by_pattern, files.file_month(DATASET.layout)).distinct().collect()
    assert [tuple(r) for r in found] == [("2023-01", "2023-01")]


@pytest.mark.parametrize(
    ("change", "expected"),
    [
        (lambda d: d.withColumn("surprise", F.lit(1)), [("surprise", "unexpected")]),
        (lambda d: d.drop("extra"), [("extra", "missing")]),
        (
            lambda d: d.withColumnRenamed("Airport_fee", "airport_fee"),
            [("airport_fee", "unexpected"), ("Airport_fee", "missing")],
        ),
    ],
)
def test_drift_is_reported_and_stops_the_load(spark, tmp_path, change, expected):
    land(tmp_path, change(raw(spark, "yellow", "2023-04")), "yellow", "2023-04")
    sources = files.landed_sources(spark, DATASET, str(tmp_path), [("yellow", "2023-04")])
    report = conform.drift_report(spark, sources, DATASET)
    assert [(r.column_name, r.kind) for r in report.collect()] == expected
    with pytest.raises(conform.DriftError, match=expected[0][0]):
        conform.conform_sources(spark, sources, DATASET)


@pytest.mark.parametrize(
    ("change", "column"),
    [
        (lambda d: d.withColumnRenamed("total_amount", "Total_Amt"), "Total_Amt"),
        (lambda d: d.withColumnRenamed("total_amount", "TOTAL_AMOUNT"), "TOTAL_AMOUNT"),
        (lambda d: d.withColumn("surprise", F.lit(1)), "surprise"),
        (lambda d: d.drop("extra"), "extra"),
    ],
)
def test_drift_of_one_file_of_a_folder(spark, tmp_path, change, column):
    path = DATASET.layout.source_path(str(tmp_path), "yellow", "2023-04")
    good = raw(spark, "yellow", "2023-04").coalesce(1)
    good.write.parquet(path)
    change(good).write.mode("append").parquet(path)
    sources = files.landed_sources(spark, DATASET, str(tmp_path), [("yellow", "2023-04")])
    assert len(sources) == 2
    with pytest.raises(conform.DriftError, match=column):
        conform.conform_sources(spark, sources, DATASET)


def test_files_of_a_folder_with_other_types(spark, tmp_path):
    path = DATASET.layout.source_path(str(tmp_path), "yellow", "2023-04")
    good = raw(spark, "yellow", "2023-04").coalesce(1)
    good.write.parquet(path)
    good.withColumn("passenger_count", F.col("passenger_count").cast("double")).write.mode(
        "append"
    ).parquet(path)
    sources = files.landed_sources(spark, DATASET, str(tmp_path), [("yellow", "2023-04")])
    assert len(files.variants(sources, DATASET)) == 2
    df = conform.conform_sources(spark, sources, DATASET)
    assert df.count() == 2 * good.count()
    assert df.filter("total_amount IS NULL").count() == 2 * good.filter("total_amount IS NULL").count()
    assert df.filter("passenger_count IS NULL").count() == 2 * good.filter(
        "passenger_count IS NULL"
    ).count()
    assert {r[0] for r in df.select(TABLE.month).distinct().collect()} == {"2023-04"}


@pytest.mark.parametrize("ansi", ["true", "false"])
@pytest.mark.parametrize("value", [3e9, float("nan")])
def test_cast_overflow_fails_in_every_session(spark, ansi, value):
    df = spark.range(1).select(F.lit(value).alias("passenger_count"))
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        with pytest.raises(Exception, match="passenger_count does not fit int"):
            df.select(conform.strict_cast("passenger_count", "int", df.schema)).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_cast_keeps_null_and_truncates(spark):
    df = spark.sql("SELECT * FROM VALUES (1.7D), (CAST(NULL AS DOUBLE)), (-0.5D) AS t(n)")
    found = df.select(conform.strict_cast("n", "int", df.schema)).collect()
    assert [r[0] for r in found] == [1, None, 0]


def test_steps_add_up_to_conform(spark):
    source = DATASET.source("green")
    df = raw(spark, "green", "2023-02")
    renamed = conform.rename(df, source, "2023-02", TABLE)
    assert {"tpep_pickup_datetime", "tpep_dropoff_datetime"} <= set(renamed.columns)
    stepwise = conform.canonical_cast(conform.fill_absent(renamed, source, TABLE), TABLE)
    spelling = source.spelling("2023-02", TABLE)
    at_once = conform.conform(df, source, TABLE, spelling, F.lit("2023-02"))
    assert stepwise.collect() == at_once.select(*TABLE.columns).collect()
