"""Conforming drifting sources, and writing partitions that can be repeated."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake import taxi
from ledgerlake.operators import conform
from ledgerlake.plans import batch, sinks
from ledgerlake.session import fresh_dir
from ledgerlake.sources import files
from ledgerlake.suite import fixtures
from ledgerlake.suite.sqltext import trips as over_trips

_DATASET = fixtures.DATASET
_TABLE = _DATASET.table
_REPROCESSED_SINCE = "1998-01"
_EMPTIED = "1998-07"


def _conformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform.conform_sources(spark, fixtures.landed_sources(spark, sf_dir), _DATASET)


def _per_variant(spark: SparkSession, sf_dir: str, step) -> DataFrame:
    """``step(df, source, month)`` on each schema variant, with its fleet and file month."""
    parts = []
    for variant in files.variants(fixtures.landed_sources(spark, sf_dir), _DATASET):
        raw = variant.read(spark).withColumn(taxi.FILE_MONTH, files.file_month(fixtures.LAYOUT))
        done = step(raw, _DATASET.source(variant.scope), variant.sources[0].month)
        parts.append(done.withColumn(taxi.FLEET, F.lit(variant.scope)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _renamed(raw: DataFrame, source, month: str) -> DataFrame:
    return conform.rename(raw, source, month, _TABLE)


def _filled(raw: DataFrame, source, month: str) -> DataFrame:
    return conform.fill_absent(_renamed(raw, source, month), source, _TABLE)


def _typed(raw: DataFrame, source, month: str) -> DataFrame:
    return conform.canonical_cast(_filled(raw, source, month), _TABLE)


def conform_drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = fixtures.landed_sources(spark, sf_dir)
    report = conform.drift_report(spark, sources, fixtures.misdeclared())
    return report.select(
        F.col("scope").alias(taxi.FLEET),
        F.col("month").alias(taxi.FILE_MONTH),
        "column_name",
        "kind",
    )


def conform_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _per_variant(spark, sf_dir, _renamed)
        .groupBy(taxi.FLEET, taxi.FILE_MONTH)
        .agg(
            F.count(F.lit(1)).alias("linhas"),
            F.count("airport_fee").alias("airport_fees"),
            F.min(taxi.PICKUP).alias("first_pickup"),
            F.max(taxi.DROPOFF).alias("last_dropoff"),
        )
    )


def conform_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = ("airport_fee", "ehail_fee", "trip_type")
    return (
        _per_variant(spark, sf_dir, _filled)
        .groupBy(taxi.FLEET)
        .agg(F.count(F.lit(1)).alias("linhas"), *(F.count(c).alias(c) for c in filled))
    )


def conform_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    cast = ("VendorID", "passenger_count")
    return (
        _per_variant(spark, sf_dir, _typed)
        .groupBy(taxi.FLEET, taxi.FILE_MONTH)
        .agg(
            *(F.sum(c).alias(c) for c in cast),
            *(F.max(F.typeof(c)).alias(f"{c}_type") for c in cast),
        )
    )


def conform_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    loaded = F.every(F.col(taxi.LOADED_AT).isNotNull())
    return (
        _conformed(spark, sf_dir)
        .groupBy(taxi.FLEET, taxi.FILE_MONTH)
        .agg(F.count(F.lit(1)).alias("linhas"), loaded.alias("loaded"))
    )


def conform_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conformed(spark, sf_dir).drop(taxi.LOADED_AT)


def _bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.conformed(spark, _DATASET, fixtures.stored(spark, sf_dir))


def bronze_partition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = conform.partition_counts(_bronze(spark, sf_dir), _TABLE)
    return counts.orderBy(taxi.FLEET, taxi.FILE_MONTH)


def bronze_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform.total_count(_bronze(spark, sf_dir))


def exclusive_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform.exclusive_columns(_bronze(spark, sf_dir), _DATASET.sources.values(), _TABLE)


def sink_partition_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all partitions, reprocess the later yellow ones (one gets no rows), read back."""
    path = fresh_dir(spark, "reprocessed")
    keys = (taxi.FLEET, taxi.FILE_MONTH)
    everything = fixtures.landed_partitions(spark, sf_dir)
    bronze = _bronze(spark, sf_dir)
    sinks.write_partitions(bronze, path, keys, everything)

    again = [(f, m) for f, m in everything if f == "yellow" and m >= _REPROCESSED_SINCE]
    changed = bronze.filter(
        (F.col(taxi.FLEET) == "yellow")
        & (F.col(taxi.FILE_MONTH) >= _REPROCESSED_SINCE)
        & (F.col(taxi.FILE_MONTH) != _EMPTIED)
    ).withColumn("VendorID", F.col("VendorID") + 10)
    sinks.write_partitions(changed, path, keys, again)

    stored = spark.read.schema(_TABLE.ddl()).parquet(path)
    return stored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("linhas"), F.sum("VendorID").alias("vendors")
    )


def sink_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overwrite the ten quarantine columns with the eight clean ones and read back."""
    path = fresh_dir(spark, "overwritten")
    sinks.overwrite(fixtures.rejected(spark, sf_dir), path)
    sinks.overwrite(fixtures.clean(spark, sf_dir), path)
    stored = spark.read.parquet(path)
    return stored.groupBy(taxi.FLEET, taxi.PICKUP_MONTH).agg(
        F.count(F.lit(1)).alias("linhas"),
        F.lit(len(stored.columns)).alias("columns"),
        F.round(F.sum("total_amount"), 2).alias("total_amount"),
    )


QUERIES = {
    "conform_drift_report": conform_drift_report,
    "conform_rename": conform_rename,
    "conform_fill": conform_fill,
    "conform_cast": conform_cast,
    "conform_lineage": conform_lineage,
    "conform_union": conform_union,
    "bronze_partition_counts": bronze_partition_counts,
    "bronze_total": bronze_total,
    "exclusive_columns": exclusive_columns,
    "sink_partition_overwrite": sink_partition_overwrite,
    "sink_overwrite": sink_overwrite,
}

ORACLES = {
    "conform_drift_report": over_trips(
        f"""SELECT DISTINCT taxi_type, source_year_month, column_name, kind FROM trips
  CROSS JOIN (VALUES ('Airport_fee', 'unexpected'), ('airport_fee', 'missing'))
    AS d(column_name, kind)
  WHERE taxi_type = 'yellow' AND source_year_month >= '{fixtures.CAPITAL_FEE_SINCE}'
    AND source_year_month < '1998-01'"""
    ),
    "conform_rename": over_trips(
        """SELECT taxi_type, source_year_month, count(*) AS linhas, count(airport_fee)
    AS airport_fees, min(tpep_pickup_datetime) AS first_pickup,
    max(tpep_dropoff_datetime) AS last_dropoff FROM trips GROUP BY ALL"""
    ),
    "conform_fill": over_trips(
        """SELECT taxi_type, count(*) AS linhas, count(airport_fee) AS airport_fee,
    count(ehail_fee) AS ehail_fee, count(trip_type) AS trip_type FROM trips GROUP BY ALL"""
    ),
    "conform_cast": over_trips(
        """SELECT taxi_type, source_year_month, CAST(sum(VendorID) AS BIGINT) AS VendorID,
    CAST(sum(passenger_count) AS BIGINT) AS passenger_count, 'int' AS VendorID_type,
    'int' AS passenger_count_type FROM trips GROUP BY taxi_type, source_year_month"""
    ),
    "conform_lineage": over_trips(
        """SELECT taxi_type, source_year_month, count(*) AS linhas, true AS loaded
  FROM trips GROUP BY taxi_type, source_year_month"""
    ),
    "conform_union": over_trips("SELECT * FROM trips"),
    "bronze_partition_counts": over_trips(
        """SELECT taxi_type, source_year_month, count(*) AS linhas FROM trips GROUP BY ALL
  ORDER BY ALL"""
    ),
    "bronze_total": over_trips("SELECT count(*) AS linhas FROM trips"),
    "exclusive_columns": over_trips(
        """SELECT count(*) AS linhas FROM trips
  WHERE (taxi_type = 'yellow' AND (ehail_fee IS NOT NULL OR trip_type IS NOT NULL))
     OR (taxi_type = 'green' AND airport_fee IS NOT NULL)"""
    ),
    "sink_partition_overwrite": over_trips(
        f"""SELECT taxi_type, source_year_month, count(*) AS linhas, CAST(sum(VendorID +
    CASE WHEN taxi_type = 'yellow' AND source_year_month >= '{_REPROCESSED_SINCE}'
         THEN 10 ELSE 0 END) AS BIGINT) AS vendors
  FROM trips WHERE NOT (taxi_type = 'yellow' AND source_year_month = '{_EMPTIED}')
  GROUP BY taxi_type, source_year_month"""
    ),
    "sink_overwrite": over_trips(
        """SELECT taxi_type, pickup_year_month, count(*) AS linhas, 8 AS columns,
    round(sum(total_amount), 2) AS total_amount FROM gold GROUP BY taxi_type, pickup_year_month"""
    ),
}
