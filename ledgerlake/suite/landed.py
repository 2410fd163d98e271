"""Landing audit: expected files, what is there, what to refresh, what is whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake import taxi
from ledgerlake.sources import landing
from ledgerlake.suite import fixtures
from ledgerlake.suite.sqltext import trips as over_trips

_ABSENT, _UNKNOWN, _CHANGED = "1997-07", "1998-01", "1996-07"
_NAMES = {"scope": taxi.FLEET, "month": taxi.FILE_MONTH}


def _month_grid(spark: SparkSession, sf_dir: str, months_ahead: int) -> DataFrame:
    """Every month from the first to the last one of each fleet, and some after it."""
    rows = fixtures.trips(spark, sf_dir)
    last = F.add_months(F.to_date(F.concat(F.max(taxi.FILE_MONTH), F.lit("-01"))), months_ahead)
    bounds = rows.groupBy(F.col(taxi.FLEET).alias("scope")).agg(
        F.min(taxi.FILE_MONTH).alias("first"), F.date_format(last, "yyyy-MM").alias("last")
    )
    return landing.month_grid(bounds, "first", "last")


def _expected(spark: SparkSession, sf_dir: str, months_ahead: int = 1) -> DataFrame:
    grid = _month_grid(spark, sf_dir, months_ahead)
    return landing.manifest(grid, fixtures.LAYOUT, "/landing")


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = landing.listing(spark, fixtures.landing_root(spark, sf_dir))
    return landing.source_sizes(files, fixtures.LAYOUT)


def landing_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = _month_grid(spark, sf_dir, months_ahead=0)
    return landing.manifest(grid, taxi.LAYOUT, "/landing/").withColumnsRenamed(_NAMES)


def landing_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = landing.inventory(_expected(spark, sf_dir), _sizes(spark, sf_dir))
    landed = F.coalesce(F.col("local_bytes") > 0, F.lit(False))
    return found.select("scope", "month", "file", landed.alias("landed")).withColumnsRenamed(_NAMES)


def landing_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    absent = landing.missing(_expected(spark, sf_dir, 2), _sizes(spark, sf_dir))
    return absent.withColumnsRenamed(_NAMES)


def _sized_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes per source added up from the trips, with absent, unknown and changed ones."""
    size = F.sum(F.col("PULocationID").cast("long"))
    month = F.col(taxi.FILE_MONTH)
    return (
        fixtures.trips(spark, sf_dir)
        .groupBy(F.col(taxi.FLEET).alias("scope"), month.alias("month"))
        .agg(size.alias("bytes"))
        .select(
            "scope",
            "month",
            F.when(F.col("month") != _ABSENT, F.col("bytes")).alias("local_bytes"),
            F.when(F.col("month") == _UNKNOWN, None)
            .when(F.col("month") == _CHANGED, F.col("bytes") + 1)
            .otherwise(F.col("bytes"))
            .alias("expected_bytes"),
        )
    )


def landing_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = landing.refresh_decisions(
        _sized_listing(spark, sf_dir), "local_bytes", "expected_bytes"
    )
    return decided.withColumnsRenamed(_NAMES)


def landing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = landing.refresh_decisions(
        _sized_listing(spark, sf_dir), "local_bytes", "expected_bytes"
    )
    return landing.outcome_summary(decided, "local_bytes")


def landing_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yellow is whole; green lacks a file; no total is known for vendor 1."""
    rows = fixtures.trips(spark, sf_dir)
    size = F.sum(F.col("PULocationID").cast("long"))
    absent = (F.col("scope") == "green") & (F.col("month") == _ABSENT)
    files = (
        rows.groupBy(F.col(taxi.FLEET).alias("scope"), F.col(taxi.FILE_MONTH).alias("month"))
        .agg(size.alias("bytes"))
        .select("scope", "month", F.when(~absent, F.col("bytes")).alias("local_bytes"))
    )
    vendor = rows.filter("VendorID = 1").groupBy(F.col(taxi.FILE_MONTH).alias("month")).agg(
        size.alias("local_bytes")
    )
    files = files.unionByName(vendor.withColumn("scope", F.lit("vendor_1")))
    totals = rows.groupBy(F.col(taxi.FLEET).alias("scope")).agg(size.alias("expected_bytes"))
    return landing.integrity(files, totals).withColumnRenamed("scope", taxi.FLEET)


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed sources with their listed bytes and declared ones: some absent, unknown or changed.

    What is declared is the size that the files had when they were landed, which the listing of the
    whole folder tells; what is there is the listing of the requested paths.
    """
    root = fixtures.landing_root(spark, sf_dir)
    declared = _sizes(spark, sf_dir).select(
        "scope",
        "month",
        F.when(F.col("month") == _UNKNOWN, None)
        .when(F.col("month") == _CHANGED, F.col("local_bytes") + 1)
        .otherwise(F.col("local_bytes"))
        .alias("expected_bytes"),
    )
    requested = _month_grid(spark, sf_dir, 0).join(declared, ["scope", "month"], "left_semi")
    manifest = landing.manifest(requested, fixtures.LAYOUT, root)
    held_back = landing.requested_listing(spark, manifest.filter(F.col("month") != _ABSENT))
    there = landing.source_sizes(held_back, fixtures.LAYOUT)
    return landing.inventory(manifest, there).join(declared, ["scope", "month"])


def landed_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on landed files by their real sizes."""
    decided = landing.refresh_decisions(_listed(spark, sf_dir), "local_bytes", "expected_bytes")
    return decided.select(
        "scope", "month", "file", F.col("local_bytes").isNotNull().alias("landed"), "status"
    ).withColumnsRenamed(_NAMES)


def landed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by decision, and whether their bytes are those of a listing of the whole folder."""
    decided = landing.refresh_decisions(_listed(spark, sf_dir), "local_bytes", "expected_bytes")
    summary = landing.outcome_summary(decided, "local_bytes")
    whole = _sizes(spark, sf_dir).filter(F.col("month") != _ABSENT)
    again = whole.select(
        F.when(F.col("month").isin(_UNKNOWN, _CHANGED), landing.REFRESH)
        .otherwise(landing.SKIP)
        .alias("status"),
        F.col("local_bytes").alias("again"),
    )
    told = again.groupBy("status").agg(F.sum("again").alias("again"))
    return summary.join(told, "status").select(
        "status", "files", (F.col("bytes") == F.col("again")).alias("bytes_as_listed")
    )


def landed_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both fleets by real bytes: as landed, with a source held back, and with a wrong total."""
    root = fixtures.landing_root(spark, sf_dir)
    requested = _month_grid(spark, sf_dir, 0).join(_sizes(spark, sf_dir), ["scope", "month"], "left_semi")
    manifest = landing.manifest(requested, fixtures.LAYOUT, root)
    files = landing.inventory(
        manifest, landing.source_sizes(landing.requested_listing(spark, manifest), fixtures.LAYOUT)
    )
    cases = F.explode(F.array(*(F.lit(c) for c in ("as_landed", "held_back", "other_total"))))
    each = files.withColumn("case", cases).withColumn("scope", F.concat_ws("/", "case", "scope"))
    held_back = (F.col("case") == "held_back") & (F.col("month") == _ABSENT)
    totals = each.groupBy("scope", "case").agg(F.sum("local_bytes").alias("bytes"))
    known = totals.select(
        "scope", (F.col("bytes") + (F.col("case") == "other_total").cast("int")).alias("expected_bytes")
    )
    there = each.withColumn("local_bytes", F.when(~held_back, F.col("local_bytes")))
    return landing.integrity(there, known).select(
        F.substring_index("scope", "/", 1).alias("case"),
        F.substring_index("scope", "/", -1).alias(taxi.FLEET),
        "files",
        "missing_files",
        "intact",
    )


_GRID = """grid AS (SELECT taxi_type, strftime(unnest(generate_series(
    CAST(min(source_year_month) || '-01' AS TIMESTAMP),
    CAST(max(source_year_month) || '-01' AS TIMESTAMP) + {ahead} * INTERVAL '1' MONTH,
    INTERVAL '1' MONTH)), '%Y-%m') AS source_year_month FROM trips GROUP BY taxi_type)"""
_FILE = "taxi_type || '_tripdata_' || source_year_month || '.parquet'"
_LISTING = f"""listing AS (SELECT taxi_type, source_year_month,
    CASE WHEN source_year_month <> '{_ABSENT}' THEN bytes END AS local_bytes,
    CASE WHEN source_year_month = '{_UNKNOWN}' THEN NULL WHEN source_year_month = '{_CHANGED}'
      THEN bytes + 1 ELSE bytes END AS expected_bytes
  FROM (SELECT taxi_type, source_year_month, CAST(sum(PULocationID) AS BIGINT) AS bytes
        FROM trips GROUP BY ALL)),
  decided AS (SELECT *, CASE WHEN local_bytes IS NOT NULL AND expected_bytes IS NOT NULL
      AND local_bytes = expected_bytes THEN 'skip' ELSE 'refresh' END AS status FROM listing)"""


QUERIES = {
    "landing_manifest": landing_manifest,
    "landing_inventory": landing_inventory,
    "landing_missing": landing_missing,
    "landing_refresh": landing_refresh,
    "landing_integrity": landing_integrity,
    "landing_summary": landing_summary,
    "landed_refresh": landed_refresh,
    "landed_summary": landed_summary,
    "landed_integrity": landed_integrity,
}

ORACLES = {
    "landing_manifest": over_trips(
        f"""SELECT taxi_type, source_year_month, {_FILE} AS file,
    '/landing/' || taxi_type || '/' || substr(source_year_month, 1, 4) || '/' || {_FILE} AS path
  FROM grid""",
        _GRID.format(ahead=0),
    ),
    "landing_inventory": over_trips(
        f"""SELECT taxi_type, source_year_month, {_FILE} AS file,
    (taxi_type, source_year_month) IN (SELECT taxi_type, source_year_month FROM trips) AS landed
  FROM grid""",
        _GRID.format(ahead=1),
    ),
    "landing_missing": over_trips(
        f"""SELECT taxi_type, source_year_month, {_FILE} AS file,
    '/landing/fleet=' || taxi_type || '/month=' || source_year_month AS path
  FROM grid ANTI JOIN trips USING (taxi_type, source_year_month)""",
        _GRID.format(ahead=2),
    ),
    "landing_refresh": over_trips("SELECT * FROM decided", _LISTING),
    "landing_summary": over_trips(
        """SELECT status, count(*) AS files, CAST(coalesce(sum(local_bytes), 0) AS BIGINT) AS bytes
  FROM decided GROUP BY status""",
        _LISTING,
    ),
    "landed_refresh": over_trips(
        f"""SELECT taxi_type, source_year_month, {_FILE} AS file,
    local_bytes IS NOT NULL AS landed, status FROM decided""",
        _LISTING,
    ),
    "landed_summary": over_trips(
        "SELECT status, count(*) AS files, true AS bytes_as_listed FROM decided GROUP BY status",
        _LISTING,
    ),
    "landed_integrity": over_trips(
        f"""SELECT "case", taxi_type, files,
    CASE WHEN "case" = 'held_back' THEN absent ELSE 0 END AS missing_files,
    "case" = 'as_landed' OR ("case" = 'held_back' AND absent = 0) AS intact
  FROM sources CROSS JOIN (VALUES ('as_landed'), ('held_back'), ('other_total')) AS c("case")""",
        f"""sources AS (SELECT taxi_type, count(DISTINCT source_year_month) AS files,
    count(DISTINCT source_year_month) FILTER (source_year_month = '{_ABSENT}') AS absent
    FROM trips GROUP BY taxi_type)""",
    ),
    "landing_integrity": over_trips(
        """SELECT taxi_type, files, missing_files, local_bytes, expected_bytes,
    coalesce(missing_files = 0 AND local_bytes = expected_bytes, false) AS intact
  FROM found LEFT JOIN totals USING (taxi_type)""",
        f"""sizes AS (SELECT taxi_type, source_year_month, CASE WHEN taxi_type = 'green'
      AND source_year_month = '{_ABSENT}' THEN NULL ELSE sum(PULocationID) END AS local_bytes
    FROM trips GROUP BY taxi_type, source_year_month
    UNION ALL SELECT 'vendor_1', source_year_month, sum(PULocationID) FROM trips
    WHERE VendorID = 1 GROUP BY source_year_month),
  found AS (SELECT taxi_type, count(*) AS files, count(*) FILTER (local_bytes IS NULL)
      AS missing_files, CAST(sum(local_bytes) AS BIGINT) AS local_bytes
    FROM sizes GROUP BY taxi_type),
  totals AS (SELECT taxi_type, CAST(sum(PULocationID) AS BIGINT) AS expected_bytes
    FROM trips GROUP BY taxi_type)""",
    ),
}
