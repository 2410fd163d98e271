"""Trips derived from the given tables, whole and by formula, the same in Spark and DuckDB.

``TRIPS`` reads ``lineitem`` alone: no join, so what is measured and scaled is the operator under
test. ``EVENT_TRIPS`` reads ``events``. Missing, negative and out-of-window values come from the
formulas. A file holds half a year and carries its first month, so file month and pickup month
differ. Landing folders and stored tables are written from these once per session.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake import taxi
from ledgerlake.operators import quality
from ledgerlake.plans import batch, sinks
from ledgerlake.session import fresh_dir
from ledgerlake.sources import files, landing
from ledgerlake.spec import Dataset, Layout

TRIPS = """
SELECT CAST(l_suppkey % 2 + 1 AS INT) AS VendorID,
 CASE WHEN l_orderkey % 101 = 0 THEN NULL
      ELSE l_shipdate + (l_partkey % 24 - CASE WHEN l_suppkey % 29 = 0 THEN 72 ELSE 0 END)
           * INTERVAL '1' HOUR END AS tpep_pickup_datetime,
 CASE WHEN l_orderkey % 103 = 0 THEN NULL
      ELSE l_shipdate + (l_partkey % 24 - CASE WHEN l_suppkey % 29 = 0 THEN 72 ELSE 0 END
           + l_linenumber - 2) * INTERVAL '1' HOUR END AS tpep_dropoff_datetime,
 CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_quantity AS INT) % 8 END AS passenger_count,
 l_extendedprice / 1000.0 AS trip_distance,
 CASE WHEN l_partkey % 50 = 0 THEN 99 ELSE CAST(l_suppkey % 6 + 1 AS INT) END AS RatecodeID,
 CASE WHEN l_linestatus = 'F' THEN 'Y' ELSE 'N' END AS store_and_fwd_flag,
 CAST(l_partkey % 263 + 1 AS INT) AS PULocationID,
 CAST(l_suppkey % 263 + 1 AS INT) AS DOLocationID,
 CASE WHEN l_linenumber = 7 THEN 0 ELSE CAST(l_suppkey % 6 + 1 AS INT) END AS payment_type,
 l_extendedprice AS fare_amount,
 l_discount * 10 AS extra,
 CAST(0.5 AS DOUBLE) AS mta_tax,
 l_extendedprice * l_discount AS tip_amount,
 l_tax * 100 AS tolls_amount,
 CAST(1 AS DOUBLE) AS improvement_surcharge,
 CASE WHEN l_returnflag = 'R' AND l_tax = 0.0 THEN -l_extendedprice ELSE l_extendedprice END
  AS total_amount,
 CASE WHEN l_linestatus = 'F' THEN CAST(2.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
  AS congestion_surcharge,
 CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_tax * 10 END AS airport_fee,
 CASE WHEN l_returnflag = 'A' THEN l_discount ELSE NULL END AS ehail_fee,
 CASE WHEN l_returnflag = 'A' THEN CAST(l_linenumber % 2 + 1 AS INT) ELSE NULL END AS trip_type,
 CASE WHEN l_returnflag = 'A' THEN 'green' ELSE 'yellow' END AS taxi_type,
 SUBSTRING(CAST(l_shipdate AS STRING), 1, 4)
  || CASE WHEN SUBSTRING(CAST(l_shipdate AS STRING), 6, 2) < '07' THEN '-01' ELSE '-07' END
  AS source_year_month
FROM {lineitem}"""

EVENT_TRIPS = """
SELECT CAST(user_id % 2 + 1 AS INT) AS VendorID, ts AS tpep_pickup_datetime,
 ts + (event_id % 11 - 1) * INTERVAL '1' MINUTE AS tpep_dropoff_datetime,
 CASE WHEN user_id % 13 = 0 THEN NULL ELSE CAST(user_id % 6 AS INT) END AS passenger_count,
 CASE WHEN event_id % 97 = 0 THEN NULL ELSE value - 2.0 END AS total_amount,
 CASE WHEN event_type IN ('click', 'view') THEN 'yellow' ELSE 'green' END AS taxi_type,
 '2024-01' AS source_year_month
FROM {events}"""

WINDOW = ("1996-01-01 00:00:00", "1999-01-01 00:00:00")
EVENT_WINDOW = ("2024-01-02 00:00:00", "2024-01-30 00:00:00")
EVENT_MONTH = "2024-01"
HOUR_MONTH = "1997-05"

# Files are landed as one folder per source; the airport fee is spelled with a capital since:
LAYOUT = Layout(file=taxi.LAYOUT.file, path="{root}/fleet={scope}/month={month}")
CAPITAL_FEE_SINCE = "1997-01"

DATASET = taxi.dataset(
    window=WINDOW,
    layout=LAYOUT,
    capital_fee_since=CAPITAL_FEE_SINCE,
    months=(),
    expected_bytes={},
)
EVENT_RULES = taxi.quality_rules(EVENT_WINDOW)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TRIPS, lineitem=table(spark, sf_dir, "lineitem"))


def event_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(EVENT_TRIPS, events=table(spark, sf_dir, "events"))


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(trips(spark, sf_dir), DATASET.rules, DATASET.violated_rule)


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.clean_rows(classified(spark, sf_dir), DATASET.violated_rule)
    return quality.project(rows, DATASET.clean)


def rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.rejected_rows(classified(spark, sf_dir), DATASET.violated_rule)
    return quality.project(rows, DATASET.rejected)


def event_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = quality.classify(event_trips(spark, sf_dir), EVENT_RULES, taxi.VIOLATED_RULE)
    return quality.project(quality.clean_rows(marked, taxi.VIOLATED_RULE), taxi.CLEAN)


# --- written once per session -------------------------------------------------------------

_written: dict[tuple[str, str, str], object] = {}


def _once(spark: SparkSession, sf_dir: str, what: str, make):
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _written:
        _written[key] = make()
    return _written[key]


def landing_root(spark: SparkSession, sf_dir: str) -> str:
    """Folder with the whole trips landed as drifting monthly sources."""
    return _once(spark, sf_dir, "landing", lambda: _land(spark, sf_dir))


def _land(spark: SparkSession, sf_dir: str) -> str:
    root = fresh_dir(spark, "landing")
    rows = trips(spark, sf_dir)
    fleet, month = F.col(taxi.FLEET), F.col(taxi.FILE_MONTH)
    wide = {"VendorID": "bigint", "passenger_count": "double"}
    narrow = {"VendorID": "int", "passenger_count": "bigint"}
    _land_part(rows.filter((fleet == "yellow") & (month < CAPITAL_FEE_SINCE)), root, "yellow", wide)
    _land_part(
        rows.filter((fleet == "yellow") & (month >= CAPITAL_FEE_SINCE)), root, "yellow", narrow
    )
    _land_part(rows.filter(fleet == "green"), root, "green", narrow)
    return root


def _land_part(rows: DataFrame, root: str, fleet: str, types: dict[str, str]) -> None:
    """Raw shape of one fleet: its own spellings, types and columns; no lineage."""
    capital = types["VendorID"] == "int"
    month = CAPITAL_FEE_SINCE if capital else ""
    spelling = DATASET.source(fleet).spelling(month, DATASET.table)
    raw = rows.select(
        *(F.col(c).cast(types.get(c, t)).alias(spelling[c])
          for c, t in DATASET.table.columns.items() if c in spelling),
        F.col(taxi.FLEET).alias("fleet"),
        F.col(taxi.FILE_MONTH).alias("month"),
    )
    # neither shuffled nor sorted: a task adds a file to each month it has rows of
    with sinks.open_side_by_side(rows.sparkSession):
        raw.write.mode("append").partitionBy("fleet", "month").parquet(root)


def landed_partitions(spark: SparkSession, sf_dir: str) -> list[tuple[str, str]]:
    """The (fleet, month) sources found in the landing folder: one entry per source."""

    def find():
        listed = landing.listing(spark, landing_root(spark, sf_dir))
        found = landing.source_sizes(listed, LAYOUT).select("scope", "month").collect()
        return sorted((row["scope"], row["month"]) for row in found)

    return _once(spark, sf_dir, "partitions", find)


def landed_dataset(spark: SparkSession, sf_dir: str) -> Dataset:
    """The declaration with the months and bytes that were landed, so that a full run judges them."""

    def look_up() -> Dataset:
        listed = landing.listing(spark, landing_root(spark, sf_dir))
        sizes = landing.source_sizes(listed, LAYOUT)
        totals = sizes.groupBy("scope").agg(F.sum("local_bytes").alias("bytes")).collect()
        months = sorted({m for _, m in landed_partitions(spark, sf_dir)})
        return replace(
            DATASET, months=tuple(months), expected_bytes={r["scope"]: r["bytes"] for r in totals}
        )

    return _once(spark, sf_dir, "dataset", look_up)


def landed_sources(spark: SparkSession, sf_dir: str) -> list[files.LandedSource]:
    """Sources of the landing folder with their footer schemas; landed files never change."""

    def look_up():
        root, found = landing_root(spark, sf_dir), landed_partitions(spark, sf_dir)
        return files.landed_sources(spark, DATASET, root, found)

    return _once(spark, sf_dir, "sources", look_up)


def stored(spark: SparkSession, sf_dir: str) -> batch.Warehouse:
    """Warehouse after a full run over the landing folder."""

    def build():
        root = fresh_dir(spark, "warehouse")
        warehouse = batch.Warehouse(root, f"run_{root[-12:]}")
        batch.run(
            spark,
            landed_dataset(spark, sf_dir),
            landing_root(spark, sf_dir),
            warehouse,
            landed_partitions(spark, sf_dir),
            HOUR_MONTH,
        )
        return warehouse

    return _once(spark, sf_dir, "warehouse", build)


def misdeclared() -> Dataset:
    """The declaration with a wrong month for the capital spelling, to produce drift."""
    return replace(DATASET, sources=taxi.sources(capital_fee_since="1998-01"))
