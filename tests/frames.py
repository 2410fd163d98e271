"""Small hand-made inputs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ledgerlake import taxi

TRIP_DDL = (
    "VendorID int, tpep_pickup_datetime timestamp_ntz, tpep_dropoff_datetime timestamp_ntz, "
    "passenger_count int, total_amount double, taxi_type string, source_year_month string"
)


def at(text: str | None) -> datetime | None:
    return None if text is None else datetime.fromisoformat(text)


def trips(spark, rows):
    """Rows (vendor, pickup, dropoff, passengers, amount, fleet, file month)."""
    return spark.createDataFrame(
        [(v, at(p), at(d), n, a, f, m) for v, p, d, n, a, f, m in rows], TRIP_DDL
    )


# Clean; each rule broken alone, in the order R1 to R4; R1 and R4 at once; clean in the other fleet.
SEVEN = [
    (6, "2023-04-02 09:10", "2023-04-02 09:55", 2, 31.5, "yellow", "2023-04"),
    (7, "2001-06-30 05:15", "2023-02-02 02:45", 4, 12.25, "yellow", "2023-02"),
    (6, "2023-05-11 16:30", "2023-05-11 16:30", 1, 9.75, "yellow", "2023-05"),
    (7, "2023-01-09 13:20", "2023-01-09 13:50", 3, -42.5, "yellow", "2023-01"),
    (6, "2023-03-28 21:00", "2023-03-28 21:15", 0, 18.0, "yellow", "2023-03"),
    (2, "2041-07-04 00:05", "2041-07-04 00:20", None, 66.0, "yellow", "2023-05"),
    (6, "2023-05-31 03:40", "2023-05-31 04:30", 5, 72.25, "green", "2023-05"),
]

R1, R2, R3, R4 = taxi.RULE_NAMES.values()
SEVEN_REASONS = [None, R1, R2, R3, R4, R1, None]


def rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


def land(spark, root: str, dataset, data) -> list[tuple[str, str]]:
    """Land rows as raw monthly sources of their fleet and file month; returns those."""
    df = trips(spark, data)
    partitions = sorted({(row[5], row[6]) for row in data})
    for fleet, month in partitions:
        spelling = dataset.source(fleet).spelling(month, dataset.table)
        absent = {c: t for c, t in dataset.table.columns.items() if c not in df.columns}
        raw = (
            df.filter((df.taxi_type == fleet) & (df.source_year_month == month))
            .withColumns({c: F.lit(None).cast(t) for c, t in absent.items()})
            .select(*(F.col(name).alias(spelled) for name, spelled in spelling.items()))
        )
        path = dataset.layout.source_path(root, fleet, month)
        raw.coalesce(1).write.mode("overwrite").parquet(path)
    return partitions
