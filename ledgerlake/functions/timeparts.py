"""Month and hour of wall-clock timestamps, whatever the session time zone is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_sql(column: str) -> str:
    """``yyyy-MM`` of a TIMESTAMP_NTZ.

    Formatting a TIMESTAMP_NTZ directly passes through the session zone and moves the hours a
    daylight-saving change skips; going through DATE keeps the calendar month in every zone.
    """
    return f"date_format(CAST({column} AS DATE), 'yyyy-MM')"


def hour_sql(column: str) -> str:
    return f"hour({column})"


def days_in_month(month: str) -> Column:
    """Number of days of a ``yyyy-MM`` month."""
    return F.day(F.last_day(F.to_date(F.lit(f"{month}-01"))))
