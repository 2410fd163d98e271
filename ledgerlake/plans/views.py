"""Published views: the two answers as SQL over the clean table, and as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake import taxi
from ledgerlake.operators import answers
from ledgerlake.plans import sinks

CONFORMED = "trips_conformed"
TRIPS = "trips"
REJECTED_TRIPS = "trips_rejected"
METRICS = "dq_metrics"

_MONTH_COMMENTS = {
    taxi.PICKUP_MONTH: "Pickup month, yyyy-MM",
    taxi.MONTH_MEAN: "Mean total amount of clean yellow trips, two digits",
    taxi.TRIPS: "Clean yellow trips of the month",
}
_HOUR_COMMENTS = {
    taxi.SCOPE: "Fleets counted: all of them, or yellow only",
    taxi.PICKUP_HOUR: "Pickup hour, 0 to 23",
    taxi.HOUR_MEAN: "Mean passengers per clean trip, three digits",
    taxi.TRIPS: "Clean trips of the hour",
}


def month_view_sql(trips: str, fleet: str = "yellow") -> str:
    return f"""
        SELECT {taxi.PICKUP_MONTH}, round(avg(total_amount), 2) AS {taxi.MONTH_MEAN},
               count(*) AS {taxi.TRIPS}
        FROM {trips} WHERE {taxi.FLEET} = '{fleet}' GROUP BY {taxi.PICKUP_MONTH}"""


def hour_view_sql(trips: str, month: str, fleet: str = "yellow") -> str:
    """Both scopes from one scan: sums per hour and fleet first, then the scopes over those."""
    return f"""
        WITH per_fleet AS (
            SELECT {taxi.PICKUP_HOUR}, {taxi.FLEET}, sum(passenger_count) AS passengers,
                   count(passenger_count) AS known, count(*) AS trips
            FROM {trips} WHERE {taxi.PICKUP_MONTH} = '{month}'
            GROUP BY {taxi.PICKUP_HOUR}, {taxi.FLEET})
        SELECT {taxi.SCOPE}, {taxi.PICKUP_HOUR},
               round(try_divide(sum(passengers), sum(known)), 3) AS {taxi.HOUR_MEAN},
               sum(trips) AS {taxi.TRIPS}
        FROM per_fleet
        LATERAL VIEW explode(if({taxi.FLEET} = '{fleet}', array('{taxi.ALL_FLEETS}', '{fleet}'),
                                array('{taxi.ALL_FLEETS}'))) AS {taxi.SCOPE}
        GROUP BY {taxi.SCOPE}, {taxi.PICKUP_HOUR}"""


def publish(spark: SparkSession, warehouse, hour_month: str) -> None:
    trips = warehouse.name(TRIPS)
    sinks.publish_view(
        spark, warehouse.name(taxi.MONTH_VIEW), month_view_sql(trips), _MONTH_COMMENTS
    )
    sinks.publish_view(
        spark, warehouse.name(taxi.HOUR_VIEW), hour_view_sql(trips, hour_month), _HOUR_COMMENTS
    )


def month_average(trips: DataFrame, fleet: str = "yellow") -> DataFrame:
    """The month answer through the DataFrame API."""
    return answers.group_average(
        trips.filter(F.col(taxi.FLEET) == fleet),
        taxi.PICKUP_MONTH,
        "total_amount",
        2,
        taxi.MONTH_MEAN,
        taxi.TRIPS,
    )


def hour_average(trips: DataFrame, month: str) -> DataFrame:
    """The hour answer through the DataFrame API."""
    return answers.scoped_average(
        trips.filter(F.col(taxi.PICKUP_MONTH) == month),
        taxi.PICKUP_HOUR,
        taxi.FLEET,
        "passenger_count",
        taxi.SCOPES,
        3,
        taxi.SCOPE,
        taxi.HOUR_MEAN,
        taxi.TRIPS,
    )
