"""Pieces of the DuckDB SQL that the registered queries are checked against."""

from __future__ import annotations

from ledgerlake import taxi
from ledgerlake.suite.fixtures import EVENT_TRIPS, EVENT_WINDOW, TRIPS, WINDOW

R1, R2, R3, R4 = taxi.RULE_NAMES.values()


def _classified(source: str, window) -> str:
    start, end = window
    return f"""SELECT *, CASE
   WHEN tpep_pickup_datetime IS NULL OR tpep_pickup_datetime < TIMESTAMP '{start}'
     OR tpep_pickup_datetime >= TIMESTAMP '{end}' THEN '{R1}'
   WHEN tpep_dropoff_datetime IS NULL OR tpep_dropoff_datetime <= tpep_pickup_datetime THEN '{R2}'
   WHEN total_amount IS NULL OR total_amount < 0 THEN '{R3}'
   WHEN passenger_count IS NULL OR passenger_count <= 0 THEN '{R4}' END AS dq_regra_violada
 FROM {source}"""


_PUBLISHED = """VendorID, passenger_count, total_amount, tpep_pickup_datetime,
   tpep_dropoff_datetime, taxi_type,
   strftime(tpep_pickup_datetime, '%Y-%m') AS pickup_year_month,
   CAST(hour(tpep_pickup_datetime) AS INTEGER) AS pickup_hour"""


def trips(query: str, *ctes: str) -> str:
    """``query`` over trips, classified, gold (clean), quarantine, metrics and further CTEs."""
    further = "".join(f",\n{cte}" for cte in ctes)
    return f"""WITH trips AS ({TRIPS.format(lineitem="lineitem")}),
classified AS ({_classified("trips", WINDOW)}),
gold AS (SELECT {_PUBLISHED} FROM classified WHERE dq_regra_violada IS NULL),
quarantine AS (SELECT {_PUBLISHED}, source_year_month, dq_regra_violada AS _reject_reason
  FROM classified WHERE dq_regra_violada IS NOT NULL),
scopes AS (SELECT DISTINCT taxi_type FROM trips UNION ALL SELECT 'total'),
scoped AS (SELECT taxi_type, dq_regra_violada FROM classified
  UNION ALL SELECT 'total', dq_regra_violada FROM classified),
metrics AS (
  SELECT 'linhas_bronze' AS metrica, taxi_type, count(*) AS valor FROM scoped GROUP BY taxi_type
  UNION ALL
  SELECT m, s.taxi_type, count(c.taxi_type) FROM scopes s
   CROSS JOIN (VALUES ('{R1}'), ('{R2}'), ('{R3}'), ('{R4}')) AS v(m)
   LEFT JOIN scoped c ON c.taxi_type = s.taxi_type AND c.dq_regra_violada = v.m
   GROUP BY m, s.taxi_type
  UNION ALL
  SELECT 'linhas_gold', taxi_type, count(*) FILTER (dq_regra_violada IS NULL) FROM scoped
   GROUP BY taxi_type){further}
{query}"""


def events(query: str) -> str:
    """``query`` over the clean event trips, as gold."""
    return f"""WITH trips AS ({EVENT_TRIPS.format(events="events")}),
classified AS ({_classified("trips", EVENT_WINDOW)}),
gold AS (SELECT {_PUBLISHED} FROM classified WHERE dq_regra_violada IS NULL)
{query}"""
