"""Exploration of all rows, before any rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake import taxi
from ledgerlake.operators import compare, explore, quality
from ledgerlake.suite import fixtures
from ledgerlake.suite.sqltext import trips as over_trips

_SUMMARISED = ("total_amount", "passenger_count", "trip_distance")
_PERCENTILES = {
    "total_amount_p1_p50_p99": ("total_amount", (0.01, 0.5, 0.99)),
    "trip_distance_p50_p99_p999": ("trip_distance", (0.5, 0.99, 0.999)),
}
_CHECKED = {
    "window": fixtures.WINDOW,
    "month": "1996-01",
    "null_passengers": 71,
    "earliest_pickup": "1994-12-31",
    "lowest_amount": -90000.0,
    "longest_distance": 100.0,
}


def volume_vs_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips against line items counted apart, with one month too many and one unknown."""
    counts = (
        fixtures.trips(spark, sf_dir)
        .groupBy(taxi.FLEET, taxi.FILE_MONTH)
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    expected = (
        fixtures.table(spark, sf_dir, "lineitem")
        .groupBy(
            F.when(F.col("l_returnflag") == "A", "green").otherwise("yellow").alias(taxi.FLEET),
            F.concat(
                F.year("l_shipdate"), F.when(F.month("l_shipdate") < 7, "-01").otherwise("-07")
            ).alias(taxi.FILE_MONTH),
        )
        .agg(F.count(F.lit(1)).alias("expected"))
        .filter(F.col(taxi.FILE_MONTH) != "1996-07")
        .withColumn(
            "expected",
            F.col("expected") + F.when(F.col(taxi.FILE_MONTH) == "1996-01", 1).otherwise(0),
        )
    )
    return compare.volume_against_expected(
        counts, expected, taxi.FLEET, taxi.FILE_MONTH, taxi.METRICS.total
    )


def volume_mixed_grain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips against expectations of single months of yellow, of green as a whole, and of all rows.

    They come from line items counted apart: a month of yellow is off by one, months of green are
    not known, one month is expected that has no trips.
    """
    counts = (
        fixtures.trips(spark, sf_dir)
        .groupBy(taxi.FLEET, taxi.FILE_MONTH)
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    items = fixtures.table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_returnflag") == "A", "green").otherwise("yellow").alias(taxi.FLEET),
        F.concat(
            F.year("l_shipdate"), F.when(F.month("l_shipdate") < 7, "-01").otherwise("-07")
        ).alias(taxi.FILE_MONTH),
    )
    level = F.grouping_id(taxi.FLEET, taxi.FILE_MONTH)
    expected = (
        items.rollup(taxi.FLEET, taxi.FILE_MONTH)
        .agg(level.alias("level"), F.count(F.lit(1)).alias("expected"))
        .filter(f"(level = 0 AND {taxi.FLEET} = 'yellow') OR (level = 1 AND {taxi.FLEET} = 'green') OR level = 3")
        .select(
            taxi.FLEET,
            taxi.FILE_MONTH,
            (F.col("expected") + F.when(F.col(taxi.FILE_MONTH) == "1996-01", 1).otherwise(0)).alias("expected"),
        )
        .unionByName(
            spark.range(1).select(
                F.lit("yellow").alias(taxi.FLEET), F.lit("1900-01").alias(taxi.FILE_MONTH), F.lit(7).cast("long").alias("expected")
            )
        )
    )
    return compare.volume_at_grains(counts, expected, taxi.FLEET, taxi.FILE_MONTH, taxi.METRICS.total)


def numeric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.numeric_summary(fixtures.trips(spark, sf_dir), _SUMMARISED)


def percentiles_by_fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The percentile arrays, one column per percentile."""
    arrays = explore.percentiles(
        fixtures.trips(spark, sf_dir),
        taxi.FLEET,
        _PERCENTILES,
        {"media_passageiros": "passenger_count"},
    )
    return arrays.select(
        taxi.FLEET,
        *(
            F.col(name)[i].alias(f"{column}_p{str(fraction)[2:]}")
            for name, (column, fractions) in _PERCENTILES.items()
            for i, fraction in enumerate(fractions)
        ),
        "media_passageiros",
    )


def null_zero_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.trips(spark, sf_dir)
    return explore.null_and_zero_counts(rows, taxi.FLEET, "passenger_count")


def hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.run_checks(fixtures.trips(spark, sf_dir), taxi.hypotheses(**_CHECKED))


def cleaning_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = quality.quality_metrics(
        fixtures.classified(spark, sf_dir),
        fixtures.DATASET.rules,
        taxi.METRICS,
        taxi.VIOLATED_RULE,
    )
    return quality.cleaning_impact(metrics, taxi.METRICS)


def code_null_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.trips(spark, sf_dir)
    return explore.code_matches_null(rows, "payment_type", 0, "passenger_count")


QUERIES = {
    "volume_vs_expected": volume_vs_expected,
    "volume_mixed_grain": volume_mixed_grain,
    "numeric_summary": numeric_summary,
    "percentiles_by_fleet": percentiles_by_fleet,
    "null_zero_counts": null_zero_counts,
    "hypotheses": hypotheses,
    "cleaning_impact": cleaning_impact,
    "code_null_match": code_null_match,
}


def _summary() -> str:
    statistics = {
        "count": "CAST(count({c}) AS DOUBLE)",
        "min": "CAST(min({c}) AS DOUBLE)",
        "25%": "CAST(quantile_disc({c}, 0.25) AS DOUBLE)",
        "50%": "CAST(quantile_disc({c}, 0.5) AS DOUBLE)",
        "75%": "CAST(quantile_disc({c}, 0.75) AS DOUBLE)",
        "max": "CAST(max({c}) AS DOUBLE)",
    }
    rows = (
        f"SELECT '{name}' AS summary, "
        + ", ".join(f"{sql.format(c=c)} AS {c}" for c in _SUMMARISED)
        + " FROM trips"
        for name, sql in statistics.items()
    )
    return over_trips("\nUNION ALL ".join(rows))


def _hypotheses() -> str:
    start, end = _CHECKED["window"]
    low, far = _CHECKED["lowest_amount"], _CHECKED["longest_distance"]
    day, nulls = _CHECKED["earliest_pickup"], _CHECKED["null_passengers"]
    return over_trips(
        f"""SELECT 'A_null_passengers' AS "check", CAST(a AS VARCHAR) AS observed,
    '= {nulls}' AS expected, a = {nulls} AS confirmed FROM seen
UNION ALL SELECT 'B_pickups_outside', CAST(b AS VARCHAR), '> 0', b > 0 FROM seen
UNION ALL SELECT 'B_earliest_pickup', CAST(b2 AS VARCHAR), 'on {day}',
    CAST(b2 AS DATE) = DATE '{day}' FROM seen
UNION ALL SELECT 'C_negative_amounts', CAST(c AS VARCHAR), '> 0', c > 0 FROM seen
UNION ALL SELECT 'C_lowest_amount', CAST(c2 AS VARCHAR), '<= {low}', c2 <= {low} FROM seen
UNION ALL SELECT 'D_payment_type_0', CAST(d AS VARCHAR), '> 0', d > 0 FROM seen
UNION ALL SELECT 'E_ratecode_99', CAST(e AS VARCHAR), '> 0', e > 0 FROM seen
UNION ALL SELECT 'F_longest_distance', CAST(f AS VARCHAR), '> {far}', f > {far} FROM seen""",
        f"""seen AS (SELECT count(*) FILTER (taxi_type = 'yellow' AND source_year_month =
      '{_CHECKED["month"]}' AND passenger_count IS NULL) AS a,
    count(*) FILTER (tpep_pickup_datetime < TIMESTAMP '{start}'
      OR tpep_pickup_datetime >= TIMESTAMP '{end}') AS b, min(tpep_pickup_datetime) AS b2,
    count(*) FILTER (total_amount < 0) AS c, min(total_amount) AS c2,
    count(*) FILTER (payment_type = 0) AS d, count(*) FILTER (RatecodeID = 99) AS e,
    max(trip_distance) AS f FROM trips)""",
    )


ORACLES = {
    "volume_vs_expected": over_trips(
        """SELECT coalesce(taxi_type, 'total') AS taxi_type,
    coalesce(source_year_month, 'total') AS source_year_month, CAST(sum(n) AS BIGINT) AS rows,
    CAST(sum(e) AS BIGINT) AS expected,
    CASE WHEN sum(n) = sum(e) THEN 'OK' ELSE 'DIVERGE' END AS status
  FROM known GROUP BY ROLLUP (taxi_type, source_year_month)""",
        """known AS (SELECT taxi_type, source_year_month, count(*) AS n,
    CASE WHEN source_year_month = '1996-07' THEN 0
         WHEN source_year_month = '1996-01' THEN count(*) + 1 ELSE count(*) END AS e
    FROM trips GROUP BY taxi_type, source_year_month)""",
    ),
    "volume_mixed_grain": over_trips(
        """SELECT taxi_type, source_year_month, CAST(rows AS BIGINT) AS rows,
    CAST(expected AS BIGINT) AS expected, CASE WHEN expected IS NULL THEN 'UNKNOWN'
      WHEN rows = expected THEN 'OK' ELSE 'DIVERGE' END AS status
  FROM (SELECT taxi_type, source_year_month, count(*) AS rows, CASE WHEN taxi_type = 'yellow'
      THEN count(*) + CASE WHEN source_year_month = '1996-01' THEN 1 ELSE 0 END END AS expected
    FROM trips GROUP BY taxi_type, source_year_month
  UNION ALL SELECT taxi_type, 'total', count(*), CASE WHEN taxi_type = 'green' THEN count(*) END
    FROM trips GROUP BY taxi_type
  UNION ALL SELECT 'total', 'total', count(*), count(*) FROM trips
  UNION ALL SELECT 'yellow', '1900-01', 0, 7)"""
    ),
    "numeric_summary": _summary(),
    "percentiles_by_fleet": over_trips(
        "SELECT taxi_type, "
        + ", ".join(
            f"quantile_disc({column}, {fraction}) AS {column}_p{str(fraction)[2:]}"
            for column, fractions in _PERCENTILES.values()
            for fraction in fractions
        )
        + ", avg(passenger_count) AS media_passageiros FROM trips GROUP BY taxi_type"
    ),
    "null_zero_counts": over_trips(
        """SELECT taxi_type, count(*) FILTER (passenger_count IS NULL) AS nulls,
    count(*) FILTER (passenger_count = 0) AS zeros FROM trips GROUP BY taxi_type"""
    ),
    "hypotheses": _hypotheses(),
    "cleaning_impact": over_trips(
        """SELECT taxi_type, i AS input, c AS clean, r AS rejected,
    round(CAST(c AS DOUBLE) / CAST(i AS DOUBLE), 4) AS aproveitamento, i = c + r AS reconciled
  FROM (SELECT taxi_type, CAST(sum(valor) FILTER (metrica = 'linhas_bronze') AS BIGINT) AS i,
    CAST(sum(valor) FILTER (metrica = 'linhas_gold') AS BIGINT) AS c,
    CAST(sum(valor) FILTER (starts_with(metrica, 'removidas_')) AS BIGINT) AS r
    FROM metrics GROUP BY taxi_type)"""
    ),
    "code_null_match": over_trips(
        """SELECT count(*) FILTER (payment_type = 0) AS with_code,
    count(*) FILTER ((payment_type = 0) IS DISTINCT FROM (passenger_count IS NULL)) AS mismatches
  FROM trips"""
    ),
}
