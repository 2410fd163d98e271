"""Business questions: by month on trips, by hour on event trips."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake import taxi
from ledgerlake.functions.timeparts import month_sql
from ledgerlake.operators import answers, compare
from ledgerlake.plans import batch, sinks, views
from ledgerlake.session import fresh_dir
from ledgerlake.suite import fixtures
from ledgerlake.suite.sqltext import events as over_events
from ledgerlake.suite.sqltext import trips as over_trips

_SHORT_SCOPES = {"frota": None, "yellow": ("yellow",)}
_MEASURES = ["ocupacao_frota", "demanda_frota", "ocupacao_yellow", "demanda_yellow"]
_TOLERANCE = 2000.0


def _through_view(spark: SparkSession, view: str, rows: DataFrame, sql) -> DataFrame:
    """Read an answer through a (temporary) view on a (temporary) clean table."""
    trips = f"{view}_trips"
    rows.createOrReplaceTempView(trips)
    spark.sql(f"CREATE OR REPLACE TEMP VIEW {view} AS {sql(trips)}")
    return spark.table(view)


def _month_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.clean(spark, sf_dir)
    return _through_view(spark, taxi.MONTH_VIEW, rows, views.month_view_sql)


def _hour_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through_view(
        spark,
        taxi.HOUR_VIEW,
        fixtures.event_clean(spark, sf_dir),
        lambda trips: views.hour_view_sql(trips, fixtures.EVENT_MONTH),
    )


def month_avg_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _month_view(spark, sf_dir).orderBy(taxi.PICKUP_MONTH)


def hour_avg_passengers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hour_view(spark, sf_dir).orderBy(taxi.SCOPE, taxi.PICKUP_HOUR)


def hour_avg_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hour_view(spark, sf_dir).agg(F.count(F.lit(1)).alias("linhas"))


def _event_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.event_clean(spark, sf_dir)
    return rows.filter(F.col(taxi.PICKUP_MONTH) == fixtures.EVENT_MONTH)


def hour_scopes_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.scopes_side_by_side(
        _event_month(spark, sf_dir),
        taxi.PICKUP_HOUR,
        taxi.FLEET,
        "passenger_count",
        taxi.SCOPES,
        3,
        "media_",
    )


def hour_scopes_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.pivot_scopes(
        _hour_view(spark, sf_dir),
        taxi.PICKUP_HOUR,
        taxi.SCOPE,
        taxi.HOUR_MEAN,
        list(taxi.SCOPES),
        "media_",
    )


def hour_occupancy_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.occupancy_and_demand(
        _event_month(spark, sf_dir),
        taxi.PICKUP_HOUR,
        taxi.FLEET,
        "passenger_count",
        _SHORT_SCOPES,
        fixtures.EVENT_MONTH,
    )


def peak_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.peaks(hour_occupancy_demand(spark, sf_dir), taxi.PICKUP_HOUR, _MEASURES)


def trough_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.troughs(hour_occupancy_demand(spark, sf_dir), taxi.PICKUP_HOUR, _MEASURES)


def _sorted(query, *keys: str):
    return lambda spark, sf_dir: query(spark, sf_dir).orderBy(*keys)


def scope_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (f"media_{s}" for s in taxi.SCOPES)
    return answers.widest_gap(hour_scopes_pivot(spark, sf_dir), taxi.PICKUP_HOUR, a, b)


def parity_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.compare(
        _month_view(spark, sf_dir),
        views.month_average(fixtures.clean(spark, sf_dir)),
        [taxi.PICKUP_MONTH],
        {"media": (taxi.MONTH_MEAN, taxi.MONTH_MEAN), "qtd": (taxi.TRIPS, taxi.TRIPS)},
        taxi.PARITY_TOLERANCE,
    )


def parity_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.compare(
        hour_scopes_pivot(spark, sf_dir),
        hour_scopes_joined(spark, sf_dir),
        [taxi.PICKUP_HOUR],
        {s: (f"media_{s}", f"media_{s}") for s in taxi.SCOPES},
        taxi.PARITY_TOLERANCE,
    )


def benchmark_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly means against those of all yellow rows with a pickup, whatever the rules say."""
    known = (F.col(taxi.FLEET) == "yellow") & F.col(taxi.PICKUP).isNotNull()
    rows = fixtures.trips(spark, sf_dir).filter(known)
    unfiltered = answers.group_average(
        rows.withColumn(taxi.PICKUP_MONTH, F.expr(month_sql(taxi.PICKUP))),
        taxi.PICKUP_MONTH,
        "total_amount",
        2,
        "benchmark",
        taxi.TRIPS,
    )
    return compare.deviation(
        _month_view(spark, sf_dir),
        unfiltered,
        taxi.PICKUP_MONTH,
        taxi.MONTH_MEAN,
        "benchmark",
        _TOLERANCE,
    )


def idempotence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all stored tables before and after loading every source once more."""
    root = fresh_dir(spark, "repeated")
    warehouse = batch.Warehouse(root, f"again_{root[-12:]}")
    dataset = fixtures.DATASET
    stored = {
        "conformed": (warehouse.conformed(dataset), [taxi.LOADED_AT]),
        "checked": (warehouse.checked(dataset), []),
        "counts": (warehouse.counts(dataset), []),
        "metrics": (warehouse.metrics(dataset), [taxi.METRICS.run_ts]),
    }

    def load() -> DataFrame:
        sources = fixtures.landed_partitions(spark, sf_dir)
        batch.load(spark, dataset, fixtures.landing_root(spark, sf_dir), warehouse, sources)
        found = [
            compare.fingerprint(store.read(spark), without).select(F.lit(name).alias("stored"), "*")
            for name, (store, without) in stored.items()
        ]
        # a few rows, taken before the next load replaces what they tell of
        told = reduce(DataFrame.unionByName, found)
        return spark.createDataFrame(told.collect(), told.schema)

    sinks.create_schema(spark, warehouse.schema)
    first, second = load(), load()
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("rows", "added", "mixed")]
    return first.alias("a").join(second.alias("b"), "stored", "full").select(
        "stored", "a.rows", reduce(lambda x, y: x & y, same).alias("same")
    )


def ablation_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, end = fixtures.WINDOW
    in_window = (
        f"{taxi.PICKUP} >= TIMESTAMP_NTZ '{start}' AND {taxi.PICKUP} < TIMESTAMP_NTZ '{end}'"
    )
    rows = fixtures.trips(spark, sf_dir).filter(F.col(taxi.FLEET) == "yellow").filter(in_window)
    month = F.expr(month_sql(taxi.PICKUP)).alias("mes")
    return answers.ablation(rows, month, "total_amount", taxi.ABLATION).orderBy("mes")


def month_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.growth(_month_view(spark, sf_dir), taxi.PICKUP_MONTH, taxi.MONTH_MEAN)


def full_run_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The month answer from the published view after a full run over landed files."""
    return spark.table(fixtures.stored(spark, sf_dir).name(taxi.MONTH_VIEW))


def full_run_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.table(fixtures.stored(spark, sf_dir).name(taxi.HOUR_VIEW))


QUERIES = {
    "month_avg_amount": month_avg_amount,
    "hour_avg_passengers": hour_avg_passengers,
    "hour_avg_rows": hour_avg_rows,
    "hour_scopes_joined": _sorted(hour_scopes_joined, taxi.PICKUP_HOUR),
    "hour_scopes_pivot": _sorted(hour_scopes_pivot, taxi.PICKUP_HOUR),
    "hour_occupancy_demand": _sorted(hour_occupancy_demand, taxi.PICKUP_HOUR),
    "peak_hours": peak_hours,
    "trough_hours": trough_hours,
    "scope_gap": scope_gap,
    "parity_month": _sorted(parity_month, taxi.PICKUP_MONTH),
    "parity_hour": _sorted(parity_hour, taxi.PICKUP_HOUR),
    "benchmark_deviation": _sorted(benchmark_deviation, taxi.PICKUP_MONTH),
    "ablation_month": ablation_month,
    "month_growth": month_growth,
    "idempotence": idempotence,
    "full_run_month": _sorted(full_run_month, taxi.PICKUP_MONTH),
    "full_run_hour": _sorted(full_run_hour, taxi.SCOPE, taxi.PICKUP_HOUR),
}

_BY_MONTH = """SELECT pickup_year_month, round(avg(total_amount), 2) AS media_total_amount,
    count(*) AS qtd_corridas FROM gold WHERE taxi_type = 'yellow' GROUP BY pickup_year_month"""


def _by_hour(month: str) -> str:
    return f"""SELECT 'frota_completa' AS escopo, pickup_hour,
    round(avg(passenger_count), 3) AS media_passageiros, count(*) AS qtd_corridas
  FROM gold WHERE pickup_year_month = '{month}' GROUP BY pickup_hour
  UNION ALL SELECT 'yellow', pickup_hour, round(avg(passenger_count), 3), count(*)
  FROM gold WHERE pickup_year_month = '{month}' AND taxi_type = 'yellow' GROUP BY pickup_hour"""


_SIDE_BY_SIDE = f"""SELECT pickup_hour,
    max(media_passageiros) FILTER (escopo = 'frota_completa') AS media_frota_completa,
    max(media_passageiros) FILTER (escopo = 'yellow') AS media_yellow
  FROM ({_by_hour(fixtures.EVENT_MONTH)}) GROUP BY pickup_hour"""
_DEMAND = f"""SELECT pickup_hour, round(avg(passenger_count), 3) AS ocupacao_frota,
    round(sum(passenger_count) / 31, 1) AS demanda_frota,
    round(avg(passenger_count) FILTER (taxi_type = 'yellow'), 3) AS ocupacao_yellow,
    round(sum(passenger_count) FILTER (taxi_type = 'yellow') / 31, 1) AS demanda_yellow
  FROM gold WHERE pickup_year_month = '{fixtures.EVENT_MONTH}' GROUP BY pickup_hour"""


def _extreme(direction: str) -> str:
    measures = ", ".join(_MEASURES)
    return over_events(
        f"""SELECT measure, pickup_hour, value FROM (SELECT *, row_number() OVER (
    PARTITION BY measure ORDER BY value {direction}, pickup_hour) AS place
  FROM ({_DEMAND}) UNPIVOT (value FOR measure IN ({measures}))) WHERE place = 1"""
    )


def _ablated() -> str:
    columns = ", ".join(
        f'round(avg(total_amount) FILTER ({condition}), 2) AS "{name}"'
        for name, condition in taxi.ABLATION.items()
    )
    start, end = fixtures.WINDOW
    return over_trips(
        f"""SELECT strftime(tpep_pickup_datetime, '%Y-%m') AS mes, {columns} FROM trips
  WHERE taxi_type = 'yellow' AND tpep_pickup_datetime >= TIMESTAMP '{start}'
    AND tpep_pickup_datetime < TIMESTAMP '{end}' GROUP BY mes"""
    )


ORACLES = {
    "month_avg_amount": over_trips(f"{_BY_MONTH} ORDER BY pickup_year_month"),
    "hour_avg_passengers": over_events(_by_hour(fixtures.EVENT_MONTH)),
    "hour_avg_rows": over_events(
        f"SELECT count(*) AS linhas FROM ({_by_hour(fixtures.EVENT_MONTH)})"
    ),
    "hour_scopes_joined": over_events(_SIDE_BY_SIDE),
    "hour_scopes_pivot": over_events(_SIDE_BY_SIDE),
    "hour_occupancy_demand": over_events(_DEMAND),
    "peak_hours": _extreme("DESC"),
    "trough_hours": _extreme("ASC"),
    "scope_gap": over_events(
        f"""SELECT round(abs(media_frota_completa - media_yellow), 3) AS gap, pickup_hour
  FROM ({_SIDE_BY_SIDE}) WHERE media_yellow IS NOT NULL ORDER BY gap DESC, pickup_hour LIMIT 1"""
    ),
    "parity_month": over_trips(
        f"""SELECT pickup_year_month, media_total_amount AS media_left,
    media_total_amount AS media_right, CAST(0 AS DOUBLE) AS media_diff,
    qtd_corridas AS qtd_left, qtd_corridas AS qtd_right, CAST(0 AS BIGINT) AS qtd_diff,
    true AS ok FROM ({_BY_MONTH})"""
    ),
    "parity_hour": over_events(
        f"""SELECT pickup_hour, media_frota_completa AS frota_completa_left,
    media_frota_completa AS frota_completa_right, CAST(0 AS DOUBLE) AS frota_completa_diff,
    media_yellow AS yellow_left, media_yellow AS yellow_right,
    media_yellow - media_yellow AS yellow_diff, media_yellow IS NOT NULL AS ok
  FROM ({_SIDE_BY_SIDE})"""
    ),
    "benchmark_deviation": over_trips(
        f"""SELECT pickup_year_month, media_total_amount, benchmark,
    round(media_total_amount - benchmark, 2) AS desvio,
    coalesce(abs(round(media_total_amount - benchmark, 2)) <= {_TOLERANCE}, false) AS ok
  FROM ({_BY_MONTH}) FULL JOIN benchmark USING (pickup_year_month)""",
        f"""benchmark AS (SELECT strftime(tpep_pickup_datetime, '%Y-%m') AS pickup_year_month,
    round(avg(total_amount), 2) AS benchmark FROM trips
    WHERE taxi_type = 'yellow' AND tpep_pickup_datetime IS NOT NULL GROUP BY ALL)""",
    ),
    "ablation_month": _ablated(),
    "month_growth": over_trips(
        f"""SELECT min(pickup_year_month) AS first_period, max(pickup_year_month) AS last_period,
    min_by(media_total_amount, pickup_year_month) AS first_value,
    max_by(media_total_amount, pickup_year_month) AS last_value,
    round((max_by(media_total_amount, pickup_year_month)
      / min_by(media_total_amount, pickup_year_month) - 1) * 100, 2) AS growth_pct FROM answer""",
        f"""answer AS ({_BY_MONTH})""",
    ),
    "idempotence": over_trips(
        """SELECT 'conformed' AS stored, count(*) AS rows, true AS same FROM trips
  UNION ALL SELECT 'checked', count(*), true FROM trips
  UNION ALL SELECT 'counts', count(*), true FROM (
    SELECT DISTINCT taxi_type, source_year_month, 'input' AS kind, NULL AS reason FROM trips
    UNION ALL SELECT DISTINCT taxi_type, source_year_month, 'split', dq_regra_violada FROM classified)
  UNION ALL SELECT 'metrics', count(*), true FROM metrics"""
    ),
    "full_run_month": over_trips(_BY_MONTH),
    "full_run_hour": over_trips(_by_hour(fixtures.HOUR_MONTH)),
}
