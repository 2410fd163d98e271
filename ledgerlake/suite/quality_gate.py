"""Rules, classification, split, metrics and every way of proving the counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlake import taxi
from ledgerlake.operators import quality
from ledgerlake.plans import views
from ledgerlake.spec import OutputColumn
from ledgerlake.suite import fixtures
from ledgerlake.suite.sqltext import R1, R2, R3, R4
from ledgerlake.suite.sqltext import trips as over_trips

_NAMES = taxi.METRICS
_RULES = {key: rule for key, rule in zip(taxi.RULE_NAMES, fixtures.DATASET.rules, strict=True)}
_AUDITED = [
    "VendorID",
    taxi.PICKUP,
    taxi.DROPOFF,
    "passenger_count",
    "total_amount",
    taxi.FLEET,
    taxi.FILE_MONTH,
]


def _rule(key: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = fixtures.trips(spark, sf_dir)
        return quality.broken_by_rule(rows, _RULES[key], [taxi.FLEET, taxi.FILE_MONTH])

    return query


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    classified = fixtures.classified(spark, sf_dir)
    return quality.quality_metrics(classified, fixtures.DATASET.rules, _NAMES, taxi.VIOLATED_RULE)


def _reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = quality.scope_counts(fixtures.trips(spark, sf_dir), taxi.FLEET, _NAMES.total)
    return quality.reconcile(_metrics(spark, sf_dir), counted, _NAMES)


def _stored(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.table(fixtures.stored(spark, sf_dir).name(name))


def dq_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.classified(spark, sf_dir).select(*_AUDITED, taxi.VIOLATED_RULE)


def dq_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = quality.metric_values(_metrics(spark, sf_dir), _NAMES)
    return values.orderBy(_NAMES.scope, _NAMES.metric)


def dq_metrics_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = quality.metrics_of(_metrics(spark, sf_dir), _NAMES, _NAMES.total)
    return total.orderBy(_NAMES.metric)


def dq_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.clean_yield(_reconciled(spark, sf_dir), taxi.FLEET)


def dq_partition_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = (views.CONFORMED, views.TRIPS, views.REJECTED_TRIPS)
    counts = (
        quality.scope_counts(_stored(spark, sf_dir, t), taxi.FLEET, _NAMES.total) for t in tables
    )
    return quality.partition_check(*counts, taxi.FLEET)


def dq_partition_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.partition_check_rollup(
        _stored(spark, sf_dir, views.METRICS),
        _stored(spark, sf_dir, views.TRIPS),
        _stored(spark, sf_dir, views.REJECTED_TRIPS),
        _NAMES,
    ).orderBy(taxi.FLEET)


def dq_reason_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejected = _stored(spark, sf_dir, views.REJECTED_TRIPS)
    return quality.reason_check(rejected, _metrics(spark, sf_dir), _NAMES, taxi.REJECT_REASON)


def dq_reconcile_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.reconcile_metrics(_metrics(spark, sf_dir), _NAMES)


def dq_reason_by_fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejected = fixtures.rejected(spark, sf_dir)
    counts = quality.reasons_by_scope(rejected, taxi.REJECT_REASON, taxi.FLEET, taxi.FLEETS)
    return counts.orderBy(taxi.REJECT_REASON)


def dq_worst_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejected = fixtures.rejected(spark, sf_dir)
    return quality.worst_rows(rejected, taxi.REJECT_REASON, R3, "total_amount", _AUDITED)


def dq_reason_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejected = fixtures.rejected(spark, sf_dir)
    counts = quality.reason_by_source(rejected, taxi.REJECT_REASON, R1, taxi.FILE_MONTH)
    return counts.orderBy(taxi.FILE_MONTH)


def dq_quarantine_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.row_count(fixtures.rejected(spark, sf_dir), "quarentena")


def contract_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The guarantees on all published rows, clean and rejected apart."""
    rows = quality.project(
        fixtures.classified(spark, sf_dir), fixtures.DATASET.rejected
    ).selectExpr("*", f"{taxi.REJECT_REASON} IS NULL AS is_clean")
    return quality.contract_check(rows, taxi.guarantees(fixtures.WINDOW), ["is_clean"])


def contract_witnesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items whose trips break a guarantee of clean rows, some by name."""
    items = fixtures.table(spark, sf_dir, "lineitem").selectExpr(
        "*", "concat_ws('-', l_orderkey, l_linenumber) AS item"
    )
    rows = spark.sql(fixtures.TRIPS.replace("SELECT ", "SELECT item, ", 1), lineitem=items)
    marked = quality.classify(rows, fixtures.DATASET.rules, fixtures.DATASET.violated_rule)
    output = fixtures.DATASET.clean.plus(OutputColumn("item", "string"))
    published = quality.project(marked, output)
    return quality.contract_witnesses(published, taxi.guarantees(fixtures.WINDOW), "item")


QUERIES = {
    "rule_window": _rule("window"),
    "rule_order": _rule("order"),
    "rule_nonnegative": _rule("nonnegative"),
    "rule_positive": _rule("positive"),
    "dq_classify": dq_classify,
    "dq_clean": fixtures.clean,
    "dq_quarantine": fixtures.rejected,
    "dq_metrics": dq_metrics,
    "dq_metrics_total": dq_metrics_total,
    "dq_reconcile": _reconciled,
    "dq_yield": dq_yield,
    "dq_partition_check": dq_partition_check,
    "dq_partition_rollup": dq_partition_rollup,
    "dq_reason_check": dq_reason_check,
    "dq_reconcile_pivot": dq_reconcile_pivot,
    "dq_reason_by_fleet": dq_reason_by_fleet,
    "dq_worst_rows": dq_worst_rows,
    "dq_reason_by_source": dq_reason_by_source,
    "dq_quarantine_count": dq_quarantine_count,
    "contract_check": contract_check,
    "contract_witnesses": contract_witnesses,
}


def _broken(condition: str) -> str:
    return over_trips(
        f"""SELECT taxi_type, source_year_month, count(*) AS rows,
    count(*) FILTER ({condition}) AS broken FROM trips GROUP BY taxi_type, source_year_month"""
    )


_START, _END = fixtures.WINDOW
_OUTSIDE = (
    f"tpep_pickup_datetime IS NULL OR tpep_pickup_datetime < TIMESTAMP '{_START}' "
    f"OR tpep_pickup_datetime >= TIMESTAMP '{_END}'"
)
_SUMS = """sum(valor) FILTER (metrica = 'linhas_bronze') AS i,
    sum(valor) FILTER (metrica = 'linhas_gold') AS c,
    sum(valor) FILTER (starts_with(metrica, 'removidas_')) AS r"""
_CHECKED = """SELECT taxi_type, CAST(i AS BIGINT) AS input, CAST(c AS BIGINT) AS clean,
    CAST(r AS BIGINT) AS rejected, CAST(i - c - r AS BIGINT) AS diff"""
_SIDES = f"""{_CHECKED} FROM
    (SELECT coalesce(taxi_type, 'total') AS taxi_type, count(*) AS i FROM trips
      GROUP BY ROLLUP (taxi_type))
    JOIN (SELECT coalesce(taxi_type, 'total') AS taxi_type, count(*) AS c FROM gold
      GROUP BY ROLLUP (taxi_type)) USING (taxi_type)
    JOIN (SELECT coalesce(taxi_type, 'total') AS taxi_type, count(*) AS r FROM quarantine
      GROUP BY ROLLUP (taxi_type)) USING (taxi_type)"""
_CONTRACT = {
    **{
        f"{c}_not_null": f"{c} IS NULL"
        for c in (
            "VendorID",
            "passenger_count",
            "total_amount",
            "tpep_pickup_datetime",
            "tpep_dropoff_datetime",
            "taxi_type",
            "pickup_year_month",
            "pickup_hour",
        )
    },
    "pickup_in_window": _OUTSIDE,
    "dropoff_after_pickup": (
        "tpep_dropoff_datetime IS NULL OR tpep_dropoff_datetime <= tpep_pickup_datetime"
    ),
    "amount_not_negative": "total_amount IS NULL OR total_amount < 0",
    "passengers_positive": "passenger_count IS NULL OR passenger_count <= 0",
    "fleet_in_domain": "taxi_type IS NULL OR taxi_type NOT IN ('yellow', 'green')",
    "hour_in_day": "pickup_hour IS NULL OR pickup_hour NOT BETWEEN 0 AND 23",
    "month_matches_pickup": (
        "pickup_year_month IS DISTINCT FROM strftime(tpep_pickup_datetime, '%Y-%m')"
    ),
}
_CONTRACT_COUNTS = ", ".join(
    f"count(*) FILTER ({condition}) AS {name}" for name, condition in _CONTRACT.items()
)

_ITEM_TRIPS = fixtures.TRIPS.replace(
    "SELECT ", "SELECT l_orderkey || '-' || l_linenumber AS item, ", 1
).format(lineitem="lineitem")
_WITNESSES = f"""WITH published AS (SELECT item, VendorID, passenger_count, total_amount,
    tpep_pickup_datetime, tpep_dropoff_datetime, taxi_type,
    strftime(tpep_pickup_datetime, '%Y-%m') AS pickup_year_month,
    CAST(hour(tpep_pickup_datetime) AS INTEGER) AS pickup_hour FROM ({_ITEM_TRIPS})),
  found AS ({" UNION ALL ".join(
    f"SELECT '{name}' AS guarantee, count(*) FILTER ({condition}) AS broken, "
    + ", ".join(f"arg_min(item, md5(item || '#{k}')) FILTER ({condition}) AS w{k}" for k in (1, 2, 3))
    + " FROM published"
    for name, condition in _CONTRACT.items()
  )})
  SELECT guarantee, broken, CASE WHEN broken > 0 THEN place END AS place,
    CASE place WHEN 1 THEN w1 WHEN 2 THEN w2 ELSE w3 END AS witness
  FROM found CROSS JOIN (VALUES (1), (2), (3)) AS p(place) WHERE broken > 0 OR place = 1"""

ORACLES = {
    "contract_witnesses": _WITNESSES,
    "rule_window": _broken(_OUTSIDE),
    "rule_order": _broken(
        "tpep_dropoff_datetime IS NULL OR tpep_dropoff_datetime <= tpep_pickup_datetime"
    ),
    "rule_nonnegative": _broken("total_amount IS NULL OR total_amount < 0"),
    "rule_positive": _broken("passenger_count IS NULL OR passenger_count <= 0"),
    "dq_classify": over_trips(f"SELECT {', '.join(_AUDITED)}, dq_regra_violada FROM classified"),
    "dq_clean": over_trips("SELECT * FROM gold"),
    "dq_quarantine": over_trips("SELECT * FROM quarantine"),
    "dq_metrics": over_trips(
        "SELECT metrica, taxi_type, valor FROM metrics ORDER BY taxi_type, metrica"
    ),
    "dq_metrics_total": over_trips(
        "SELECT metrica, valor FROM metrics WHERE taxi_type = 'total' ORDER BY metrica"
    ),
    "dq_reconcile": over_trips(
        f"{_CHECKED} FROM (SELECT taxi_type, {_SUMS} FROM metrics GROUP BY taxi_type)"
    ),
    "dq_yield": over_trips(
        f"""SELECT taxi_type, CAST(i AS BIGINT) AS input, CAST(c AS BIGINT) AS clean,
    round(CAST(c AS DOUBLE) / CAST(i AS DOUBLE), 4) AS aproveitamento
  FROM (SELECT taxi_type, {_SUMS} FROM metrics GROUP BY taxi_type)"""
    ),
    "dq_partition_check": over_trips(_SIDES),
    "dq_partition_rollup": over_trips(_SIDES),
    "dq_reason_check": over_trips(
        f"""SELECT reason AS _reject_reason, count(_reject_reason) AS quarantine,
    count(_reject_reason) AS metric, CAST(0 AS BIGINT) AS diff
  FROM (VALUES ('{R1}'), ('{R2}'), ('{R3}'), ('{R4}')) AS v(reason)
  LEFT JOIN quarantine ON _reject_reason = reason GROUP BY reason"""
    ),
    "dq_reconcile_pivot": over_trips(
        """SELECT taxi_type, CAST(max(CASE WHEN metrica = 'linhas_bronze' THEN valor END)
    - max(CASE WHEN metrica = 'linhas_gold' THEN valor END)
    - sum(CASE WHEN starts_with(metrica, 'removidas_') THEN valor ELSE 0 END) AS BIGINT)
    AS diferenca FROM metrics GROUP BY taxi_type"""
    ),
    "dq_reason_by_fleet": over_trips(
        """SELECT _reject_reason, count(*) AS total, count(*) FILTER (taxi_type = 'yellow')
    AS yellow, count(*) FILTER (taxi_type = 'green') AS green
  FROM quarantine GROUP BY _reject_reason ORDER BY _reject_reason"""
    ),
    "dq_worst_rows": over_trips(
        f"""SELECT {', '.join(_AUDITED)} FROM quarantine WHERE _reject_reason = '{R3}'
  ORDER BY total_amount, {', '.join(f'{c} NULLS FIRST' for c in _AUDITED)} LIMIT 5"""
    ),
    "dq_reason_by_source": over_trips(
        f"""SELECT source_year_month, count(*) AS corridas FROM quarantine
  WHERE _reject_reason = '{R1}' GROUP BY source_year_month ORDER BY source_year_month"""
    ),
    "dq_quarantine_count": over_trips("SELECT count(*) AS quarentena FROM quarantine"),
    "contract_check": over_trips(
        f"""SELECT is_clean, guarantee, broken FROM counted
  UNPIVOT (broken FOR guarantee IN ({', '.join(_CONTRACT)}))""",
        f"""published AS (SELECT *, true AS is_clean FROM gold
    UNION ALL SELECT * EXCLUDE (source_year_month, _reject_reason), false FROM quarantine),
  counted AS (SELECT is_clean, {_CONTRACT_COUNTS} FROM published GROUP BY is_clean)""",
    ),
}
