"""The taxi trip case as data: two fleets, one canonical table, four quality rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.functions.timeparts import hour_sql, month_sql
from ledgerlake.spec import (
    Alias,
    Check,
    Dataset,
    Layout,
    MetricSpec,
    OutputColumn,
    OutputSpec,
    Rule,
    SourceSpec,
    TableSpec,
)

# --- Fixed values -------------------------------------------------------------------------
# Names, types, bounds, counts and labels that results must carry exactly.

# Canonical data columns in order, with their types.
TRIP_COLUMNS = {
    "VendorID": "int",
    "tpep_pickup_datetime": "timestamp_ntz",
    "tpep_dropoff_datetime": "timestamp_ntz",
    "passenger_count": "int",
    "trip_distance": "double",
    "RatecodeID": "int",
    "store_and_fwd_flag": "string",
    "PULocationID": "int",
    "DOLocationID": "int",
    "payment_type": "int",
    "fare_amount": "double",
    "extra": "double",
    "mta_tax": "double",
    "tip_amount": "double",
    "tolls_amount": "double",
    "improvement_surcharge": "double",
    "total_amount": "double",
    "congestion_surcharge": "double",
    "airport_fee": "double",
    "ehail_fee": "double",
    "trip_type": "int",
}
FLEET = "taxi_type"
FILE_MONTH = "source_year_month"
LOADED_AT = "ingested_at"

FLEETS = ("yellow", "green")
MONTHS = ("2023-01", "2023-02", "2023-03", "2023-04", "2023-05")
WINDOW = ("2023-01-01 00:00:00", "2023-06-01 00:00:00")
EXPECTED_BYTES = {"yellow": 264426470, "green": 7936049}
EXPECTED_ROWS = {
    ("yellow", "2023-01"): 3066766,
    ("yellow", "2023-02"): 2913955,
    ("yellow", "2023-03"): 3403766,
    ("yellow", "2023-04"): 3288250,
    ("yellow", "2023-05"): 3513649,
}
EXPECTED_FLEET_ROWS = {"green": 339630}
BENCHMARK_MONTH_AMOUNT = {
    "2023-01": 27.44,
    "2023-02": 27.33,
    "2023-03": 28.26,
    "2023-04": 28.76,
    "2023-05": 29.46,
}
BENCHMARK_TOLERANCE = 0.5
PARITY_TOLERANCE = 0.01

VIOLATED_RULE = "dq_regra_violada"
REJECT_REASON = "_reject_reason"
RULE_NAMES = {
    "window": "removidas_r1_pickup_fora_janela",
    "order": "removidas_r2_dropoff_nao_posterior",
    "nonnegative": "removidas_r3_total_amount_negativo",
    "positive": "removidas_r4_passenger_count_invalido",
}
# What breaks each rule, as the data contract words it; {start} and {end} bound the window.
RULE_VIOLATIONS = {
    "window": (
        "tpep_pickup_datetime IS NULL"
        " OR tpep_pickup_datetime < TIMESTAMP_NTZ '{start}'"
        " OR tpep_pickup_datetime >= TIMESTAMP_NTZ '{end}'"
    ),
    "order": "tpep_dropoff_datetime IS NULL OR tpep_dropoff_datetime <= tpep_pickup_datetime",
    "nonnegative": "total_amount IS NULL OR total_amount < 0",
    "positive": "passenger_count IS NULL OR passenger_count <= 0",
}
METRICS = MetricSpec(
    input_rows="linhas_bronze",
    clean_rows="linhas_gold",
    total="total",
    rejected_prefix="removidas_",
    metric="metrica",
    scope=FLEET,
    value="valor",
    run_ts="run_ts",
)
SCOPE = "escopo"
ALL_FLEETS = "frota_completa"
MONTH_VIEW = "vw_media_total_amount_mes"
HOUR_VIEW = "vw_media_passageiros_hora_maio"
MONTH_MEAN = "media_total_amount"
HOUR_MEAN = "media_passageiros"
TRIPS = "qtd_corridas"
ABLATION = {
    "sem_filtros": "true",
    "so_total_amount>=0": "total_amount >= 0",
    "so_passenger>0": "passenger_count > 0",
    "gold(r3+r4)": "total_amount >= 0 AND passenger_count > 0",
}
# --- End of fixed values ------------------------------------------------------------------

PICKUP = "tpep_pickup_datetime"
DROPOFF = "tpep_dropoff_datetime"
PICKUP_MONTH = "pickup_year_month"
PICKUP_HOUR = "pickup_hour"

TABLE = TableSpec(TRIP_COLUMNS, scope=FLEET, month=FILE_MONTH, loaded_at=LOADED_AT)

LAYOUT = Layout(
    file="{scope}_tripdata_{month}.parquet",
    path="{root}/{scope}/{year}/{file}",
)

SCOPES = {ALL_FLEETS: None, "yellow": ("yellow",)}


def sources(capital_fee_since: str = "2023-02") -> dict[str, SourceSpec]:
    """Both fleets. The airport fee is spelled with a capital from the given month on."""
    return {
        "yellow": SourceSpec(
            "yellow",
            aliases=(Alias("Airport_fee", "airport_fee", since=capital_fee_since),),
            absent=("ehail_fee", "trip_type"),
        ),
        "green": SourceSpec(
            "green",
            aliases=(
                Alias("lpep_pickup_datetime", PICKUP),
                Alias("lpep_dropoff_datetime", DROPOFF),
            ),
            absent=("airport_fee",),
        ),
    }


def violations(window: Sequence[str] = WINDOW) -> dict[str, str]:
    """The violation texts for a pickup window [start, end)."""
    start, end = window
    return {rule: text.format(start=start, end=end) for rule, text in RULE_VIOLATIONS.items()}


def quality_rules(window: Sequence[str] = WINDOW) -> tuple[Rule, ...]:
    """The four rules in their order."""
    return tuple(Rule(RULE_NAMES[rule], text) for rule, text in violations(window).items())


CLEAN = OutputSpec(
    (
        OutputColumn("VendorID", "int"),
        OutputColumn("passenger_count", "int"),
        OutputColumn("total_amount", "double"),
        OutputColumn(PICKUP, "timestamp_ntz"),
        OutputColumn(DROPOFF, "timestamp_ntz"),
        OutputColumn(FLEET, "string"),
        OutputColumn(PICKUP_MONTH, "string", month_sql(PICKUP)),
        OutputColumn(PICKUP_HOUR, "int", hour_sql(PICKUP)),
    )
)
REJECTED = CLEAN.plus(
    OutputColumn(FILE_MONTH, "string"),
    OutputColumn(REJECT_REASON, "string", VIOLATED_RULE),
)


def dataset(
    window: Sequence[str] = WINDOW,
    layout: Layout = LAYOUT,
    capital_fee_since: str = "2023-02",
    months: Sequence[str] = MONTHS,
    expected_bytes: Mapping[str, int] = EXPECTED_BYTES,
) -> Dataset:
    """The case for a pickup window; ``expected_bytes`` are the totals over all ``months``."""
    return Dataset(
        table=TABLE,
        sources=sources(capital_fee_since),
        layout=layout,
        rules=quality_rules(window),
        violated_rule=VIOLATED_RULE,
        clean=CLEAN,
        rejected=REJECTED,
        metrics=METRICS,
        months=tuple(months),
        expected_bytes=expected_bytes,
    )


def expected_volumes(spark: SparkSession) -> DataFrame:
    """Published row counts at the grain they are known: yellow by month, green as a whole, all."""
    months = [(f, m, n) for (f, m), n in EXPECTED_ROWS.items()]
    fleets = [(f, None, n) for f, n in EXPECTED_FLEET_ROWS.items()]
    everything = (None, None, sum(EXPECTED_ROWS.values()) + sum(EXPECTED_FLEET_ROWS.values()))
    return spark.createDataFrame(
        [*months, *fleets, everything], f"{FLEET} string, {FILE_MONTH} string, expected long"
    )


def guarantees(window: Sequence[str] = WINDOW, fleets: Sequence[str] = FLEETS) -> dict[str, str]:
    """What every published clean row must satisfy, as violation texts by name."""
    broken = violations(window)
    domain = ", ".join(f"'{f}'" for f in fleets)
    never_null = {f"{c}_not_null": f"{c} IS NULL" for c in CLEAN.names}
    return {
        **never_null,
        "pickup_in_window": broken["window"],
        "dropoff_after_pickup": broken["order"],
        "amount_not_negative": broken["nonnegative"],
        "passengers_positive": broken["positive"],
        "fleet_in_domain": f"NOT coalesce({FLEET} IN ({domain}), false)",
        "hour_in_day": f"NOT coalesce({PICKUP_HOUR} BETWEEN 0 AND 23, false)",
        "month_matches_pickup": f"NOT ({PICKUP_MONTH} <=> {month_sql(PICKUP)})",
    }


def hypotheses(
    window: Sequence[str] = WINDOW,
    fleet: str = "yellow",
    month: str = "2023-01",
    null_passengers: int = 71743,
    earliest_pickup: str = "2008-12-31",
    lowest_amount: float = -751.0,
    longest_distance: float = 100000.0,
) -> list[Check]:
    """The anomaly hypotheses, all answered by one scan."""
    start, end = window
    outside = f"{PICKUP} < TIMESTAMP_NTZ '{start}' OR {PICKUP} >= TIMESTAMP_NTZ '{end}'"
    missing = f"{FLEET} = '{fleet}' AND {FILE_MONTH} = '{month}' AND passenger_count IS NULL"
    return [
        Check(
            "A_null_passengers",
            f"count_if({missing})",
            f"= {null_passengers}",
            lambda seen: seen == null_passengers,
        ),
        Check("B_pickups_outside", f"count_if({outside})", "> 0", lambda seen: seen > 0),
        Check(
            "B_earliest_pickup",
            f"min({PICKUP})",
            f"on {earliest_pickup}",
            lambda seen: seen.cast("date") == F.lit(earliest_pickup).cast("date"),
        ),
        Check("C_negative_amounts", "count_if(total_amount < 0)", "> 0", lambda seen: seen > 0),
        Check(
            "C_lowest_amount",
            "min(total_amount)",
            f"<= {lowest_amount}",
            lambda seen: seen <= lowest_amount,
        ),
        Check("D_payment_type_0", "count_if(payment_type = 0)", "> 0", lambda seen: seen > 0),
        Check("E_ratecode_99", "count_if(RatecodeID = 99)", "> 0", lambda seen: seen > 0),
        Check(
            "F_longest_distance",
            "max(trip_distance)",
            f"> {longest_distance}",
            lambda seen: seen > longest_distance,
        ),
    ]
