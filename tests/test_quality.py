"""Rules, split, metrics and reconciliation on hand-made rows."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerlake import taxi
from ledgerlake.operators import quality
from tests.frames import R1, R2, R3, R4, SEVEN, SEVEN_REASONS, rows, trips

RULES = taxi.quality_rules()
REASON = taxi.VIOLATED_RULE
NAMES = taxi.METRICS


def classified(spark, data):
    return quality.classify(trips(spark, data), RULES, REASON)


def metrics(df):
    found = quality.quality_metrics(df, RULES, NAMES, REASON, datetime(2023, 6, 1))
    return {(r.taxi_type, r.metrica): r.valor for r in found.collect()}


def one(pickup="2023-03-10 08:00", dropoff="2023-03-10 08:20", n=1, amount=20.0, fleet="yellow"):
    return (1, pickup, dropoff, n, amount, fleet, "2023-03")


def test_first_broken_rule_wins(spark):
    reasons = [r[0] for r in classified(spark, SEVEN).select(REASON).collect()]
    assert reasons == SEVEN_REASONS


@pytest.mark.parametrize(
    ("row", "reason"),
    [
        (one("2023-01-01 00:00", "2023-01-01 00:01"), None),
        (one("2022-12-31 23:59:59", "2023-01-01 00:01"), R1),
        (one("2023-05-31 23:59:59", "2023-06-01 00:10"), None),
        (one("2023-06-01 00:00", "2023-06-01 00:10"), R1),
        (one(pickup=None), R1),
        (one(pickup=None, dropoff=None, n=None, amount=None), R1),
        (one(dropoff=None), R2),
        (one(amount=None), R3),
        (one(amount=0.0), None),
        (one(amount=-0.01), R3),
        (one(amount=float("nan")), None),
        (one(amount=float("inf")), None),
        (one(amount=float("-inf")), R3),
        (one(n=None), R4),
        (one(n=0), R4),
        (one(n=-1), R4),
    ],
)
def test_edges_of_the_rules(spark, row, reason):
    assert classified(spark, [row]).first()[REASON] == reason


def test_order_rule_alone_does_not_decide_on_a_missing_pickup(spark):
    broken = quality.broken_by_rule(trips(spark, [one(pickup=None)]), RULES[1], ["taxi_type"])
    assert rows(broken) == [("yellow", 1, 0)]


def test_metrics_of_the_seven_rows(spark):
    found = metrics(classified(spark, SEVEN))
    assert len(found) == 18
    expected = {
        "yellow": {"linhas_bronze": 6, R1: 2, R2: 1, R3: 1, R4: 1, "linhas_gold": 1},
        "green": {"linhas_bronze": 1, R1: 0, R2: 0, R3: 0, R4: 0, "linhas_gold": 1},
        "total": {"linhas_bronze": 7, R1: 2, R2: 1, R3: 1, R4: 1, "linhas_gold": 2},
    }
    assert found == {(s, m): v for s, values in expected.items() for m, v in values.items()}


def test_metrics_schema_and_time(spark):
    stamp = datetime(2023, 6, 1, 12)
    found = quality.quality_metrics(classified(spark, SEVEN), RULES, NAMES, REASON, stamp)
    assert [(f.name, f.dataType.simpleString()) for f in found.schema] == [
        ("run_ts", "timestamp"),
        ("metrica", "string"),
        ("taxi_type", "string"),
        ("valor", "bigint"),
    ]
    assert {r.run_ts for r in found.collect()} == {stamp}


def test_empty_input_still_has_a_total(spark):
    found = metrics(classified(spark, []))
    assert found == {("total", m): 0 for m in quality.metric_names(RULES, NAMES)}
    reconciled = quality.reconcile(
        quality.quality_metrics(classified(spark, []), RULES, NAMES, REASON),
        quality.scope_counts(trips(spark, []), "taxi_type", "total"),
        NAMES,
    )
    assert rows(reconciled) == [("total", 0, 0, 0, 0)]
    assert quality.clean_yield(reconciled, "taxi_type").first()["aproveitamento"] is None


def test_null_fleet_is_a_scope_of_its_own(spark):
    found = metrics(classified(spark, [one(), one(fleet=None), one(fleet=None, n=0)]))
    assert found[(None, "linhas_bronze")] == 2
    assert found[(None, R4)] == 1
    assert found[("total", "linhas_bronze")] == 3
    assert found[("total", "linhas_gold")] == 2


def test_fleet_named_like_the_total_raises(spark):
    with pytest.raises(Exception, match="a scope is named like the total"):
        metrics(classified(spark, [one(fleet="total")]))


def test_clean_and_quarantine_are_the_input(spark):
    df = classified(spark, SEVEN)
    clean = quality.project(quality.clean_rows(df, REASON), taxi.CLEAN)
    rejected = quality.project(quality.rejected_rows(df, REASON), taxi.REJECTED)
    whole = quality.project(df, taxi.CLEAN)
    both = clean.unionByName(rejected.select(*clean.columns))
    assert both.exceptAll(whole).count() == 0
    assert whole.exceptAll(both).count() == 0
    assert (clean.count(), rejected.count()) == (2, 5)


def test_published_schemas(spark):
    df = classified(spark, SEVEN)
    for output in (taxi.CLEAN, taxi.REJECTED):
        found = [(f.name, f.dataType.simpleString()) for f in quality.project(df, output).schema]
        assert found == [(c.name, c.type) for c in output.columns]


def test_quarantine_keeps_file_month_and_derives_from_bad_pickups(spark):
    df = classified(spark, [*SEVEN, one(pickup=None)])
    rejected = quality.project(quality.rejected_rows(df, REASON), taxi.REJECTED)
    found = {
        (r.source_year_month, r.pickup_year_month, r.pickup_hour)
        for r in rejected.filter(F.col("_reject_reason") == R1).collect()
    }
    assert found == {("2023-02", "2001-06", 5), ("2023-05", "2041-07", 0), ("2023-03", None, None)}


def test_month_and_hour_do_not_depend_on_the_session_zone(spark):
    skipped_hour = one("2023-03-12 02:30", "2023-03-12 03:30")
    data = [skipped_hour, one("2023-03-01 00:30", "2023-03-01 01:00")]
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        found = quality.project(classified(spark, data), taxi.CLEAN)
        assert [(r.pickup_year_month, r.pickup_hour) for r in found.collect()] == [
            ("2023-03", 2),
            ("2023-03", 0),
        ]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_reconciliation_counts_the_input_on_its_own(spark):
    df = classified(spark, SEVEN)
    stored = quality.quality_metrics(df, RULES, NAMES, REASON)
    good = quality.scope_counts(trips(spark, SEVEN), "taxi_type", "total")
    quality.require_zero_difference(quality.reconcile(stored, good, NAMES), "counts")
    lost = quality.scope_counts(trips(spark, [*SEVEN, SEVEN[0]]), "taxi_type", "total")
    with pytest.raises(quality.ReconciliationError, match="counts: .*'diff': 1"):
        quality.require_zero_difference(quality.reconcile(stored, lost, NAMES), "counts")


def test_partition_check_sees_a_fleet_missing_on_one_side(spark):
    everything = trips(spark, SEVEN)
    clean = everything.filter("taxi_type = 'yellow'")
    none = everything.limit(0)
    sides = [quality.scope_counts(d, "taxi_type", "total") for d in (everything, clean, none)]
    found = {r[0]: tuple(r)[1:] for r in quality.partition_check(*sides, "taxi_type").collect()}
    assert found == {"yellow": (6, 6, 0, 0), "green": (1, 0, 0, 1), "total": (7, 6, 0, 1)}


def test_reason_check_finds_differences_both_ways(spark):
    df = classified(spark, SEVEN)
    stored = quality.quality_metrics(df, RULES, NAMES, REASON)
    rejected = quality.project(quality.rejected_rows(df, REASON), taxi.REJECTED)
    same = quality.reason_check(rejected, stored, NAMES, taxi.REJECT_REASON)
    assert rows(same) == sorted([(R1, 2, 2, 0), (R2, 1, 1, 0), (R3, 1, 1, 0), (R4, 1, 1, 0)])
    fewer = rejected.filter(F.col("_reject_reason") != R4).withColumn(
        "_reject_reason",
        F.when(F.col("_reject_reason") == R3, "unknown").otherwise(F.col("_reject_reason")),
    )
    found = {
        r[0]: r["diff"]
        for r in quality.reason_check(fewer, stored, NAMES, taxi.REJECT_REASON).collect()
    }
    assert found == {R1: 0, R2: 0, R3: 1, R4: 1, "unknown": -1}


def test_reconcile_from_metrics_and_impact(spark):
    stored = quality.quality_metrics(classified(spark, SEVEN), RULES, NAMES, REASON)
    assert {tuple(r) for r in quality.reconcile_metrics(stored, NAMES).collect()} == {
        ("yellow", 0),
        ("green", 0),
        ("total", 0),
    }
    impact = {r[0]: tuple(r)[1:] for r in quality.cleaning_impact(stored, NAMES).collect()}
    assert impact["total"] == (7, 2, 5, 0.2857, True)
    doctored = stored.withColumn(
        "valor", F.col("valor") + F.when(F.col("metrica") == R1, 1).otherwise(0)
    )
    assert not any(r["reconciled"] for r in quality.cleaning_impact(doctored, NAMES).collect())


def test_worst_rows_settle_ties(spark):
    tied = [one(amount=-5.0, n=n) for n in (4, 2, 3, 1)] + [one(amount=-9.0)]
    rejected = quality.project(
        quality.rejected_rows(classified(spark, tied), REASON), taxi.REJECTED
    )
    columns = ["total_amount", "passenger_count"]
    found = quality.worst_rows(rejected, taxi.REJECT_REASON, R3, "total_amount", columns, 3)
    assert [tuple(r) for r in found.collect()] == [(-9.0, 1), (-5.0, 1), (-5.0, 2)]


def test_contract_holds_on_clean_rows_and_not_on_all(spark):
    df = classified(spark, SEVEN)
    promised = taxi.guarantees()
    clean = quality.project(quality.clean_rows(df, REASON), taxi.CLEAN)
    assert {r["broken"] for r in quality.contract_check(clean, promised).collect()} == {0}
    whole = quality.project(df, taxi.CLEAN).withColumn("pickup_hour", F.lit(24))
    found = quality.contract_check(whole, promised).collect()
    broken = {r["guarantee"]: r["broken"] for r in found}
    assert broken["hour_in_day"] == 7
    assert broken["pickup_in_window"] == 2
    assert broken["passengers_positive"] == 2
    assert broken["passenger_count_not_null"] == 1
    assert broken["fleet_in_domain"] == 0
    assert len(broken) == 15


def test_row_operators_run_on_a_stream(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    trips(spark, SEVEN).write.parquet(source)
    stream = spark.readStream.schema(trips(spark, []).schema).parquet(source)
    marked = quality.project(quality.classify(stream, RULES, REASON), taxi.REJECTED)
    query = (
        marked.writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start(target)
    )
    query.awaitTermination()
    found = [r[0] for r in spark.read.parquet(target).select("_reject_reason").collect()]
    assert sorted(map(str, found)) == sorted(map(str, SEVEN_REASONS))
