"""Averages, scopes, extremes, ablation, comparison and exploration on small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlake import taxi
from ledgerlake.operators import answers, compare, explore
from ledgerlake.plans import views
from tests.frames import rows, trips

SCOPES = {"all": None, "yellow": ("yellow",)}


def hours(spark, data):
    return spark.createDataFrame(data, "hour int, fleet string, n int")


DATA = [
    (0, "yellow", 1),
    (0, "yellow", 2),
    (0, "green", 6),
    (1, "yellow", 4),
    (2, "green", 5),
    (2, "green", None),
    (3, "yellow", None),
]


def test_scoped_average_equals_one_average_per_scope(spark):
    df = hours(spark, DATA)
    found = answers.scoped_average(df, "hour", "fleet", "n", SCOPES, 3, "scope", "mean", "rows")
    assert rows(found) == [
        ("all", 0, 3.0, 3),
        ("all", 1, 4.0, 1),
        ("all", 2, 5.0, 2),
        ("all", 3, None, 1),
        ("yellow", 0, 1.5, 2),
        ("yellow", 1, 4.0, 1),
        ("yellow", 3, None, 1),
    ]


def test_no_hour_is_lost_side_by_side(spark):
    df = hours(spark, DATA)
    side = answers.scopes_side_by_side(df, "hour", "fleet", "n", SCOPES, 3, "m_")
    expected = [(0, 3.0, 1.5), (1, 4.0, 4.0), (2, 5.0, None), (3, None, None)]
    assert rows(side) == expected
    long = answers.scoped_average(df, "hour", "fleet", "n", SCOPES, 3, "scope", "mean", "rows")
    assert rows(answers.pivot_scopes(long, "hour", "scope", "mean", list(SCOPES), "m_")) == expected
    gap = answers.widest_gap(side, "hour", "m_all", "m_yellow")
    assert rows(gap) == [(1.5, 0)]


@pytest.mark.parametrize(("month", "days"), [("2024-02", 29), ("2023-02", 28), ("2023-05", 31)])
def test_demand_divides_by_the_days_of_the_month(spark, month, days):
    df = hours(spark, [(0, "yellow", 100), (0, "green", 50)])
    found = answers.occupancy_and_demand(df, "hour", "fleet", "n", SCOPES, month).first()
    assert found["demanda_all"] == round(150 / days, 1)
    assert found["ocupacao_yellow"] == 100.0


def test_extremes_take_the_smallest_hour_on_a_tie(spark):
    df = spark.createDataFrame(
        [(5, 1.0, 2.0), (3, 9.0, 2.0), (7, 9.0, 2.0), (1, 1.0, None)],
        "hour int, a double, b double",
    )
    assert rows(answers.peaks(df, "hour", ["a", "b"])) == [("a", 3, 9.0), ("b", 3, 2.0)]
    assert rows(answers.troughs(df, "hour", ["a", "b"])) == [("a", 1, 1.0), ("b", 3, 2.0)]


def test_ablation_is_the_average_under_each_filter(spark):
    data = [
        (1, "2023-01-05 10:00", "2023-01-05 11:00", n, a, "yellow", "2023-01")
        for n, a in [(1, 10.0), (0, 20.0), (None, 30.0), (2, -40.0), (0, -1.0)]
    ]
    month = F.date_format("tpep_pickup_datetime", "yyyy-MM").alias("mes")
    found = answers.ablation(trips(spark, data), month, "total_amount", taxi.ABLATION)
    assert found.columns == ["mes", *taxi.ABLATION]
    assert rows(found) == [("2023-01", 3.8, 20.0, -15.0, 10.0)]


def test_growth(spark):
    df = spark.createDataFrame(
        [("2023-05", 29.45), ("2023-01", 27.46), ("2023-03", 28.28)], "m string, v double"
    )
    assert rows(answers.growth(df, "m", "v")) == [("2023-01", "2023-05", 27.46, 29.45, 7.25)]


def test_sql_and_dataframe_answers_agree(spark):
    data = [
        (i % 3, i % 24, random.Random(i).choice(["yellow", "green"]), i % 5 + 1, i * 1.25)
        for i in range(500)
    ]
    df = spark.createDataFrame(
        data,
        "VendorID int, pickup_hour int, taxi_type string, passenger_count int, total_amount double",
    ).withColumn("pickup_year_month", F.concat(F.lit("2023-0"), (F.col("VendorID") + 4)))
    df.createOrReplaceTempView("answers_trips")
    by_month = spark.sql(views.month_view_sql("answers_trips"))
    assert rows(by_month) == rows(views.month_average(df))
    by_hour = spark.sql(views.hour_view_sql("answers_trips", "2023-05"))
    assert rows(by_hour) == rows(views.hour_average(df, "2023-05"))
    assert by_hour.count() == 16


def test_compare_keeps_keys_of_one_side_and_fails_them(spark):
    left = spark.createDataFrame([("a", 1.0), ("b", 2.0), (None, 3.0)], "k string, v double")
    right = spark.createDataFrame([("a", 1.01), ("c", 2.0), (None, None)], "k string, w double")
    found = {r.k: r for r in compare.compare(left, right, ["k"], {"x": ("v", "w")}, 0.02).collect()}
    assert {k: r.ok for k, r in found.items()} == {"a": True, "b": False, "c": False, None: False}
    assert found["b"].x_right is None
    strict = compare.compare(left, right, ["k"], {"x": ("v", "w")}, 0.001)
    assert not any(r.ok for r in strict.collect())


def test_benchmark_deviation(spark):
    actual = spark.createDataFrame(
        [("2023-01", 27.46), ("2023-02", 28.37), ("2023-07", 1.0)], "m string, v double"
    )
    expected = spark.createDataFrame(
        list(taxi.BENCHMARK_MONTH_AMOUNT.items()), "m string, e double"
    )
    found = {
        r.m: (r.desvio, r.ok)
        for r in compare.deviation(
            actual, expected, "m", "v", "e", taxi.BENCHMARK_TOLERANCE
        ).collect()
    }
    assert found["2023-01"] == (0.02, True)
    assert found["2023-02"] == (1.04, False)
    assert found["2023-03"] == (None, False)
    assert found["2023-07"] == (None, False)


def test_volume_against_expected(spark):
    counts = spark.createDataFrame(
        [("yellow", "2023-01", 5), ("yellow", "2023-02", 7), ("green", "2023-01", 2)],
        "f string, m string, rows long",
    )
    expected = spark.createDataFrame(
        [("yellow", "2023-01", 5), ("yellow", "2023-02", 8), ("green", "2023-02", 2)],
        "f string, m string, expected long",
    )
    found = compare.volume_against_expected(counts, expected, "f", "m", "total")
    assert rows(found) == [
        ("green", "2023-01", 2, 0, "DIVERGE"),
        ("green", "2023-02", 0, 2, "DIVERGE"),
        ("green", "total", 2, 2, "OK"),
        ("total", "total", 14, 15, "DIVERGE"),
        ("yellow", "2023-01", 5, 5, "OK"),
        ("yellow", "2023-02", 7, 8, "DIVERGE"),
        ("yellow", "total", 12, 13, "DIVERGE"),
    ]


def test_hypotheses(spark):
    data = [
        (1, "2008-12-31 10:00", "2023-01-05 11:00", None, -751.0, "yellow", "2023-01"),
        (1, None, None, 1, 5.0, "yellow", "2023-01"),
    ]
    df = trips(spark, data).selectExpr(
        "*", "0 AS payment_type", "99 AS RatecodeID", "258928.15D AS trip_distance"
    )
    found = {
        r["check"]: (r.observed, r.confirmed)
        for r in explore.run_checks(df, taxi.hypotheses(null_passengers=1)).collect()
    }
    assert found == {
        "A_null_passengers": ("1", True),
        "B_pickups_outside": ("1", True),
        "B_earliest_pickup": ("2008-12-31 10:00:00", True),
        "C_negative_amounts": ("1", True),
        "C_lowest_amount": ("-751.0", True),
        "D_payment_type_0": ("2", True),
        "E_ratecode_99": ("2", True),
        "F_longest_distance": ("258928.15", True),
    }
    empty = explore.run_checks(df.limit(0), taxi.hypotheses())
    assert not any(r.confirmed for r in empty.collect())


def test_null_and_zero_counts_and_codes(spark):
    df = spark.createDataFrame(
        [("a", None, 0), ("a", 0, 1), ("b", 3, 0), ("b", None, None)], "f string, n int, c int"
    )
    assert rows(explore.null_and_zero_counts(df, "f", "n")) == [("a", 1, 1), ("b", 1, 0)]
    assert rows(explore.code_matches_null(df, "c", 0, "n")) == [(2, 2)]


def test_percentiles_are_exact(spark):
    rng = random.Random(7)
    values = [round(rng.lognormvariate(2, 3), 2) for _ in range(20000)]
    data = [("a", v) for v in values] + [("b", 4.0)] * 300 + [(None, 1.0), (None, None), ("c", None)]
    df = spark.createDataFrame(data, "f string, v double").repartition(8)
    fractions = (0.01, 0.5, 0.99)
    result = explore.percentiles(df, "f", {"p": ("v", fractions)}, {"mean": "v"}).collect()
    found = {r["f"]: r for r in result}
    ordered = sorted(values)
    assert found["a"]["p"] == [ordered[-(-len(values) * k // 100) - 1] for k in (1, 50, 99)]
    assert found["b"]["p"] == [4.0] * 3
    assert found[None]["p"] == [1.0] * 3
    assert found["c"]["p"] is None
    assert found["a"]["mean"] == pytest.approx(sum(values) / len(values))


def test_percentiles_of_what_is_no_finite_number(spark):
    data = [(float(x),) for x in ("-inf", "1", "2", "inf", "nan", "nan")]
    df = spark.createDataFrame(data, "v double")
    found = explore.exact_percentiles(df, [], {"v": [0.1, 0.5, 0.6, 0.9]}).orderBy("fraction").collect()
    assert [str(r["value"]) for r in found] == ["-inf", "2.0", "inf", "nan"]
    assert explore.exact_percentiles(df.limit(0), [], {"v": [0.5]}).count() == 0


def test_numeric_summary(spark):
    df = spark.createDataFrame([(float(i), i % 3) for i in range(1, 101)], "a double, b int")
    found = {r.summary: (r.a, r.b) for r in explore.numeric_summary(df, ["a", "b"]).collect()}
    assert found == {
        "count": (100.0, 100.0),
        "min": (1.0, 0.0),
        "25%": (25.0, 0.0),
        "50%": (50.0, 1.0),
        "75%": (75.0, 2.0),
        "max": (100.0, 2.0),
    }
