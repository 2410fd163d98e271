"""The declared case: names, order, types and declared drift."""

import pytest

from ledgerlake import taxi
from ledgerlake.spec import Layout


def test_canonical_table_has_24_columns_in_order():
    columns = taxi.TABLE.all_columns
    assert len(columns) == 24
    assert list(columns)[:3] == ["VendorID", "tpep_pickup_datetime", "tpep_dropoff_datetime"]
    assert list(columns)[-3:] == ["taxi_type", "source_year_month", "ingested_at"]
    assert columns["ingested_at"] == "timestamp"
    assert columns["passenger_count"] == "int"


def test_published_columns():
    assert taxi.CLEAN.names == [
        "VendorID",
        "passenger_count",
        "total_amount",
        "tpep_pickup_datetime",
        "tpep_dropoff_datetime",
        "taxi_type",
        "pickup_year_month",
        "pickup_hour",
    ]
    assert taxi.REJECTED.names == [*taxi.CLEAN.names, "source_year_month", "_reject_reason"]


def test_rules_keep_their_order():
    names = [r.name for r in taxi.quality_rules()]
    assert names == list(taxi.RULE_NAMES.values())
    assert [n[:12] for n in names] == [f"removidas_r{i}" for i in (1, 2, 3, 4)]


@pytest.mark.parametrize(
    ("fleet", "month", "count", "present", "absent"),
    [
        ("yellow", "2023-01", 19, {"airport_fee", "tpep_pickup_datetime"}, {"Airport_fee"}),
        ("yellow", "2023-02", 19, {"Airport_fee"}, {"airport_fee", "ehail_fee", "trip_type"}),
        ("yellow", "2023-05", 19, {"Airport_fee"}, {"airport_fee"}),
        ("green", "2023-01", 20, {"lpep_pickup_datetime", "ehail_fee"}, {"airport_fee"}),
        ("green", "2023-05", 20, {"lpep_dropoff_datetime", "trip_type"}, {"Airport_fee"}),
    ],
)
def test_columns_a_file_must_have(fleet, month, count, present, absent):
    names = set(taxi.sources()[fleet].spelling(month, taxi.TABLE).values())
    assert len(names) == count
    assert present <= names
    assert not absent & names


def test_unknown_fleet_raises():
    with pytest.raises(ValueError, match="unknown source 'fhv'"):
        taxi.dataset().source("fhv")


def test_file_names_and_paths():
    assert taxi.LAYOUT.file_name("green", "2023-05") == "green_tripdata_2023-05.parquet"
    expected = "/landing/yellow/2023/yellow_tripdata_2023-01.parquet"
    assert taxi.LAYOUT.source_path("/landing", "yellow", "2023-01") == expected
    assert taxi.LAYOUT.source_path("/landing/", "yellow", "2023-01") == expected


def test_month_marker():
    assert taxi.LAYOUT.month_marker() == "_tripdata_"
    assert Layout("x", "{root}/fleet={scope}/month={month}").month_marker() == "/month="
    assert Layout("x", "{root}/{scope}/{month}").month_marker() is None
