"""The whole run on landed files: tables, repeatability, selective runs, failures."""

import os
import uuid
from dataclasses import replace
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerlake import taxi
from ledgerlake.operators import compare, conform, quality
from ledgerlake.plans import batch, views
from ledgerlake.sources import landing
from tests.frames import R1, SEVEN, land, rows

# Hand-made files do not have the published sizes.
DATASET = taxi.dataset(expected_bytes={})
MONTH = "2023-05"


@pytest.fixture
def warehouse(tmp_path):
    return batch.Warehouse(str(tmp_path / "warehouse"), f"batch_{uuid.uuid4().hex[:8]}")


def run(spark, warehouse, root, partitions):
    return batch.run(
        spark, DATASET, root, warehouse, partitions, MONTH, run_ts=datetime(2023, 6, 1)
    )


def table(spark, warehouse, name):
    return spark.table(warehouse.name(name))


def snapshot(spark, warehouse):
    return {
        name: rows(table(spark, warehouse, name).drop("ingested_at"))
        for name in (views.CONFORMED, views.TRIPS, views.REJECTED_TRIPS, views.METRICS)
    }


def test_full_run_and_its_repetition(spark, warehouse, tmp_path):
    root = str(tmp_path / "landing")
    partitions = land(spark, root, DATASET, SEVEN)
    result = run(spark, warehouse, root, partitions)
    conformed = table(spark, warehouse, views.CONFORMED)
    assert [(f.name, f.dataType.simpleString()) for f in conformed.schema] == list(
        taxi.TABLE.all_columns.items()
    )
    assert conformed.count() == 7
    for name, output in ((views.TRIPS, taxi.CLEAN), (views.REJECTED_TRIPS, taxi.REJECTED)):
        schema = table(spark, warehouse, name).schema
        assert [(f.name, f.dataType.simpleString()) for f in schema] == [
            (c.name, c.type) for c in output.columns
        ]
    assert table(spark, warehouse, views.TRIPS).count() == 2
    assert table(spark, warehouse, views.METRICS).count() == 18
    assert rows(result["month"]) == [("2023-04", 31.5, 1)]
    assert rows(result["hour"]) == [("frota_completa", 3, 5.0, 1)]
    assert all(r.ok for r in result["month_parity"].collect())
    before = snapshot(spark, warehouse)
    run(spark, warehouse, root, partitions)
    assert snapshot(spark, warehouse) == before


def test_selective_run_leaves_the_rest_alone(spark, warehouse, tmp_path):
    root = str(tmp_path / "landing")
    partitions = land(spark, root, DATASET, SEVEN)
    run(spark, warehouse, root, partitions)
    # The May file of yellow is republished: its two bad rows become three good ones.
    good = [
        (1, f"2023-05-05 0{h}:00", f"2023-05-05 0{h}:30", 2, 10.0, "yellow", "2023-05")
        for h in (1, 2, 3)
    ]
    land(spark, root, DATASET, good)
    run(spark, warehouse, root, [("yellow", "2023-05")])
    counts = {
        (r.taxi_type, r.metrica): r.valor
        for r in table(spark, warehouse, views.METRICS).collect()
    }
    assert counts[("yellow", "linhas_bronze")] == 7
    assert counts[("yellow", "linhas_gold")] == 4
    assert counts[("yellow", R1)] == 1
    assert counts[("green", "linhas_gold")] == 1
    rejected = table(spark, warehouse, views.REJECTED_TRIPS)
    assert rejected.filter("source_year_month = '2023-05'").count() == 0
    # Republished without any good row: the clean rows of that partition go.
    land(spark, root, DATASET, [(*good[0][:3], 0, *good[0][4:])])
    run(spark, warehouse, root, [("yellow", "2023-05")])
    clean = table(spark, warehouse, views.TRIPS)
    assert rows(clean.groupBy("taxi_type", "pickup_year_month").count()) == [
        ("green", "2023-05", 1),
        ("yellow", "2023-04", 1),
    ]


def test_missing_source_stops_before_any_write(spark, warehouse, tmp_path):
    root = str(tmp_path / "landing")
    partitions = land(spark, root, DATASET, SEVEN)
    with pytest.raises(landing.MissingFilesError, match="green_tripdata_2023-02"):
        run(spark, warehouse, root, [*partitions, ("green", "2023-02")])
    assert not (tmp_path / "warehouse").exists()


def test_wrong_bytes_of_a_whole_scope_stop_before_any_write(spark, warehouse, tmp_path):
    root = str(tmp_path / "landing")
    partitions = land(spark, root, DATASET, SEVEN)
    months = tuple(m for f, m in partitions if f == "yellow")
    sizes = landing.source_sizes(landing.listing(spark, root), DATASET.layout)
    known = {r.scope: r.local_bytes for r in sizes.groupBy("scope").agg(
        F.sum("local_bytes").alias("local_bytes")).collect()}
    whole = replace(DATASET, months=months, expected_bytes=known)
    batch.check_landing(spark, whole, root, partitions)
    wrong = replace(whole, expected_bytes={**known, "yellow": known["yellow"] + 1})
    with pytest.raises(landing.IntegrityError, match="yellow"):
        batch.run(spark, wrong, root, warehouse, partitions, MONTH)
    assert not (tmp_path / "warehouse").exists()
    # Green has only one of the months, so its total cannot be judged.
    other = replace(whole, expected_bytes={"green": 1})
    batch.check_landing(spark, other, root, partitions)


def test_drift_stops_before_any_write(spark, warehouse, tmp_path):
    root = str(tmp_path / "landing")
    partitions = land(spark, root, DATASET, SEVEN)
    path = DATASET.layout.source_path(root, "green", "2023-05")
    drifted = spark.read.parquet(path).withColumn("surprise", F.lit(1))
    spark.createDataFrame(drifted.collect(), drifted.schema).write.mode("overwrite").parquet(path)
    with pytest.raises(conform.DriftError, match="unexpected column surprise"):
        run(spark, warehouse, root, partitions)
    assert not (tmp_path / "warehouse").exists()


def test_rows_lost_from_storage_are_found_by_the_audit(spark, warehouse, tmp_path):
    root = str(tmp_path / "landing")
    partitions = land(spark, root, DATASET, SEVEN)
    run(spark, warehouse, root, partitions)
    batch.audit(spark, DATASET, warehouse)
    store = warehouse.checked(DATASET)
    nothing = batch.checked(spark, DATASET, warehouse).limit(0)
    store.replace(spark, nothing, [("green",)])
    with pytest.raises(quality.ReconciliationError, match="are not the kept counts.*green"):
        batch.audit(spark, DATASET, warehouse)


def spoil(store, inside):
    """Makes the stored files unreadable whose path holds the text."""
    spoilt = 0
    for folder, _, names in os.walk(store.root):
        for name in names:
            if name.endswith(".parquet") and inside in folder:
                with open(os.path.join(folder, name), "wb") as file:
                    file.write(b"spoilt")
                spoilt += 1
    assert spoilt


def test_a_selective_run_reads_no_file_of_other_partitions(spark, warehouse, tmp_path):
    root = str(tmp_path / "landing")
    partitions = land(spark, root, DATASET, SEVEN)
    run(spark, warehouse, root, partitions)
    for store in (warehouse.conformed(DATASET), warehouse.checked(DATASET)):
        spoil(store, "taxi_type=green")
        spoil(store, "source_year_month=2023-01")
    batch.run(
        spark, DATASET, root, warehouse, [("yellow", "2023-05")], MONTH, check_answers=False
    )
    metrics = {(r.taxi_type, r.metrica): r.valor for r in table(spark, warehouse, views.METRICS).collect()}
    assert metrics[("total", "linhas_bronze")] == 7 and metrics[("green", "linhas_gold")] == 1


def test_nothing_is_published_when_a_check_fails(spark, warehouse, tmp_path, monkeypatch):
    root = str(tmp_path / "landing")
    partitions = land(spark, root, DATASET, SEVEN)
    run(spark, warehouse, root, partitions)
    before = snapshot(spark, warehouse)
    land(spark, root, DATASET, [(*SEVEN[0][:3], 9, *SEVEN[0][4:])])

    def broken(*_):
        raise quality.ReconciliationError("broken")

    monkeypatch.setattr(batch, "_require_consistent", broken)
    with pytest.raises(quality.ReconciliationError, match="broken"):
        run(spark, warehouse, root, [("yellow", "2023-04")])
    assert snapshot(spark, warehouse) == before
    assert warehouse.conformed(DATASET).leftovers(spark) == []
    assert warehouse.checked(DATASET).leftovers(spark) == []
    monkeypatch.undo()
    run(spark, warehouse, root, [("yellow", "2023-04")])
    assert snapshot(spark, warehouse) != before


def test_answers_that_differ_stop_the_run(spark, warehouse, tmp_path, monkeypatch):
    root = str(tmp_path / "landing")
    partitions = land(spark, root, DATASET, SEVEN)
    again = views.month_average
    monkeypatch.setattr(
        views, "month_average", lambda t: again(t).withColumn(taxi.MONTH_MEAN, F.col(taxi.MONTH_MEAN) + 1)
    )
    with pytest.raises(compare.ComparisonError, match="month_parity.*2023-04"):
        run(spark, warehouse, root, partitions)


def test_a_run_of_nothing_changes_nothing(spark, warehouse, tmp_path):
    root = str(tmp_path / "landing")
    partitions = land(spark, root, DATASET, SEVEN)
    run(spark, warehouse, root, partitions)
    before = snapshot(spark, warehouse)
    run(spark, warehouse, root, [])
    assert snapshot(spark, warehouse) == before


def test_all_partitions():
    assert batch.all_partitions(["a", "b"], ["2023-01", "2023-02"]) == [
        ("a", "2023-01"),
        ("a", "2023-02"),
        ("b", "2023-01"),
        ("b", "2023-02"),
    ]
