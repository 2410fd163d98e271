"""Expected files, sizes, refresh decisions and integrity."""

import pytest
from pyspark.sql import functions as F

from ledgerlake import taxi
from ledgerlake.sources import landing
from ledgerlake.suite import fixtures
from tests.frames import rows
from tests.test_sinks import OPEN_FILES, written  # noqa: F401

LAYOUT = taxi.LAYOUT
PARTITIONS = [("yellow", "2023-01"), ("yellow", "2023-02"), ("green", "2023-01")]


def expected(spark, root):
    return landing.manifest(landing.requested_grid(spark, PARTITIONS), LAYOUT, str(root))


def put(root, scope, month, content):
    path = root / scope / month[:4] / LAYOUT.file_name(scope, month)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content)


def sizes(spark, root):
    return landing.source_sizes(landing.listing(spark, str(root)), LAYOUT)


def test_manifest(spark):
    found = rows(expected(spark, "/landing/"))
    assert found[0] == (
        "green",
        "2023-01",
        "green_tripdata_2023-01.parquet",
        "/landing/green/2023/green_tripdata_2023-01.parquet",
    )
    assert [r[3] for r in found] == [LAYOUT.source_path("/landing", r[0], r[1]) for r in found]


def test_month_grid_spans_years(spark):
    ddl = "scope string, f string, l string"
    bounds = spark.createDataFrame([("a", "2022-11", "2023-02")], ddl)
    found = [r.month for r in landing.month_grid(bounds, "f", "l").collect()]
    assert found == ["2022-11", "2022-12", "2023-01", "2023-02"]


def test_inventory_and_missing(spark, tmp_path):
    put(tmp_path, "yellow", "2023-01", b"12345")
    put(tmp_path, "green", "2023-01", b"1")
    put(tmp_path, "green", "2022-12", b"not asked for")
    (tmp_path / "notes.txt").write_text("ignored")
    found = landing.inventory(expected(spark, tmp_path), sizes(spark, tmp_path))
    assert {(r.scope, r.month, r.local_bytes) for r in found.collect()} == {
        ("yellow", "2023-01", 5),
        ("yellow", "2023-02", None),
        ("green", "2023-01", 1),
    }
    absent = landing.missing(expected(spark, tmp_path), sizes(spark, tmp_path))
    assert [r.file for r in absent.collect()] == ["yellow_tripdata_2023-02.parquet"]
    with pytest.raises(landing.MissingFilesError, match="1 expected .*yellow_tripdata_2023-02"):
        landing.require_all(expected(spark, tmp_path), sizes(spark, tmp_path))
    put(tmp_path, "yellow", "2023-02", b"")
    with pytest.raises(landing.MissingFilesError):
        landing.require_all(expected(spark, tmp_path), sizes(spark, tmp_path))
    put(tmp_path, "yellow", "2023-02", b"1")
    landing.require_all(expected(spark, tmp_path), sizes(spark, tmp_path))


def test_a_folder_of_part_files_is_one_source(spark, tmp_path):
    folder = tmp_path / "yellow" / "2023" / "yellow_tripdata_2023-01.parquet"
    folder.mkdir(parents=True)
    (folder / "part-0.parquet").write_bytes(b"123")
    (folder / "part-1.parquet").write_bytes(b"45")
    assert rows(sizes(spark, tmp_path)) == [("yellow", "2023-01", 5)]


def test_refresh_decisions(spark):
    cases = [(None, 9), (0, 9), (8, 9), (10, 9), (9, None), (None, None), (9, 9)]
    df = spark.createDataFrame(cases, "here long, there long")
    found = [r.status for r in landing.refresh_decisions(df, "here", "there").collect()]
    assert found == ["refresh"] * 6 + ["skip"]
    summary = landing.outcome_summary(landing.refresh_decisions(df, "here", "there"), "here")
    assert rows(summary) == [("refresh", 6, 27), ("skip", 1, 9)]


def integrity(spark, files, totals, full_scope=True):
    found = landing.integrity(
        spark.createDataFrame(files, "scope string, month string, local_bytes long"),
        spark.createDataFrame(totals, "scope string, expected_bytes long"),
        full_scope,
    )
    return landing.landing_intact(found), {r.scope: r.intact for r in found.collect()}


def test_integrity_of_published_sizes(spark):
    yellow = [47673370, 47748012, 56127762, 54222699, 58654627]
    green = [1427002, 1533740, 1730999, 1570467, 1673841]
    files = [
        (fleet, month, size)
        for fleet, listed in (("yellow", yellow), ("green", green))
        for month, size in zip(taxi.MONTHS, listed, strict=True)
    ]
    totals = list(taxi.EXPECTED_BYTES.items())
    assert integrity(spark, files, totals) == (True, {"yellow": True, "green": True})
    assert integrity(spark, files, totals, full_scope=False)[0] is False


@pytest.mark.parametrize(
    ("files", "totals"),
    [
        ([], []),
        ([("a", "2023-01", None), ("a", "2023-02", 5)], [("a", 5)]),
        ([("a", "2023-01", 4)], [("a", 5)]),
        ([("b", "2023-01", 5)], [("a", 5)]),
        ([("b", "2023-01", 5)], []),
        ([], [("a", 5)]),
    ],
)
def test_integrity_is_refused(spark, files, totals):
    assert integrity(spark, files, totals)[0] is False


def test_trips_are_landed_where_they_are_read(spark, tmp_path, written):  # noqa: F811
    items = [
        (o, 7, 3, o % 7 + 1, 5.0, 100.0 + o, 0.05, 0.04, "RAN"[o % 3], "F", f"199{o % 8}-0{o % 9 + 1}-03")
        for o in range(200)
    ]
    spark.createDataFrame(
        items,
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
        "l_linestatus string, l_shipdate string",
    ).withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp_ntz")).coalesce(1).write.parquet(
        str(tmp_path / "lineitem.parquet")
    )
    written.clear()
    root = fixtures.landing_root(spark, str(tmp_path))
    assert len(written) == 3
    for plan, open_files in written:
        assert open_files > 0 and "Sort" not in plan and "Exchange" not in plan
    assert int(spark.conf.get(OPEN_FILES)) == 0
    landed = spark.read.option("basePath", root).parquet(f"{root}/fleet=*/month=*")
    trips = fixtures.trips(spark, str(tmp_path))
    assert rows(landed.groupBy("fleet", "month").count()) == rows(
        trips.groupBy("taxi_type", "source_year_month").count()
    )
