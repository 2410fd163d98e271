"""Partition overwrite, full overwrite, views."""

import os

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from ledgerlake.plans import sinks
from tests.frames import rows

KEYS = ("fleet", "month")
ALL = [("a", "2023-01"), ("a", "2023-02"), ("b", "2023-01")]


def table(spark, value, partitions=ALL, n=3):
    data = [(i + value, f, m) for f, m in partitions for i in range(n)]
    return spark.createDataFrame(data, "id long, fleet string, month string")


def stored(spark, path):
    df = spark.read.schema("id long, fleet string, month string").parquet(path)
    return {(r.fleet, r.month): (r.n, r.low) for r in df.groupBy("fleet", "month").agg(
        F.count("*").alias("n"), F.min("id").alias("low")).collect()}


def files(path):
    return {
        os.path.join(folder, name): os.path.getmtime(os.path.join(folder, name))
        for folder, _, names in os.walk(path)
        for name in names
        if name.endswith(".parquet")
    }


@pytest.fixture
def path(spark, tmp_path):
    target = str(tmp_path / "t")
    sinks.write_partitions(table(spark, 0), target, KEYS, ALL)
    return target


def test_only_the_targets_are_replaced(spark, path):
    before = files(path)
    sinks.write_partitions(
        table(spark, 100, [("a", "2023-02")], n=2), path, KEYS, [("a", "2023-02")]
    )
    assert stored(spark, path) == {
        ("a", "2023-01"): (3, 0),
        ("a", "2023-02"): (2, 100),
        ("b", "2023-01"): (3, 0),
    }
    others = {f: t for f, t in before.items() if "month=2023-02" not in f}
    assert others == {f: t for f, t in files(path).items() if "month=2023-02" not in f}


def test_repeating_a_write_changes_nothing(spark, path):
    before = stored(spark, path)
    sinks.write_partitions(table(spark, 0), path, KEYS, ALL)
    assert stored(spark, path) == before


def test_a_target_without_rows_is_emptied(spark, path):
    targets = [("a", "2023-01"), ("a", "2023-02")]
    sinks.write_partitions(table(spark, 7, [("a", "2023-01")]), path, KEYS, targets)
    assert stored(spark, path) == {("a", "2023-01"): (3, 7), ("b", "2023-01"): (3, 0)}


def test_a_target_without_rows_raises_on_request(spark, path):
    targets = [("a", "2023-01"), ("a", "2023-02")]
    new = table(spark, 7, [("a", "2023-01")])
    with pytest.raises(sinks.EmptyTargetError, match="month=2023-02"):
        sinks.write_partitions(new, path, KEYS, targets, when_empty="raise")


def test_rows_outside_the_targets_stop_the_write(spark, path):
    before = stored(spark, path)
    with pytest.raises(Exception, match="row outside the target partitions: b/2023-01"):
        sinks.write_partitions(table(spark, 7), path, KEYS, ALL[:2])
    assert stored(spark, path) == before


def test_targets_may_name_leading_columns_only(spark, path):
    new = table(spark, 50, [("a", "2023-03")])
    sinks.write_partitions(new, path, KEYS, [("a",)])
    assert stored(spark, path) == {("a", "2023-03"): (3, 50), ("b", "2023-01"): (3, 0)}


def test_rebalanced_write_keeps_all_rows_of_a_hot_partition(spark, tmp_path):
    hot = table(spark, 0, [("a", "2023-01")], n=5000).unionByName(table(spark, 0, ALL[1:]))
    target = str(tmp_path / "hot")
    sinks.write_partitions(hot, target, KEYS, ALL, rebalance=True)
    assert stored(spark, target) == {
        ("a", "2023-01"): (5000, 0),
        ("a", "2023-02"): (3, 0),
        ("b", "2023-01"): (3, 0),
    }


def test_full_overwrite_replaces_the_schema(spark, tmp_path):
    target = str(tmp_path / "whole")
    sinks.overwrite(table(spark, 0), target)
    sinks.overwrite(spark.range(2).withColumn("x", F.lit("y")), target)
    assert rows(spark.read.parquet(target)) == [(0, "y"), (1, "y")]


def test_table_and_view(spark, path, tmp_path):
    sinks.create_schema(spark, "sink_test")
    sinks.register_table(
        spark, "sink_test.t", path, "id long, fleet string, month string", KEYS
    )
    assert spark.table("sink_test.t").count() == 9
    sinks.write_partitions(table(spark, 9, [("c", "2023-09")]), path, KEYS, [("c", "2023-09")])
    sinks.register_table(
        spark, "sink_test.t", path, "id long, fleet string, month string", KEYS
    )
    assert spark.table("sink_test.t").count() == 12
    with pytest.raises(ValueError, match="already lies in"):
        sinks.register_table(
            spark, "sink_test.t", f"{path}x", "id long, fleet string, month string", KEYS
        )
    query = "SELECT fleet, count(*) AS n FROM sink_test.t GROUP BY fleet"
    sinks.publish_view(spark, "sink_test.v", query, {"fleet": "which", "n": "how many"})
    assert rows(spark.table("sink_test.v")) == [("a", 6), ("b", 3), ("c", 3)]
    assert [f.metadata.get("comment") for f in spark.table("sink_test.v").schema] == [
        "which",
        "how many",
    ]
    listed = sinks.views_in(spark, "sink_test").filter("NOT isTemporary").collect()
    assert [r.viewName for r in listed] == ["v"]
    sinks.overwrite_table(spark.range(3), "sink_test.m", str(tmp_path / "m"))
    sinks.overwrite_table(table(spark, 1), "sink_test.m", str(tmp_path / "m"))
    assert spark.table("sink_test.m").columns == ["id", "fleet", "month"]


ODD = ["a:b", "a b", "a%b", "a/b", "a=b", "été", None]


def test_odd_partition_values(spark, tmp_path):
    target = str(tmp_path / "t")
    cells = [(v, m) for v in ODD for m in ("m1", "m2")]
    sinks.write_partitions(table(spark, 0, cells), target, KEYS, cells)
    assert set(stored(spark, target)) == set(cells)
    sinks.write_partitions(table(spark, 9, [(v, "m1") for v in ODD], n=1), target, KEYS, cells)
    assert stored(spark, target) == {(v, "m1"): (1, 9) for v in ODD}
    with pytest.raises(sinks.EmptyTargetError):
        some = [("a:b", "m1")]
        sinks.write_partitions(table(spark, 0, []), target, KEYS, some, when_empty="raise")


def test_joined_values_are_not_mistaken(spark, tmp_path):
    rows_ = table(spark, 0, [("a/b", "c")])
    with pytest.raises(Exception, match="outside the target"):
        sinks.write_partitions(rows_, str(tmp_path / "t"), KEYS, [("a", "b/c")])


def test_rows_that_a_join_removes_do_not_count(spark, tmp_path):
    wanted = spark.createDataFrame([("a", "2023-01")], "fleet string, month string")
    for how in ("left_semi", "inner"):
        target = str(tmp_path / how)
        cut = table(spark, 0).join(wanted, ["fleet", "month"], how).select("id", "fleet", "month")
        sinks.write_partitions(cut, target, KEYS, [("a", "2023-01")])
        assert stored(spark, target) == {("a", "2023-01"): (3, 0)}


def test_comments_with_quotes(spark, tmp_path):
    view = "default.quoted_view"
    sinks.publish_view(spark, view, "SELECT 1 AS one", {"one": "the driver's \\ count"})
    told = spark.sql(f"DESCRIBE TABLE {view}").first()["comment"]
    spark.sql(f"DROP VIEW {view}")
    assert told == "the driver's \\ count"


OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"


@pytest.fixture
def written(spark, monkeypatch):
    """Plan of each frame written as Parquet, and how many files a task may keep open for it."""
    seen = []
    parquet = DataFrameWriter.parquet

    def told(writer, *args, **kwargs):
        plan = writer._df._jdf.queryExecution().executedPlan().toString()
        seen.append((plan, int(spark.conf.get(OPEN_FILES))))
        return parquet(writer, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", told)
    return seen


def test_partitions_are_written_without_a_sort(spark, tmp_path, written):
    sinks.write_partitions(table(spark, 0), str(tmp_path / "t"), KEYS, ALL)
    ((plan, open_files),) = written
    assert open_files > 0 and "Sort" not in plan and "Exchange" not in plan
    assert int(spark.conf.get(OPEN_FILES)) == 0
    with pytest.raises(Exception, match="row outside the target"):
        sinks.write_partitions(table(spark, 7), str(tmp_path / "t"), KEYS, ALL[:2])
    assert int(spark.conf.get(OPEN_FILES)) == 0


def test_open_files_of_the_session_stay_and_the_last_write_takes_them_back(spark):
    spark.conf.set(OPEN_FILES, "3")
    try:
        with sinks.open_side_by_side(spark):
            assert spark.conf.get(OPEN_FILES) == "3"
        assert spark.conf.get(OPEN_FILES) == "3"
    finally:
        spark.conf.unset(OPEN_FILES)
    first, second = sinks.open_side_by_side(spark), sinks.open_side_by_side(spark)
    first.__enter__()
    second.__enter__()
    first.__exit__(None, None, None)
    assert int(spark.conf.get(OPEN_FILES)) > 0
    second.__exit__(None, None, None)
    assert int(spark.conf.get(OPEN_FILES)) == 0


def test_more_partitions_in_a_task_than_open_files(spark, tmp_path):
    target = str(tmp_path / "many")
    cells = [("a", f"m{i:03d}") for i in range(150)]
    mixed = spark.range(0, 600, 1, 1).selectExpr(
        "id", "'a' AS fleet", "format_string('m%03d', id % 150) AS month"
    )
    sinks.write_partitions(mixed, target, KEYS, cells)
    assert stored(spark, target) == {("a", f"m{i:03d}"): (4, i) for i in range(150)}
