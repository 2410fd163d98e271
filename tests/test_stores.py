"""Tables that are replaced in parts: what readers see before, between and after the steps."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from ledgerlake.plans import sinks, stores
from tests.frames import rows
from tests.test_sinks import ALL, KEYS, ODD, OPEN_FILES, table, written  # noqa: F401

DDL = "id long, fleet string, month string"


@pytest.fixture
def store(spark, tmp_path):
    made = stores.Store(f"default.s_{uuid.uuid4().hex[:10]}", str(tmp_path / "t"), DDL, KEYS)
    made.replace(spark, table(spark, 0), ALL)
    yield made
    spark.sql(f"DROP TABLE IF EXISTS {made.name}")


def seen(spark, store):
    found = store.read(spark).groupBy(*KEYS).agg(F.count("*").alias("n"), F.min("id").alias("low"))
    return {(r.fleet, r.month): (r.n, r.low) for r in found.collect()}


BEFORE = {("a", "2023-01"): (3, 0), ("a", "2023-02"): (3, 0), ("b", "2023-01"): (3, 0)}


def data_files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_only_targets_change_and_their_old_files_go(spark, store):
    before = data_files(store.root)
    targets = [("a", "2023-02"), ("c", "2023-01")]
    store.replace(spark, table(spark, 100, targets, n=2), targets)
    assert seen(spark, store) == BEFORE | {t: (2, 100) for t in targets}
    after = data_files(store.root)
    assert {f for f in before if "month=2023-02" not in f} <= after
    assert not {f for f in before if "month=2023-02" in f} & after
    assert store.leftovers(spark) == []


def test_targets_without_rows(spark, store):
    store.replace(spark, table(spark, 7, [("a", "2023-01")]), ALL[:2])
    assert seen(spark, store) == {("a", "2023-01"): (3, 7), ("b", "2023-01"): (3, 0)}
    with pytest.raises(sinks.EmptyTargetError, match="2023-01"):
        store.replace(spark, table(spark, 9, []), [("b", "2023-01")], when_empty="raise")
    store.replace(spark, table(spark, 9, []), [("b",)])
    assert seen(spark, store) == {("a", "2023-01"): (3, 7)}
    assert store.leftovers(spark) == []


def test_no_targets_change_nothing(spark, store):
    store.replace(spark, table(spark, 7), [])
    assert seen(spark, store) == BEFORE
    sinks.write_partitions(table(spark, 7), store.root, KEYS, [])
    assert seen(spark, store) == BEFORE


def test_rows_outside_the_targets_leave_all_as_it_was(spark, store):
    with pytest.raises(Exception, match="row outside the target partitions: b/2023-01"):
        store.replace(spark, table(spark, 7), ALL[:2])
    assert seen(spark, store) == BEFORE and store.leftovers(spark) == []


def test_a_run_that_breaks_off_before_publishing(spark, store):
    staged = store.stage(spark, table(spark, 50, ALL[:2], n=9), ALL[:2])
    assert rows(staged.read(spark).groupBy("fleet").count()) == [("a", 18)]
    assert seen(spark, store) == BEFORE
    assert [f.rpartition("/")[2] for f in store.leftovers(spark)] == [staged.folder.rpartition("/")[2]]
    # a new run is not disturbed by what the broken one left
    store.replace(spark, table(spark, 60, ALL[:1]), ALL[:1])
    assert seen(spark, store) == BEFORE | {ALL[0]: (3, 60)}
    staged.discard(spark)
    assert store.leftovers(spark) == []


def test_a_run_that_breaks_off_before_deleting(spark, store, monkeypatch):
    def broken(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(stores.Store, "_remove", broken)
    new = [("a", "2023-01"), ("b", "2023-01")]
    with pytest.raises(RuntimeError, match="lost"):
        store.replace(spark, table(spark, 70, new, n=1), new)
    assert seen(spark, store) == BEFORE | {t: (1, 70) for t in new}
    monkeypatch.undo()
    store.replace(spark, table(spark, 80, ALL), ALL)
    assert seen(spark, store) == {t: (3, 80) for t in ALL}
    # the first version's folder holds what was not deleted
    for folder in store.leftovers(spark):
        sinks.delete(spark, folder)
    assert seen(spark, store) == {t: (3, 80) for t in ALL}


def test_odd_values_of_partitions(spark, tmp_path):
    odd = stores.Store(f"default.o_{uuid.uuid4().hex[:10]}", str(tmp_path / "odd"), DDL, KEYS)
    cells = [(v, m) for v in [*ODD, "it's", "back\\slash"] for m in ("m1", "m2")]
    odd.replace(spark, table(spark, 0, cells), cells)
    assert seen(spark, odd) == {c: (3, 0) for c in cells}
    half = [c for c in cells if c[1] == "m1"]
    odd.replace(spark, table(spark, 9, half, n=1), cells)
    assert seen(spark, odd) == {c: (1, 9) for c in half}
    spark.sql(f"DROP TABLE {odd.name}")


def test_columns_may_be_added_and_grow_wider(spark, store):
    wider = stores.Store(store.name, store.root, "id long, note string, fleet string, month string", KEYS)
    new = table(spark, 5, ALL[:1]).withColumn("note", F.lit("x"))
    wider.replace(spark, new, ALL[:1])
    found = rows(wider.read(spark).select("fleet", "month", "note").distinct())
    assert found == [("a", "2023-01", "x"), ("a", "2023-02", None), ("b", "2023-01", None)]
    front = stores.Store(store.name, store.root, "kind int, id long, note string, fleet string, month string", KEYS)
    front.replace(spark, new.withColumn("kind", F.lit(1)), ALL[:1])
    assert front.read(spark).columns == ["kind", "id", "note", "fleet", "month"]
    assert rows(front.read(spark).groupBy("kind").count()) == [(1, 3), (None, 6)]
    widest = stores.Store(store.name, store.root, "kind long, id long, note string, fleet string, month string", KEYS)
    widest.replace(spark, new.withColumn("kind", F.lit(2).cast("long")), ALL[:2])
    assert dict(widest.read(spark).dtypes)["kind"] == "bigint"
    assert rows(widest.read(spark).groupBy("kind").count()) == [(2, 3), (None, 3)]


def test_other_changes_need_a_full_rewrite(spark, store):
    text = stores.Store(store.name, store.root, "id string, fleet string, month string", KEYS)
    as_text = table(spark, 5).withColumn("id", F.col("id").cast("string"))
    with pytest.raises(stores.SchemaChangeError, match="id changed.*'b', '2023-01'"):
        text.replace(spark, as_text.where("fleet = 'a'"), [("a",)])
    assert seen(spark, store) == BEFORE
    text.replace(spark, as_text, [("a",), ("b",)])
    assert dict(text.read(spark).dtypes)["id"] == "string" and text.read(spark).count() == 9
    fewer = stores.Store(store.name, store.root, "fleet string, month string", KEYS)
    with pytest.raises(stores.SchemaChangeError, match="id"):
        fewer.replace(spark, as_text.where("fleet = 'a'"), [("a",)])


def test_a_whole_table_is_swapped_and_takes_a_new_schema(spark, tmp_path):
    name, root = f"default.w_{uuid.uuid4().hex[:10]}", str(tmp_path / "w")
    whole = stores.Store(name, root, "id long")
    whole.replace(spark, spark.range(3))
    staged = whole.stage(spark, spark.range(5))
    assert whole.read(spark).count() == 3 and staged.read(spark).count() == 5
    whole.publish(spark, staged)
    assert whole.read(spark).count() == 5 and whole.leftovers(spark) == []
    other = stores.Store(name, root, "id string, x int")
    other.replace(spark, spark.createDataFrame([("a", 1)], "id string, x int"))
    assert rows(other.read(spark)) == [("a", 1)] and len({os.path.dirname(f) for f in data_files(root)}) == 1
    spark.sql(f"DROP TABLE {name}")


def test_a_table_elsewhere_is_refused(spark, store):
    other = stores.Store(store.name, store.root + "x", DDL, KEYS)
    with pytest.raises(ValueError, match="already lies in"):
        other.replace(spark, table(spark, 0), ALL)


def test_a_store_is_staged_without_a_sort(spark, store, written):  # noqa: F811
    store.replace(spark, table(spark, 100, ALL[:2]), ALL[:2])
    ((plan, open_files),) = written
    assert open_files > 0 and "Sort" not in plan and "Exchange" not in plan
    assert int(spark.conf.get(OPEN_FILES)) == 0
    assert seen(spark, store) == BEFORE | {t: (3, 100) for t in ALL[:2]}
