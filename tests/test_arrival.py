"""Loading what arrives, batch after batch."""

import os
import uuid
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from ledgerlake import taxi
from ledgerlake.plans import arrival, batch, sinks, views
from ledgerlake.spec import Layout
from tests.frames import SEVEN, land, rows

#: Folders of part files, as a source that may be published again needs them.
DATASET = replace(
    taxi.dataset(expected_bytes={}), layout=Layout(taxi.LAYOUT.file, "{root}/fleet={scope}/month={month}")
)


@pytest.fixture
def place(spark, tmp_path):
    warehouse = batch.Warehouse(str(tmp_path / "warehouse"), f"arrival_{uuid.uuid4().hex[:8]}")
    sinks.create_schema(spark, warehouse.schema)
    return warehouse, str(tmp_path / "landing"), str(tmp_path / "state")


def arrive(spark, place, **options):
    warehouse, root, state = place
    taken = []
    query = arrival.load_arrivals(
        spark, DATASET, root, warehouse, state, loaded=lambda n, s: taken.append(s), **options
    )
    query.awaitTermination()
    return taken


def partitions_of(store):
    """Modification times of stored files by the folders of their partition."""
    found = {}
    for folder, _, names in os.walk(store.root):
        for name in (n for n in names if n.endswith(".parquet")):
            way = tuple(p for p in folder.split("/") if "=" in p)
            found.setdefault(way, set()).add((name, os.path.getmtime(os.path.join(folder, name))))
    return found


def test_only_sources_of_new_files_are_loaded(spark, place):
    warehouse, root, _ = place
    first = land(spark, root, DATASET, SEVEN[:5])
    assert arrive(spark, place) == [first]
    assert warehouse.conformed(DATASET).read(spark).count() == 5
    before = partitions_of(warehouse.checked(DATASET))
    assert arrive(spark, place) == []
    # green arrives, and the May source of yellow comes again with another row
    land(spark, root, DATASET, SEVEN[5:])
    assert arrive(spark, place) == [[("green", "2023-05"), ("yellow", "2023-05")]]
    after = partitions_of(warehouse.checked(DATASET))
    changed = {way for way in {*before, *after} if before.get(way) != after.get(way)}
    assert {w[:2] for w in changed} == {
        ("taxi_type=green", "source_year_month=2023-05"),
        ("taxi_type=yellow", "source_year_month=2023-05"),
    }
    metrics = warehouse.metrics(DATASET).read(spark)
    assert rows(metrics.filter("metrica = 'linhas_bronze'").select("taxi_type", "valor")) == [
        ("green", 1),
        ("total", 6),
        ("yellow", 5),
    ]
    batch.audit(spark, DATASET, warehouse)


def test_batches_of_few_files_and_files_of_no_source(spark, place):
    warehouse, root, _ = place
    given = land(spark, root, DATASET, SEVEN)
    spark.range(3).write.parquet(f"{root}/other/month=2023-01")
    taken = arrive(spark, place, files_per_batch=2)
    assert len(taken) == (len(given) + spark.read.parquet(f"{root}/other").inputFiles().__len__() + 1) // 2
    assert sorted({s for part in taken for s in part}) == given
    assert warehouse.conformed(DATASET).read(spark).count() == 7
    batch.audit(spark, DATASET, warehouse)


def test_a_batch_that_fails_is_taken_again(spark, place, monkeypatch):
    warehouse, root, _ = place
    land(spark, root, DATASET, SEVEN)
    publish = batch.stores.Store.publish
    seen = []

    def broken(self, *given):
        seen.append(self.name)
        if len(seen) == 2:
            raise RuntimeError("lost between two tables")
        return publish(self, *given)

    monkeypatch.setattr(batch.stores.Store, "publish", broken)
    with pytest.raises(Exception, match="lost between two tables"):
        arrive(spark, place)
    monkeypatch.undo()
    assert len(arrive(spark, place)) == 1
    batch.audit(spark, DATASET, warehouse)
    batch.publish_views(spark, DATASET, warehouse)
    assert spark.table(warehouse.name(views.TRIPS)).agg(F.count("*")).first()[0] == 2
