"""The pipeline stage by stage, and the registration of what may be taken out."""

import os
import random
import subprocess
import sys
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlake.llm import decontamination, ngram_join, pieces, quality, queries, secrets
from ledgerlake.llm.tables import BATCH_BYTES, table
from tests.llm.frames import documents, prose
from tests.oracle import connect, differences

SF = "/root/testdata/sf0.001"
REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_stages_take_effect(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns, seen = docs.dtypes, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.dtypes == columns
        seen.append((before, docs))
    ids = lambda df: {r[0] for r in df.select("doc_id").collect()}
    judged = quality.score(seen[0][0], table(spark, SF, "labels"))
    assert ids(seen[0][1]) == ids(judged.where("predicted = 1"))
    groups = ngram_join.jaccard_components(seen[1][0], 5, 80)
    assert ids(seen[1][1]) == ids(groups.where("doc_id = component_id"))
    leaked = decontamination.passages(seen[2][0], table(spark, SF, "benchmark"))
    assert ids(seen[2][1]) == ids(seen[2][0]) - ids(leaked)
    assert ids(seen[3][1]) == ids(seen[3][0])
    left = secrets.scan(seen[3][1]).agg(F.sum(F.col("n_access") + F.col("n_hex"))).first()[0]
    assert left == 0
    assert ids(seen[4][1]) == ids(seen[4][0]) and not seen[4][1].where("NOT round_trip").count()
    run = corpus_pipeline.run(spark, SF)
    assert ids(run) == ids(docs)


def test_stages_of_nothing(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


@pytest.mark.parametrize(
    "operator",
    [
        lambda spark, docs: quality.accepted(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int")),
        lambda spark, docs: ngram_join.one_of_each(docs),
        lambda spark, docs: decontamination.clean(docs, spark.createDataFrame([(1, "a b")], "item_id long, text string")),
        lambda spark, docs: pieces.encoded(docs),
    ],
)
def test_tasks_hand_small_batches_to_python(spark, operator):
    rng = random.Random(3)
    docs = documents(spark, [(k, prose(rng, 10)) for k in range(20)])
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
    assert operator(spark, docs).count() <= 20

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    # 4 MB in one partition
    long = spark.range(0, 2000, 1, 1).select(F.expr("rpad(cast(id as string), 2000, 'x')").alias("text"))
    rows = [r["n"] for r in long.mapInArrow(sizes, "n long").collect()]
    assert sum(rows) == 2000 and max(rows) * 2000 <= BATCH_BYTES


def test_word_vectors_of_a_batch_are_held_by_blocks():
    rng = random.Random(4)
    texts = pa.array([prose(rng, 300) for _ in range(BATCH_BYTES // 1500)])
    vectors = np.random.default_rng(0).normal(size=(quality.SLOTS, quality.DIMS)).astype(np.float32)
    pooled = quality._pooled(texts.slice(0, 5), vectors)  # tables that stay are made now
    tracemalloc.start()
    whole = quality._pooled(texts, vectors)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (whole[:5] == pooled).all() and peak < 24 << 20


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_registered_queries_agree_with_sql(spark, name):
    found = queries.QUERIES[name](spark, "/root/testdata/sf0.01")
    assert not differences(found, connect("/root/testdata/sf0.01"), queries.ORACLES[name])


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert [k for n in range(1, 14) for k in names if k.startswith(f"op{n}_")] == list(queries.QUERIES)
    assert names["pipeline"] is corpus_pipeline.run


def test_the_rest_imports_without_this_folder():
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('ledgerlake.llm'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "print(sum(k.startswith('op') or k == 'pipeline' for k in e.queries()), len(e.oracle_sql()) > 50)\n"
    )
    out = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True)
    assert out.stdout.split() == ["0", "True"], out.stderr
