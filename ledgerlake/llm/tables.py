"""Reading tables and cutting lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of rows that a task hands to Python at a time. A batch is held several times over by each running
#: task: in the executor's buffers, in its worker's, and in the arrays worked out from it.
BATCH_BYTES = 1 << 20

_made: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_small_batches(spark: SparkSession) -> None:
    """From now on the session's tasks hand rows to Python in batches of about BATCH_BYTES.

    Spark's own bounds are 10,000 rows and 64 MB; a longer row is a batch of its own.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors reach, as the cluster names it in spark.checkpoint.dir.

    Only a session on a local master that leaves it unset, such as a test, gets a temporary one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
    if not _made:
        _made.append(tempfile.mkdtemp(prefix="ledgerlake-llm-"))
    return _made[0]


def cut(df: DataFrame) -> DataFrame:
    """Stores the rows in the shared checkpoint folder, so that lost executors cost no recomputation."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows written once as Parquet into the shared folder, and read again.

    Unlike a checkpoint this computes them once only, and later steps read just the columns they need.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._stored_path = path
    return found


def discard(df: DataFrame) -> None:
    """Deletes rows that `stored` has written, once nothing is left to be read from them."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
