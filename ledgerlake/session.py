"""Session helpers: settings for tests and runs, and the shared folder for written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_CHECKPOINT_DIR = "spark.checkpoint.dir"
_made: list[str] = []

# Settings for large inputs, to be given to the cluster's session.
CLUSTER_SETTINGS = {
    # Classifying reads 5 of 22 stored columns, so a split can be large on disk; each split
    # writes one clean and one rejected file, and larger splits mean fewer small rejected files.
    "spark.sql.files.maxPartitionBytes": "1g",
    # A split rarely holds more than a few partitions: open their writers side by side rather
    # than sort the split by partition. Beyond this number Spark falls back to sorting.
    "spark.sql.maxConcurrentOutputFileWriters": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
}


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "ledgerlake"):
    """Session for tests and benches on one machine. Clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only where that is unset on a local master is a temporary folder used.
    """
    named = spark.conf.get(_CHECKPOINT_DIR, None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError(f"set {_CHECKPOINT_DIR} to a folder all executors can reach")
    # a static setting can't be changed in a running session, so the folder is remembered here
    if not _made:
        _made.append(tempfile.mkdtemp(prefix="ledgerlake-"))
    return _made[0]


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/ledgerlake/{label}-{uuid.uuid4().hex}"
