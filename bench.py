"""Times the registered queries and a full run: prints one JSON line.

BENCH_SF_DIR is the data folder, BENCH_CPUS the number of local threads.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerlake.plans import batch  # noqa: E402
from ledgerlake.session import fresh_dir, local_session  # noqa: E402
from ledgerlake.suite import QUERIES, fixtures  # noqa: E402


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def execute(spark, sf_dir: str, name: str) -> None:
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()


def full_run(spark, sf_dir: str) -> None:
    """Landed files to published answers in a new warehouse."""
    root = fresh_dir(spark, "bench")
    result = batch.run(
        spark,
        fixtures.landed_dataset(spark, sf_dir),
        fixtures.landing_root(spark, sf_dir),
        batch.Warehouse(root, f"bench_{root[-12:]}"),
        fixtures.landed_partitions(spark, sf_dir),
        fixtures.HOUR_MONTH,
    )
    for answer in result.values():
        answer.collect()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    # landing folder and tables that some queries read: entries of their own
    seconds = {
        "landing": round(timed(lambda: fixtures.landing_root(spark, sf_dir)), 3),
        "stored_tables": round(timed(lambda: fixtures.stored(spark, sf_dir)), 3),
        "full_run": round(timed(lambda: full_run(spark, sf_dir)), 3),
    }
    for name in QUERIES:
        execute(spark, sf_dir, name)  # warm-up
        seconds[name] = round(timed(lambda n=name: execute(spark, sf_dir, n)), 3)
    print(
        json.dumps(
            {
                "metric": "full run and all registered queries, seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
