"""Every registered query against its SQL in DuckDB, and the shape of its plan."""

import pytest

import __spark_entry__ as contract
from ledgerlake.suite import ORACLES, QUERIES
from tests.oracle import connect, differences

SF_DIR = "/root/testdata/sf0.001"

# Full scans of the inputs per query, where it is more than one: a second computation or an
# independent count is the point of these, or the sources have several schemas.
SEVERAL_SCANS = {
    "landing_inventory": 2,
    "landing_missing": 2,
    "landing_integrity": 3,
    # two of these are listings of files and their sizes, the rest the trips' months
    "landed_refresh": 4,
    "landed_summary": 5,
    "landed_integrity": 6,
    "volume_mixed_grain": 2,
    "conform_rename": 3,
    "conform_fill": 3,
    "conform_cast": 3,
    "conform_lineage": 3,
    "conform_union": 3,
    "dq_reconcile": 2,
    "dq_yield": 2,
    "dq_partition_check": 3,
    "dq_partition_rollup": 3,
    "dq_reason_check": 2,
    "parity_month": 2,
    "parity_hour": 2,
    "benchmark_deviation": 2,
    "volume_vs_expected": 2,
}


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
    assert QUERIES.items() <= contract.queries().items()
    assert ORACLES.items() <= contract.oracle_sql().items()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, connection, name):
    df = QUERIES[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for avoided in ("CartesianProduct", "NestedLoopJoin", "Python", "Window"):
        assert avoided not in plan
    assert plan.count("FileScan") <= SEVERAL_SCANS.get(name, 1)
    assert differences(df, connection, ORACLES[name]) == []


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["pickup_year_month", "media_total_amount", "qtd_corridas"]
    assert df.count() == 36
