"""Fingerprints, expectations at mixed grain, witnesses, listings of requested paths."""

import hashlib

from pyspark.sql import functions as F

from ledgerlake import taxi
from ledgerlake.operators import compare, quality
from ledgerlake.sources import landing
from tests.frames import rows


def test_fingerprints_tell_tables_apart(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (2, None, None), (2, None, None), (None, "b", 1.0)], "x int, y string, z double")
    print_ = lambda d, **k: tuple(compare.fingerprint(d, **k).first())
    assert print_(df) == print_(df.repartition(3).orderBy("z").select("z", "y", "x"))
    assert print_(df)[0] == 4
    others = [
        df.limit(3),
        df.unionByName(df.limit(1)),
        df.distinct(),
        df.withColumn("y", F.coalesce("y", F.lit(""))),
        df.withColumn("x", F.coalesce("x", F.lit(0))),
        df.select(F.col("x"), F.col("y"), F.lit(0.5).alias("z")),
    ]
    assert len({print_(d) for d in [df, *others]}) == 7
    assert print_(df, without=["z"]) == print_(others[-1], without=["z"])
    assert print_(df.limit(0)) == (0, 0, 0)


def test_expectations_of_any_grain(spark):
    counts = spark.createDataFrame(
        [("a", "01", 5), ("a", "02", 6), ("b", "01", 7), ("b", None, 2), (None, "01", 1)], "f string, m string, rows long"
    )
    expected = spark.createDataFrame(
        [("a", "01", 5), ("a", "02", 9), ("b", None, 9), (None, None, 20), ("c", None, 4), ("a", "03", 1)],
        "f string, m string, expected long",
    )
    found = rows(compare.volume_at_grains(counts, expected, "f", "m", "total"))
    assert found == sorted(
        [
            ("a", "01", 5, 5, "OK"),
            ("a", "02", 6, 9, "DIVERGE"),
            ("a", "03", 0, 1, "DIVERGE"),
            ("a", "total", 11, None, "UNKNOWN"),
            ("b", "01", 7, None, "UNKNOWN"),
            ("b", None, 2, None, "UNKNOWN"),
            ("b", "total", 9, 9, "OK"),
            ("c", "total", 0, 4, "DIVERGE"),
            (None, "01", 1, None, "UNKNOWN"),
            (None, "total", 1, None, "UNKNOWN"),
            ("total", "total", 21, 20, "DIVERGE"),
        ],
        key=repr,
    )


def test_published_volumes(spark):
    expected = taxi.expected_volumes(spark)
    months = [(f, m, n) for (f, m), n in taxi.EXPECTED_ROWS.items()]
    counts = spark.createDataFrame([*months, ("green", "2023-01", 339_630)], f"{taxi.FLEET} string, {taxi.FILE_MONTH} string, rows long")
    found = compare.volume_at_grains(counts, expected, taxi.FLEET, taxi.FILE_MONTH, "total")
    status = {(r[0], r[1]): r.status for r in found.collect()}
    assert status.pop(("yellow", "total")) == status.pop(("green", "2023-01")) == "UNKNOWN"
    assert set(status.values()) == {"OK"} and len(status) == 7
    short = counts.filter(f"{taxi.FILE_MONTH} <> '2023-05'")
    found = compare.volume_at_grains(short, expected, taxi.FLEET, taxi.FILE_MONTH, "total")
    assert {(r[0], r[1]) for r in found.filter("status = 'DIVERGE'").collect()} == {("yellow", "2023-05"), ("total", "total")}


def test_witnesses_are_those_of_least_hash(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") % 50).alias("v"), F.lit("x").alias("id2"))
    guarantees = {"small": "v >= 48", "always": "false", "once": "id = 77", "known": "v > NULL"}
    found = rows(quality.contract_witnesses(df.repartition(7), guarantees, "id", most=3))
    broken = [k for k in range(500) if k % 50 >= 48]
    least = [min(broken, key=lambda i: hashlib.md5(f"{i}#{k}".encode()).hexdigest()) for k in (1, 2, 3)]
    assert found == sorted(
        [
            *(("small", 20, k, str(w)) for k, w in enumerate(least, 1)),
            *(("once", 1, k, "77") for k in (1, 2, 3)),
            ("always", 0, None, None),
            ("known", 0, None, None),
        ],
        key=repr,
    )
    none = rows(quality.contract_witnesses(df.limit(0), guarantees, "id"))
    assert len(none) == 4 and all(r[1:] == (0, None, None) for r in none)


def test_only_requested_paths_are_listed(spark, tmp_path):
    grid = landing.requested_grid(spark, [("yellow", "2023-01"), ("yellow", "2023-02")])
    manifest = landing.manifest(grid, taxi.LAYOUT, str(tmp_path))
    assert landing.requested_listing(spark, manifest).count() == 0
    for name, month in (("yellow", "2023-01"), ("green", "2023-01")):
        path = tmp_path / name / "2023" / taxi.LAYOUT.file_name(name, month)
        path.parent.mkdir(parents=True)
        path.write_bytes(b"12345")
    found = landing.requested_listing(spark, manifest).collect()
    assert [(r.path.rpartition("/")[2], r.length) for r in found] == [("yellow_tripdata_2023-01.parquet", 5)]
