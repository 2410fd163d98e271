"""Values by rank, on data that is hard to cut into equal parts."""

import math
import random
import struct
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import explore, selection

FRACTIONS = (0.0, 0.01, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0)


def at_rank(values, fraction):
    """The value at the rank, NaN last."""
    ordered = sorted(values, key=lambda v: (v != v, v if v == v else 0))
    return ordered[max(1, math.ceil(Decimal(str(fraction)) * len(ordered))) - 1]


def check(spark, values, kind):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}").repartition(4)
    found = selection.select_ranks(df, [], {"v": FRACTIONS})
    assert found.scans <= selection.MOST_SCANS
    known = [v for v in values if v is not None]
    for f in FRACTIONS:
        got, want = found.values[()]["v", f], at_rank(known, f)
        assert got == want or (got != got and want != want), (f, got, want)
    bounds = found.bounds[()]["v"]
    assert bounds.count == len(known)
    assert (bounds.least, str(bounds.greatest)) == (at_rank(known, 0.0), str(at_rank(known, 1.0)))
    return found


def some_doubles(n, seed):
    rng = random.Random(seed)
    return [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0] for _ in range(n)]


@pytest.mark.parametrize(
    "values",
    [
        [10.0**k for k in range(-300, 301)] + [-(10.0**k) for k in range(-300, 301, 7)],
        [-1.7e308, 1.7e308, *[float(k) for k in range(50)]],
        [5e-324 * k for k in range(40)] + [2.0**-1022, -5e-324, 0.0, -0.0, 1.7976931348623157e308],
        [1.0 + k * 2.0**-52 for k in range(3000)],
        [float(2**k) for k in range(1000)] + [math.nextafter(2.0**k, 0) for k in range(1000)],
        [math.inf, -math.inf, math.nan, math.nan, 1.0, 2.0, None],
        some_doubles(5000, 1),
    ],
    ids=["magnitudes", "extremes", "subnormal", "neighbours", "powers", "not finite", "any bits"],
)
def test_doubles(spark, values):
    check(spark, values, "double")


def test_longs_and_smaller_ones(spark):
    rng = random.Random(2)
    edge = [2**53, 2**53 + 1, 2**53 + 2, -(2**63), 2**63 - 1]
    check(spark, edge, "long")
    check(spark, [rng.randrange(-(2**63), 2**63) for _ in range(4000)], "long")
    check(spark, [2**62 + k for k in range(500)] + [-(2**62) - k for k in range(700)], "long")
    check(spark, [k % 7 for k in range(100)], "int")
    check(spark, [struct.unpack("<f", struct.pack("<f", x))[0] for x in (0.1, 2.5, -7e-40, 3e38)], "float")


@pytest.mark.parametrize(
    "precision, scale", [(18, 4), (9, 9), (38, 0), (38, 10), (38, 38), (30, 2), (19, 1)]
)
def test_decimals(spark, precision, scale):
    rng = random.Random(precision * 40 + scale)
    top = 10**precision - 1
    digits = [rng.randrange(-top, top + 1) for _ in range(800)]
    digits += [top, -top, 0, 1, -1] + [top - k for k in range(60)] + [rng.randrange(10**6) for _ in range(99)]
    values = [Decimal((int(d < 0), tuple(map(int, str(abs(d)))), -scale)) for d in digits]
    check(spark, values, f"decimal({precision},{scale})")


def test_groups_columns_and_extra_aggregates_share_the_scans(spark):
    rng = random.Random(3)
    data = [
        (rng.choice(["a", "b", None]), rng.gauss(0, 1e6), rng.randrange(2**60), Decimal(rng.randrange(10**25)))
        for _ in range(3000)
    ]
    df = spark.createDataFrame(data, "f string, x double, y long, z decimal(30,0)")
    wanted = {"x": (0.5, 0.99), "y": (0.25,), "z": (0.1, 0.7)}
    found = selection.select_ranks(df, ["f"], wanted, {"rows": F.count(F.lit(1))})
    assert found.scans <= selection.MOST_SCANS
    for g in ("a", "b", None):
        own = [r for r in data if r[0] == g]
        assert found.extra[(g,)] == {"rows": len(own)}
        for k, (column, fractions) in enumerate(wanted.items(), 1):
            for f in fractions:
                assert found.values[(g,)][column, f] == at_rank([r[k] for r in own], f)


def test_few_scans_for_common_values(spark):
    df = spark.range(100_000).select((F.col("id") % 1009 / 7.0).alias("v"))
    assert selection.select_ranks(df, [], {"v": (0.5,)}).scans <= 3


def test_summaries_keep_what_a_double_cannot_hold(spark):
    big = 2**53 + 1
    df = spark.createDataFrame([(big, Decimal("12345678901234567.89"), 3)], "a long, b decimal(19,2), c int")
    found = {r[0]: tuple(r)[1:] for r in explore.numeric_summary(df, ["a", "b", "c"]).collect()}
    assert found["50%"] == (big, Decimal("12345678901234567.89"), 3.0)
    assert found["count"] == (1, Decimal(1), 1.0)
    none = {r[0]: tuple(r)[1:] for r in explore.numeric_summary(df.limit(0), ["a", "b", "c"]).collect()}
    assert none["count"] == (0, Decimal(0), 0.0) and none["25%"] == none["max"] == (None, None, None)


def test_unknown_types_are_refused(spark):
    with pytest.raises(TypeError, match="string"):
        selection.select_ranks(spark.createDataFrame([("x",)], "v string"), [], {"v": (0.5,)})
