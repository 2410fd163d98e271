"""Exact order statistics at every size: values by rank, narrowed down by leading bits.

Every value maps to whole numbers that keep its order (one 64-bit number; three numbers of 13 digits
for decimals of more than 18). A first scan takes counts and the least and greatest number of each
column. Each further scan cuts what is left of a number's range by its next bits, 11 at a time,
counts the values of each part, and goes on with the part that holds the rank. A part is at most a
2048th of the range, so a 64-bit number is settled after six such scans whatever the values are,
and a long decimal, cut by 23 bits at a time, as well: seven scans at most.

A task never holds more than one counter for each part it meets, nothing grows with the number of
tasks, and all columns, groups and ranks share each scan. The driver holds what is open: one row per
group, column and fraction, so groups should be few.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import (
    ByteType,
    DataType,
    DecimalType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    ShortType,
    StructField,
    StructType,
)

#: Bits that one scan settles, of a 64-bit number and of one of three.
BITS, WIDE_BITS = 11, 23
MOST_SCANS = 7

_WHOLE = (ByteType, ShortType, IntegerType, LongType)
_FRACTION_BITS, _EXPONENT_BIAS = 52, 1023
_LEAST_NORMAL = 2.0**-1022
_NAN = (2047 << _FRACTION_BITS) + 1
#: Digits of a long decimal's three numbers.
_DIGITS = (13, 13, 13)


# --- order-keeping numbers ------------------------------------------------------------------------


def _with_double_numbers(df: DataFrame, x: str, out: str) -> DataFrame:
    """The bits of a double as a number that keeps the order: -0.0 is 0.0, NaN is the greatest.

    Exponent and fraction come from exact arithmetic: powers of two are exact, and so is dividing by
    them; a logarithm off by one shows in a quotient outside [1, 2). Each step is a column of its own,
    as one expression it would be evaluated many times over. `out` holds the numbers of rows
    without an x, and is never NULL afterwards: a filter on that would repeat the arithmetic.
    """
    guess = F.least(F.coalesce(F.floor(F.log2("_size")), F.lit(0)), F.lit(_EXPONENT_BIAS))
    df = (
        df.withColumn("_size", F.abs(x))
        .withColumn("_guess", guess)
        .withColumn("_quotient", F.col("_size") / F.pow(F.lit(2.0), F.col("_guess").cast("double")))
    )
    size, quotient, one = F.col("_size"), F.col("_quotient"), float(1 << _FRACTION_BITS)
    # the fraction, and the exponent's correction as whole numbers of `one`
    corrected = (
        F.when(quotient < 1, quotient * (2 * one) - 2 * one)
        .when(quotient >= 2, quotient * (one / 2))
        .otherwise(quotient * one - one)
    )
    number = (
        F.when(F.isnan(x), F.lit(_NAN))
        .when(size == float("inf"), F.lit(2047 << _FRACTION_BITS))
        # below the normal ones the distance is the same everywhere
        .when(size < _LEAST_NORMAL, (size * 2.0**537 * 2.0**537).cast("long"))
        .otherwise((F.col("_guess") + _EXPONENT_BIAS) * F.lit(1 << _FRACTION_BITS) + corrected.cast("long"))
    )
    signed = F.when(F.col(x) < 0, -F.col("_number")).otherwise(F.col("_number"))
    return (
        df.withColumn("_number", number)
        .withColumn(out, F.coalesce(F.when(F.col(x).isNull(), F.col(out)).otherwise(signed), F.lit(0)))
        .drop("_size", "_guess", "_quotient", "_number")
    )


def _number_of_double(x: float) -> int:
    """The same for one value, on the driver."""
    if x != x:
        return _NAN
    number = struct.unpack("<q", struct.pack("<d", abs(x)))[0]
    return -number if x < 0 else number


def _double_of(number: int) -> float:
    if number == _NAN:
        return math.nan
    size = struct.unpack("<d", struct.pack("<q", abs(number)))[0]
    return -size if number < 0 else size


def _of_long_decimal(x: Column, kind: DecimalType) -> list[Column]:
    """The digits of a decimal as three numbers, all below zero for one below zero."""
    whole = kind.precision - kind.scale
    # the picture asks for one digit at least on each side
    picture = "0" * max(1, whole) + ("D" + "0" * kind.scale if kind.scale else "")
    # not of abs(x), which Spark rounds to 34 digits
    text = F.translate(F.to_char(x, F.lit("S" + picture)), "+-. ", "")
    digits = F.lpad(text, sum(_DIGITS), "0")
    sign = F.when(x < 0, -1).otherwise(1)
    starts = [1 + sum(_DIGITS[:k]) for k in range(len(_DIGITS))]
    return [
        F.substring(digits, start, n).cast("long") * sign
        for start, n in zip(starts, _DIGITS, strict=True)
    ]


@dataclass(frozen=True)
class _Kind:
    """How the values of one type are numbered."""

    type: DataType

    @classmethod
    def of(cls, kind: DataType) -> _Kind:
        if not isinstance(kind, (*_WHOLE, FloatType, DoubleType, DecimalType)):
            raise TypeError(f"no numbers for values of type {kind.simpleString()}")
        return cls(kind)

    @property
    def is_double(self) -> bool:
        return isinstance(self.type, FloatType | DoubleType)

    @property
    def is_wide(self) -> bool:
        return isinstance(self.type, DecimalType) and self.type.precision > 18

    @property
    def count(self) -> int:
        return len(_DIGITS) if self.is_wide else 1

    @property
    def bits(self) -> int:
        return WIDE_BITS if self.is_wide else BITS

    def numbers(self, x: Column) -> list[Column]:
        """The numbers of a value that is no double."""
        if isinstance(self.type, _WHOLE):
            return [x.cast("long")]
        if self.is_wide:
            return _of_long_decimal(x, self.type)
        return [(x * F.lit(Decimal(10) ** self.type.scale)).cast("long")]

    def numbers_of(self, value) -> list[int]:
        """The same of one value, on the driver."""
        if isinstance(self.type, _WHOLE):
            return [value]
        if self.is_double:
            return [_number_of_double(value)]
        sign, digits, _ = value.as_tuple()
        whole = int("".join(map(str, digits)))
        if not self.is_wide:
            return [-whole if sign else whole]
        parts = []
        for n in reversed(_DIGITS):
            whole, part = divmod(whole, 10**n)
            parts.insert(0, -part if sign else part)
        return parts

    def value(self, numbers: Sequence[int]):
        if isinstance(self.type, _WHOLE):
            return numbers[0]
        if self.is_double:
            return _double_of(numbers[0])
        digits = numbers[0]
        if self.is_wide:
            # all three have the same sign
            digits = numbers[0] * 10 ** (_DIGITS[1] + _DIGITS[2]) + numbers[1] * 10 ** _DIGITS[2] + numbers[2]
        # from digits: arithmetic would round to the precision of the context
        return Decimal((int(digits < 0), tuple(int(d) for d in str(abs(digits))), -self.type.scale))


# --- selection -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Bounds:
    """What the first scan finds for one group and column."""

    count: int
    least: object
    greatest: object


@dataclass(frozen=True)
class Selected:
    """Per group: bounds by column, values by (column, fraction), and the extra aggregates."""

    bounds: dict[tuple, dict[str, Bounds]]
    values: dict[tuple, dict[tuple[str, float], object]]
    extra: dict[tuple, dict[str, object]]
    scans: int


@dataclass
class _Open:
    """One rank that is still looked for: among `rank` values of a range of the number `at`."""

    group: tuple
    column: str
    fraction: float
    rank: int
    known: list[int]
    low: int
    high: int
    bits: int

    @property
    def shift(self) -> int:
        return max(0, (self.high - self.low).bit_length() - self.bits)


def _rank(fraction: float, count: int) -> int:
    """ceil(fraction * count), at least 1; fractions are decimals, so 0.1 * 30 is 3."""
    return max(1, math.ceil(Decimal(str(fraction)) * count))


def select_ranks(
    df: DataFrame,
    by: Sequence[str],
    wanted: Mapping[str, Sequence[float]],
    extra: Mapping[str, Column] | None = None,
) -> Selected:
    """The values at rank ceil(fraction * n) of the n non-NULL values of each column, per group.

    Types are whole numbers, floats, doubles and decimals; each value comes back exactly, with a
    NaN after all others and -0.0 as 0.0. A group without values of a column has none. `extra` are
    aggregates that the first scan takes along. A NULL group is a group.
    """
    kinds = {c: _Kind.of(df.schema[c].dataType) for c in wanted}
    columns = list(wanted)
    extra = dict(extra or {})

    aggregates = [c.alias(f"x{i}") for i, c in enumerate(extra.values())]
    for i, c in enumerate(columns):
        found = (F.count(c), F.min(c), F.max(c))
        aggregates += [f.alias(f"{name}{i}") for name, f in zip("nab", found, strict=True)]
    found = df.groupBy(*(F.col(c).alias(f"g{i}") for i, c in enumerate(by))).agg(*aggregates).collect()

    result = Selected({}, {}, {}, 0)
    open_: list[_Open] = []

    def narrow(item: _Open, low: Sequence[int], high: Sequence[int]) -> None:
        """Takes over the numbers that the least and the greatest value share; puts aside what is settled."""
        for a, b in zip(low, high, strict=True):
            if a != b:
                item.low, item.high = a, b
                open_.append(item)
                return
            item.known.append(a)
        value = kinds[item.column].value(item.known)
        result.values[item.group][item.column, item.fraction] = value

    for row in found:
        group = tuple(row[f"g{i}"] for i in range(len(by)))
        result.extra[group] = {name: row[f"x{i}"] for i, name in enumerate(extra)}
        result.bounds[group], result.values[group] = {}, {}
        for i, c in enumerate(columns):
            n, least, greatest = row[f"n{i}"], row[f"a{i}"], row[f"b{i}"]
            result.bounds[group][c] = Bounds(n, least, greatest)
            for fraction in wanted[c] if n else ():
                item = _Open(group, c, fraction, _rank(fraction, n), [], 0, 0, kinds[c].bits)
                narrow(item, kinds[c].numbers_of(least), kinds[c].numbers_of(greatest))

    scans = 1
    while open_:
        items, open_ = open_, []
        for item, low, high in _narrowed(df, by, kinds, items):
            narrow(item, low, high)
        scans += 1
    return Selected(result.bounds, result.values, result.extra, scans)


def _local(spark: SparkSession, rows: Sequence[tuple], schema: StructType) -> DataFrame:
    """Rows of the driver as a relation whose size Spark knows, so that it picks the kind of join."""
    arrow = to_arrow_schema(schema)
    columns = zip(*rows, strict=True)
    table = pa.table([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
    return spark.createDataFrame(table, schema)


_ASKED = StructType().add("id", IntegerType()).add("item", IntegerType()).add("rank", LongType())


def _narrowed(df, by, kinds, items):
    """One scan: every open rank, with the least and greatest numbers of the part that holds it."""
    spark = df.sparkSession
    columns = list(kinds)
    # only columns that have an open rank
    needed = sorted({columns.index(t.column) for t in items})
    most = max(kinds[columns[i]].count for i in needed)
    # ranks of one range share its parts
    ranges: dict[tuple, int] = {}
    ranks = []
    for i, t in enumerate(items):
        range_ = (*t.group, columns.index(t.column), len(t.known), t.low, t.high, t.shift)
        range_ += tuple(t.known[k] if k < len(t.known) else None for k in range(most))
        ranks.append((ranges.setdefault(range_, len(ranges)), i, t.rank))
    keys = [f"g{i}" for i in range(len(by))]
    known = [f"k{k}" for k in range(most)]
    schema = StructType([StructField(k, df.schema[c].dataType) for k, c in zip(keys, by, strict=True)])
    for name in ("c", "at", "low", "high", "shift", *known, "id"):
        schema = schema.add(name, IntegerType() if name in ("c", "at", "shift", "id") else LongType())
    targets = _local(spark, [(*r, i) for r, i in ranges.items()], schema)

    def told(i: int) -> Column:
        """Column and numbers of a row; a double goes along as it is, to be numbered by one expression."""
        c = columns[i]
        double = kinds[c].is_double
        own = [F.lit(None).cast("long")] if double else kinds[c].numbers(F.col(c))
        own = own + [F.lit(0).cast("long")] * (most - len(own))
        as_double = (F.col(c) if double else F.lit(None)).cast("double")
        return F.struct(F.lit(i).alias("of"), as_double.alias("x"), *(n.alias(f"v{k}") for k, n in enumerate(own)))

    rows = df.select(
        *(F.col(c).alias(f"d{i}") for i, c in enumerate(by)), F.inline(F.array(*map(told, needed)))
    )
    rows = rows.filter(F.col("v0").isNotNull() | F.col("x").isNotNull())
    if any(kinds[columns[i]].is_double for i in needed):
        rows = _with_double_numbers(rows, "x", "v0")
    same = [F.col(f"d{i}").eqNullSafe(F.col(k)) for i, k in enumerate(keys)]
    same += [F.col("of") == F.col("c")]
    values = [F.col(f"v{k}") for k in range(most)]
    current = values[0] if most == 1 else F.element_at(F.array(*values), F.col("at") + 1)
    settled = [(F.col("at") <= k) | (values[k] == F.col(known[k])) for k in range(most - 1)]
    shifted = lambda x: F.call_function("shiftright", x, F.col("shift"))
    # as structs the three numbers of a long decimal compare like the decimal
    whole = F.struct(*values)
    counted = (
        rows.join(targets, [*same, current.between(F.col("low"), F.col("high")), *settled])
        .groupBy("id", (shifted(current) - shifted(F.col("low"))).alias("part"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(whole).alias("a"), F.max(whole).alias("b"))
        .withColumn("upto", F.sum("n").over(Window.partitionBy("id").orderBy("part")))
    )
    asked = _local(spark, ranks, _ASKED)
    held = counted.join(asked, "id").filter("rank <= upto AND rank > upto - n").collect()
    for row in held:
        item = items[row["item"]]
        item.rank -= row["upto"] - row["n"]
        first, count = len(item.known), kinds[item.column].count
        yield item, list(row["a"])[first:count], list(row["b"])[first:count]
