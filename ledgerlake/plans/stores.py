"""Catalog tables that a run replaces in parts, without a moment at which they can't be read.

Every run writes into a new folder of its own below the table's root. Nothing refers to it until it is
published, by pointing the table's partitions (or the table, if it has none) at it, one catalog entry
at a time; only then are the replaced folders deleted. A run that breaks off before publishing
leaves the table as it was, one that breaks off later leaves the new rows; what nothing refers to any
more is found by ``leftovers``. The catalog therefore tells which files count, not the folders.

What a write costs follows from the partitions it names: only their entries are looked up.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import (
    ByteType,
    DataType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    ShortType,
    StructType,
)

from ledgerlake.plans import sinks

_THREADS = 16
#: Stored types that Parquet readers give as a wider declared one.
_WIDENS = {
    ByteType: (ShortType, IntegerType, LongType),
    ShortType: (IntegerType, LongType),
    IntegerType: (LongType, DoubleType),
    FloatType: (DoubleType,),
}
#: How folders and the catalog spell a NULL partition value.
_NULL = "__HIVE_DEFAULT_PARTITION__"

Values = tuple[str, ...]


class SchemaChangeError(ValueError):
    """Stored files that can't be read with the declared schema."""


def _widens(stored: DataType, declared: DataType) -> bool:
    return stored == declared or isinstance(declared, _WIDENS.get(type(stored), ()))


@dataclass(frozen=True)
class Staged:
    """Rows of one run in a folder of their own, to be published or discarded."""

    store: Store
    folder: str
    targets: tuple[sinks.Target, ...]
    #: Partition values of each leaf folder that got rows.
    leaves: Mapping[Values, str]

    def read(self, spark: SparkSession) -> DataFrame:
        """What was written, as the table will show it."""
        schema = self.store.schema
        if not self.leaves:
            return spark.createDataFrame([], schema)
        reader = spark.read.schema(schema).option("basePath", self.folder)
        return reader.parquet(self.folder).select(*schema.names)

    def discard(self, spark: SparkSession) -> None:
        sinks.delete(spark, self.folder)


@dataclass(frozen=True)
class Store:
    """A Parquet table in the catalog, with its declared columns; partition columns come last."""

    name: str
    root: str
    ddl: str
    partition_cols: tuple[str, ...] = ()

    @property
    def schema(self) -> StructType:
        declared = StructType.fromDDL(self.ddl)
        last = [declared[c] for c in self.partition_cols]
        return StructType([f for f in declared if f.name not in self.partition_cols] + last)

    # --- the table itself ---------------------------------------------------------------------

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.name)

    def exists(self, spark: SparkSession) -> bool:
        return spark.catalog.tableExists(self.name)

    def open(self, spark: SparkSession, replaced: Sequence[sinks.Target] | None = None) -> None:
        """Makes the table, or brings a stored one to the declared columns.

        New columns are NULL in stored rows, and types may grow wider. A column that goes or changes
        otherwise can't be had from the stored files: that is allowed only where every stored partition
        lies in the partitions to be ``replaced`` (None: the whole table), else it raises.
        """
        if not self.exists(spark):
            self._create(spark, {})
            return
        where = spark.sql(f"DESCRIBE TABLE EXTENDED {self.name}").filter("col_name = 'Location'").first()
        if self.partition_cols and sinks.without_scheme(where["data_type"]) != sinks.without_scheme(self.root):
            raise ValueError(f"table {self.name} already lies in {where['data_type']}, not in {self.root}")
        stored, declared = spark.table(self.name).schema, self.schema
        if [(f.name, f.dataType) for f in stored] == [(f.name, f.dataType) for f in declared]:
            return
        have = {f.name: f.dataType for f in stored}
        gone = sorted(set(have) - set(declared.names))
        added = [f for f in declared if f.name not in have]
        retyped = [f.name for f in declared if f.name in have and f.dataType != have[f.name]]
        unreadable = gone + [c for c in retyped if not _widens(have[c], declared[c].dataType)]
        moved = [c for c in self.partition_cols if c in [*gone, *retyped, *(f.name for f in added)]]
        kept = self._locations(spark, [()]) if self.partition_cols else {}
        if moved:
            unreadable = [*unreadable, *moved]
        if unreadable:
            outside = [v for v in kept if replaced is not None and not _named(v, replaced)]
            if outside:
                raise SchemaChangeError(
                    f"{self.name}: columns {', '.join(unreadable)} changed, but stored partitions "
                    f"{sorted(outside)[:5]} are not replaced"
                )
            kept = {}
        if not self.partition_cols:
            return  # replaced as a whole when it is published
        stored_order = [c for c in stored.names if c in declared.names]
        if not unreadable and not retyped and [*stored_order, *(f.name for f in added)] == _data_first(
            declared.names, [f.name for f in added], self.partition_cols
        ):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in added)
            spark.sql(f"ALTER TABLE {self.name} ADD COLUMNS ({columns})")
            return
        spark.sql(f"DROP TABLE {self.name}")  # files of such a table stay
        self._create(spark, kept)

    def _create(self, spark: SparkSession, partitions: Mapping[Values, str], folder: str = "") -> None:
        by = f"PARTITIONED BY ({', '.join(self.partition_cols)})" if self.partition_cols else ""
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)
        spark.sql(f"CREATE TABLE {self.name} ({columns}) USING parquet {by} LOCATION '{folder or self.root}'")
        self._add(spark, partitions)

    # --- partitions ---------------------------------------------------------------------------------

    def _spec(self, values: Sequence[str]) -> str:
        pairs = zip(self.partition_cols, values, strict=False)
        return "PARTITION (" + ", ".join(f"`{c}` = '{sinks.quoted(v)}'" for c, v in pairs) + ")"

    def _add(self, spark: SparkSession, partitions: Mapping[Values, str]) -> None:
        if partitions:
            added = " ".join(f"{self._spec(v)} LOCATION '{sinks.quoted(p)}'" for v, p in partitions.items())
            spark.sql(f"ALTER TABLE {self.name} ADD IF NOT EXISTS {added}")

    def _locations(self, spark: SparkSession, targets: Sequence[sinks.Target]) -> dict[Values, str]:
        """Folders of the partitions below the targets, as the catalog has them."""
        unescape = sinks.unescaped(spark)

        def listed(target: sinks.Target) -> list[Values]:
            spec = self._spec([_NULL if v is None else v for v in target]) if target else ""
            found = spark.sql(f"SHOW PARTITIONS {self.name} {spec}").collect()
            return [tuple(unescape(p.partition("=")[2]) for p in r[0].split("/")) for r in found]

        def located(values: Values) -> tuple[Values, str]:
            told = spark.sql(f"DESCRIBE TABLE EXTENDED {self.name} {self._spec(values)}")
            return values, told.filter("col_name = 'Location'").first()["data_type"]

        with ThreadPoolExecutor(_THREADS) as pool:
            values = {v for found in pool.map(listed, targets) for v in found}
            return dict(pool.map(located, sorted(values)))

    # --- writing ------------------------------------------------------------------------------------

    def stage(
        self,
        spark: SparkSession,
        df: DataFrame,
        targets: Sequence[sinks.Target] = (),
        rebalance: bool = False,
    ) -> Staged:
        """Writes the rows into a new folder. A row outside the targets makes this fail.

        ``targets`` hold values of the leading partition columns; a table without partition columns is
        written as a whole. Rows are written where they are read, unsorted; ``rebalance`` adds a shuffle for
        inputs whose rows are not grouped by partition, and splits partitions that are too large.
        """
        folder = f"{self.root.rstrip('/')}/v-{uuid.uuid4().hex}"
        rows = df.select(*self.schema.names)
        if self.partition_cols:
            if not targets:
                return Staged(self, folder, (), {})
            rows = sinks.only_targets(rows, self.partition_cols[: len(targets[0])], targets)
        if rebalance:
            rows = rows.hint("rebalance", *self.partition_cols)
        # only leaves, so that a folder without them is an empty one
        writer = rows.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
        try:
            with sinks.open_side_by_side(spark):
                writer.partitionBy(*self.partition_cols).parquet(folder)
        except Exception:
            sinks.delete(spark, folder)
            raise
        unescape = sinks.unescaped(spark)
        leaves = sinks.leaf_folders(spark, folder, len(self.partition_cols))
        named = {tuple(unescape(p.partition("=")[2]) for p in leaf): path for leaf, path in leaves.items()}
        return Staged(self, folder, tuple(targets), named)

    def publish(self, spark: SparkSession, staged: Staged, when_empty: str = "delete") -> None:
        """Points the table at the staged rows, then deletes what they replace.

        A target that got no rows loses its old ones (or raises before anything is changed, with
        ``when_empty="raise"``).
        """
        if not self.partition_cols:
            old = self._point_table(spark, staged.folder)
        else:
            empty = [t for t in staged.targets if not any(_named(v, [t]) for v in staged.leaves)]
            if empty and when_empty == "raise":
                staged.discard(spark)
                raise sinks.EmptyTargetError("no rows for: " + ", ".join(map(str, empty)))
            old = self._point_partitions(spark, staged)
            if not staged.leaves:
                old.append(staged.folder)
        spark.catalog.refreshTable(self.name)
        self._remove(spark, old)

    def _point_partitions(self, spark: SparkSession, staged: Staged) -> list[str]:
        if not staged.targets:
            return []
        before = self._locations(spark, staged.targets)
        for values, folder in staged.leaves.items():
            if values in before:
                spark.sql(
                    f"ALTER TABLE {self.name} {self._spec(values)} SET LOCATION '{sinks.quoted(folder)}'"
                )
        self._add(spark, {v: p for v, p in staged.leaves.items() if v not in before})
        for values in before:
            if values not in staged.leaves:
                spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS {self._spec(values)}")
        return list(before.values())

    def _point_table(self, spark: SparkSession, folder: str) -> list[str]:
        told = spark.sql(f"DESCRIBE TABLE EXTENDED {self.name}").filter("col_name = 'Location'").first()
        old = told["data_type"]
        if spark.table(self.name).schema == self.schema:
            spark.sql(f"ALTER TABLE {self.name} SET LOCATION '{sinks.quoted(folder)}'")
        else:
            spark.sql(f"DROP TABLE {self.name}")
            self._create(spark, {}, folder)
        same = sinks.without_scheme(old) == sinks.without_scheme(self.root)
        return [] if same else [old]

    def _remove(self, spark: SparkSession, folders: Sequence[str]) -> None:
        for folder in folders:
            sinks.delete(spark, folder)
            sinks.delete_if_empty(spark, folder.rpartition("/")[0], self.root)

    def replace(
        self,
        spark: SparkSession,
        df: DataFrame,
        targets: Sequence[sinks.Target] = (),
        when_empty: str = "delete",
        rebalance: bool = False,
    ) -> None:
        """Opens the table, stages the rows and publishes them."""
        if self.partition_cols and not targets:
            return
        self.open(spark, targets if self.partition_cols else None)
        self.publish(spark, self.stage(spark, df, targets, rebalance), when_empty)

    def leftovers(self, spark: SparkSession) -> list[str]:
        """Version folders below the root that no entry of the catalog lies in: of runs that broke off."""
        if self.partition_cols:
            used = self._locations(spark, [()]).values()
        else:
            told = spark.sql(f"DESCRIBE TABLE EXTENDED {self.name}").filter("col_name = 'Location'").first()
            used = [told["data_type"]]
        used = {f"{sinks.without_scheme(u)}/" for u in used}
        found = sinks.folders_in(spark, self.root, "v-")
        return sorted(f for f in found if not any(u.startswith(f"{sinks.without_scheme(f)}/") for u in used))


def _named(values: Values, targets: Sequence[sinks.Target]) -> bool:
    """Whether some target names this partition; targets hold leading values."""
    return any(
        all((_NULL if t is None else str(t)) == v for t, v in zip(target, values, strict=False))
        for target in targets
    )


def _data_first(declared: Sequence[str], added: Sequence[str], partition_cols: Sequence[str]) -> list[str]:
    """Where ADD COLUMNS, which puts new columns after all data columns, gives the declared order."""
    data = [c for c in declared if c not in partition_cols]
    if data[len(data) - len(added) :] != list(added):
        return []
    return [*data[: len(data) - len(added)], *partition_cols, *added]
