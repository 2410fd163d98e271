"""Declarations the operators take: schemas, sources, rules, metrics, checks.

Everything here is plain data. A dataset is described once (see ``ledgerlake.taxi``)
and the operators stay free of column names, months and fleets.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from string import Formatter

from pyspark.sql import Column


@dataclass(frozen=True)
class TableSpec:
    """Canonical table: ordered data columns with types, plus lineage columns."""

    columns: Mapping[str, str]
    scope: str
    month: str
    loaded_at: str

    @property
    def lineage(self) -> tuple[str, str, str]:
        return (self.scope, self.month, self.loaded_at)

    @property
    def all_columns(self) -> dict[str, str]:
        lineage_types = {self.scope: "string", self.month: "string", self.loaded_at: "timestamp"}
        return {**self.columns, **lineage_types}

    def ddl(self, without: tuple[str, ...] = ()) -> str:
        return ", ".join(f"`{c}` {t}" for c, t in self.all_columns.items() if c not in without)


@dataclass(frozen=True)
class Alias:
    """``source`` is the spelling a file uses for ``target`` in months [since, until)."""

    source: str
    target: str
    since: str | None = None
    until: str | None = None

    def active(self, month: str) -> bool:
        return (self.since is None or month >= self.since) and (
            self.until is None or month < self.until
        )


@dataclass(frozen=True)
class SourceSpec:
    """One family of monthly files that feeds the canonical table."""

    name: str
    aliases: tuple[Alias, ...] = ()
    absent: tuple[str, ...] = ()

    def spelling(self, month: str, table: TableSpec) -> dict[str, str]:
        """Canonical data column -> column name a file of ``month`` must use."""
        renamed = {a.target: a.source for a in self.aliases if a.active(month)}
        return {c: renamed.get(c, c) for c in table.columns if c not in self.absent}


@dataclass(frozen=True)
class OutputColumn:
    name: str
    type: str
    expression: str | None = None


@dataclass(frozen=True)
class OutputSpec:
    """Ordered projection with types: the published schema of a table."""

    columns: tuple[OutputColumn, ...]

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def plus(self, *more: OutputColumn) -> OutputSpec:
        return OutputSpec(self.columns + more)

    def ddl(self) -> str:
        return ", ".join(f"`{c.name}` {c.type}" for c in self.columns)


@dataclass(frozen=True)
class Rule:
    """A named violation. Rules are kept in an ordered list; the first match wins."""

    name: str
    violation_sql: str


@dataclass(frozen=True)
class MetricSpec:
    """Names used by the persisted quality metrics."""

    input_rows: str
    clean_rows: str
    total: str
    rejected_prefix: str
    metric: str
    scope: str
    value: str
    run_ts: str


@dataclass(frozen=True)
class Check:
    """One aggregate over a table and the condition it is expected to meet."""

    name: str
    observed_sql: str
    expected: str
    holds: Callable[[Column], Column]


@dataclass(frozen=True)
class Layout:
    """Where one monthly source lives: templates of its file name and of its path.

    A source may be a single file or a folder of part files; both carry the same path prefix.
    """

    file: str
    path: str

    def file_name(self, scope: str, month: str) -> str:
        return self.file.format(scope=scope, month=month)

    def source_path(self, root: str, scope: str, month: str) -> str:
        file = self.file_name(scope, month)
        path = self.path.format(root="", scope=scope, year=month[:4], month=month, file=file)
        return root.rstrip("/") + path

    def pattern(self) -> str:
        """Regular expression on a listed path; group 1 is the scope, group 2 the month."""
        tail = self.path.replace("{root}", "").replace("{file}", self.file)
        groups = {"scope": "([^/]+?)", "month": "(\\d{4}-\\d{2})"}
        repeated = {"scope": "\\1", "month": "\\2"}
        regex = ""
        for text, name, _, _ in Formatter().parse(tail):
            regex += re.escape(text)
            if name == "year":
                regex += "\\d{4}"
            elif name:
                regex += groups.pop(name, repeated[name])
        return regex + "(?:/.*)?$"

    def month_marker(self) -> str | None:
        """Text right before the month in every path, when it tells where the month starts."""
        tail = self.path.replace("{file}", self.file)
        marker = re.search(r"[^{}]*(?=\{month\})", tail).group()
        return marker if marker.strip("/") else None


@dataclass(frozen=True)
class Dataset:
    """A complete case: what the pipeline needs to run end to end."""

    table: TableSpec
    sources: Mapping[str, SourceSpec]
    layout: Layout
    rules: tuple[Rule, ...]
    violated_rule: str
    clean: OutputSpec
    rejected: OutputSpec
    metrics: MetricSpec
    months: tuple[str, ...] = ()
    expected_bytes: Mapping[str, int] = field(default_factory=dict)

    def source(self, name: str) -> SourceSpec:
        if name not in self.sources:
            raise ValueError(f"unknown source {name!r}; declared: {sorted(self.sources)}")
        return self.sources[name]
