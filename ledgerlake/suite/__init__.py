"""Registered queries over the given tables, each with the SQL it is checked against."""

from __future__ import annotations

from ledgerlake.suite import answering, conforming, exploring, landed, quality_gate

_MODULES = (landed, conforming, quality_gate, answering, exploring)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
