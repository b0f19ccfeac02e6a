"""The engine's registered queries and the SQL that states the same result."""

from __future__ import annotations

import importlib

MODULES = ("scans", "aggregates", "scalars", "sequences", "joined", "analysis", "imagery", "stream", "desk", "parsing", "site", "changed", "shipping", "flying", "areas")

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _name in MODULES:
    _module = importlib.import_module(f"orbweave.plans.{_name}")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
