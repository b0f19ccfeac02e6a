"""All queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

import importlib

MODULES = ("language", "near_dedup", "substring_dedup", "mixture", "quality", "licenses", "packing", "embedding_dedup", "tokencount", "warc", "tokenfiles", "alignment", "collocations")

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _name in MODULES:
    _module = importlib.import_module(f"orbweave.llm.{_name}")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
