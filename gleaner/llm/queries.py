"""Registry of the queries of this package, collected from its query modules."""

from __future__ import annotations

from importlib import import_module

MODULES = ["p1", "p2", "p4", "p5", "p6", "p7", "p8"]

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _m in MODULES:
    _q = import_module(f"gleaner.llm.queries_{_m}")
    QUERIES |= _q.QUERIES
    SQL |= _q.SQL
