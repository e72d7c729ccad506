"""All queries of the core and their SQL oracles."""

from __future__ import annotations

from importlib import import_module

_MODULES = ["catalogue", "search", "graph", "extraction", "upkeep", "general"]


def core() -> tuple[dict, dict]:
    """(queries, oracles) of the core library."""
    queries, oracles = {}, {}
    for name in _MODULES:
        m = import_module(f"codelode.plans.{name}")
        queries |= m.QUERIES
        oracles |= m.ORACLE
    return queries, oracles
