"""Every operator as a query over the test tables, with the SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

MODULES = ("matching", "rules", "indicators", "logs", "history", "snapshots", "report", "sources", "hits")


def load() -> tuple[dict, dict]:
    """(queries, oracle SQL) of all modules."""
    from fleetsift.registry import core

    for name in MODULES:
        import_module(f"fleetsift.registry.{name}")
    return dict(core.QUERIES), dict(core.ORACLES)
