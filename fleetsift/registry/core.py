"""Registration of queries and their SQL."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from fleetsift.plans.rules import Rule, rule_from_dict
from fleetsift.registry.views import VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
AS_OF = "2024-01-31"


def query(name: str, sql: str | None = None, views: str = ""):
    """Register a query; ``views`` names the derived views its SQL reads."""
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(views, sql)
        return fn

    return register


def with_views(views: str, sql: str) -> str:
    """SQL led by the named views."""
    ctes = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in views.split())
    return f"WITH {ctes}\n{sql}" if ctes else sql


@cache
def rulepack() -> tuple[Rule, ...]:
    """The rules shipped with the package."""
    folder = Path(__file__).resolve().parent.parent / "rulepack"
    return tuple(rule_from_dict(json.loads(p.read_text("utf-8"))) for p in sorted(folder.glob("*.json")))
