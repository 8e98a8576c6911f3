"""Relational operators over rule tables and source catalogs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetsift.operators.joins import lookup
from fleetsift.plans.rules import SEVERITY, Rule
from fleetsift.schemas import Source


def severity_rank(level: Column) -> Column:
    """Level name to its rank; unknown and missing levels rank 0."""
    ranks = F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])
    return F.coalesce(ranks[F.lower(F.coalesce(level, F.lit("")))], F.lit(0))


def rules_enabled(rules: DataFrame) -> DataFrame:
    """Drop only rules whose ``enabled`` reads "false"; a missing flag keeps the rule."""
    return rules.filter(F.lower(F.coalesce(F.col("enabled").cast("string"), F.lit("true"))) != "false")


def rules_min_level(rules: DataFrame, min_level: str = "medium") -> DataFrame:
    """Rules at or above a severity."""
    return rules.filter(severity_rank(F.col("level")) >= SEVERITY.get(min_level.lower(), 0))


def rule_set_summary(rules: DataFrame) -> DataFrame:
    """How many rules are live and how many are switched off."""
    off = F.lower(F.coalesce(F.col("enabled").cast("string"), F.lit("true"))) == "false"
    return rules.agg(
        F.coalesce(F.sum(F.when(off, 0).otherwise(1)), F.lit(0)).cast("long").alias("compiled_rule_count"),
        F.coalesce(F.sum(F.when(off, 1).otherwise(0)), F.lit(0)).cast("long").alias("skipped_rule_count"),
    )


def _folded(values: Iterable[str] | None) -> list[str]:
    return sorted({str(v).strip().lower() for v in values or () if v is not None and str(v).strip()})


def select_sources(
    catalog: DataFrame, include_ids=None, exclude_ids=None, include_logs=None, exclude_logs=None,
    include_categories=None, exclude_categories=None,
) -> DataFrame:
    """Sources left by the include and exclude lists: an empty include list means all, an exclude always wins."""
    keep = F.lit(True)
    for column, include, exclude in (
        ("id", include_ids, exclude_ids), ("log_name", include_logs, exclude_logs),
        ("category", include_categories, exclude_categories),
    ):
        value = F.lower(F.coalesce(F.col(column), F.lit("")))
        if _folded(include):
            keep = keep & value.isin(_folded(include))
        if _folded(exclude):
            keep = keep & ~value.isin(_folded(exclude))
    return catalog.filter(keep)


def pick_sources(
    sources: list[Source], include_ids=None, exclude_ids=None, include_logs=None, exclude_logs=None,
    include_categories=None, exclude_categories=None,
) -> list[Source]:
    """``select_sources`` for a source list that is already on the driver."""
    def keeps(value: str, include, exclude) -> bool:
        return (not _folded(include) or value.lower() in _folded(include)) and value.lower() not in _folded(exclude)

    return [
        s for s in sources
        if keeps(s.id, include_ids, exclude_ids) and keeps(s.log_name, include_logs, exclude_logs)
        and keeps(s.category, include_categories, exclude_categories)
    ]


def rules_for_sources(rules: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rules that name at least one source of the catalog, compared without case."""
    allowed = catalog.select(F.lower("id").alias("_source")).distinct()
    named = rules.select("rule_id", F.explode("sources").alias("_name")).select("rule_id", F.lower("_name").alias("_source"))
    hits = lookup(named, allowed, ["_source"], "left_semi").select("rule_id").distinct()
    return rules.join(hits, "rule_id", "left_semi")


def expand_sources(rules: DataFrame) -> DataFrame:
    """One row per (source, rule)."""
    return rules.select(F.explode("sources").alias("SourceId"), *[c for c in rules.columns if c != "sources"])


def rules_by_source(rules: DataFrame) -> DataFrame:
    """Per source, the number of rules that read it and how many of them are severe."""
    return expand_sources(rules).groupBy("SourceId").agg(
        F.count(F.lit(1)).alias("rules"),
        F.sum(F.when(severity_rank(F.col("level")) >= 4, 1).otherwise(0)).cast("long").alias("severe_rules"),
        F.max(severity_rank(F.col("level"))).cast("long").alias("top_rank"),
    )


def missing_logs(catalog: DataFrame, event_log: DataFrame) -> DataFrame:
    """Sources whose log holds no record at all."""
    present = event_log.select("log_name").distinct()
    return catalog.join(present, "log_name", "left_anti")


def live_rules(rules: list[Rule], sources: list[Source], min_level: str) -> list[Rule]:
    """Rules a scan evaluates: enabled, severe enough, and naming a selected source."""
    allowed = {s.id.lower() for s in sources}
    floor = SEVERITY.get(min_level.lower(), 0)
    return [r for r in rules if r.enabled and r.rank >= floor and any(s.lower() in allowed for s in r.sources)]
