"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: what an empty hit list says.
NO_MATCHES = "No matches found"


def sink_findings_json(findings: DataFrame, path: str) -> None:
    """Findings as JSON lines."""
    findings.write.mode("errorifexists").json(path)


def sink_csv(table: DataFrame, path: str) -> None:
    """A table as CSV with a header."""
    table.write.mode("errorifexists").option("header", True).csv(path)


def hit_lines(hits: DataFrame) -> DataFrame:
    """``indicator|source|line`` rows, or the one sentinel row if there is no hit."""
    lines = hits.select(F.concat_ws("|", "indicator", "source", "line").alias("value")).distinct()
    nothing = hits.limit(1).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == 0)
    return lines.unionByName(nothing.select(F.lit(NO_MATCHES).alias("value")))


def sink_hits_text(hits: DataFrame, path: str) -> None:
    """Hit lines, sorted, as text."""
    hit_lines(hits).orderBy("value").write.mode("errorifexists").text(path)
