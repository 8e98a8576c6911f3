"""The detection scan over a stream of events.

The compiled rules are plain column expressions, so the batch scan runs on a stream as it is; only the removal of
repeated findings needs state, bounded by a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from fleetsift.operators.detect import FINDING_KEY, ScanPlan, detect_hits, project_finding


def detect_stream(events: DataFrame, plan: ScanPlan, since: str, late: str = "10 minutes") -> DataFrame:
    """Findings of a stream of ``event_log`` rows from ``since`` on, each once per host, source, rule file and record."""
    hits = detect_hits(events.withWatermark("time_created", late), plan, as_of=since, days_back=0)
    findings = project_finding(hits, plan, extra=["time_created"])
    return findings.dropDuplicatesWithinWatermark(FINDING_KEY)
