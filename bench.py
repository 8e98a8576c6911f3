"""Times the headline queries and prints one JSON line.

Each query first runs once, untimed, on the smallest tables beside the timed ones, if there are any, so that the timed run
shows the work on the data and not the start of the JVM, the Python workers and the code generator. The time is the median of
three runs.
"""

from __future__ import annotations

import json
import os
import re
import time
from statistics import median

from pyspark.sql import functions as F

from fleetsift.operators.detect import detect, plan_scan
from fleetsift.plans.rules import rule_from_dict
from fleetsift.registry import load, tables
from fleetsift.session import build_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "detect", "dedup_findings", "tag_rollup", "newest_n_per_source", "scan_stats", "match_re", "match_cidr", "ioc_text_match",
    "ioc_network", "ioc_parent_domain", "hash_match", "log_difference", "user_activity", "timeline_range", "firefox_history",
    "install_history", "parse_event_xml", "parse_ps", "level_facets", "top8_bars", "event_categories", "network_cards",
    "external_ip", "page", "page_deep",
]


def rules_280(spark, sf_dir):
    """280 rules of three ``contains`` and not three ``endswith`` over all documents."""
    found = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w{6,}"), F.lit(0))).alias("word")
    words = [r.word for r in tables.table(spark, sf_dir, "benchmark").select(found).distinct().orderBy("word").limit(5000).collect()]

    def field(operator, values):
        return {"type": "field", "field": "ScriptBlockText", "operator": operator, "values": values}

    rules = [rule_from_dict({
        "title": f"rule {i}", "rule_file": f"{i}.json", "level": "high", "sources": ["powershell_script_block"],
        "items": {"a": field("contains", [words[(3 * i + k) % len(words)] for k in range(3)]),
                  "b": field("endswith", [words[(7 * i + k) % len(words)] + "." for k in range(3)])},
        "condition": {"type": "all", "children": [
            {"type": "item_ref", "name": "a"}, {"type": "not", "child": {"type": "item_ref", "name": "b"}}]},
    }) for i in range(280)]
    return detect(tables.ev_script(spark, sf_dir), plan_scan(spark, rules), "2024-01-31", 11_000)


def main() -> None:
    spark = build_session("bench", f"local[{CPUS}]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "16g",
        "spark.log.level": "ERROR",
    })
    smallest = os.path.join(os.path.dirname(SF_DIR.rstrip("/")), "sf0.001")
    queries = {"rules_280": rules_280, **{name: load()[0][name] for name in HEADLINE}}
    if os.path.isdir(smallest):
        for run in queries.values():
            run(spark, smallest).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name, run in queries.items():
        took = []
        for _ in range(3):
            start = time.perf_counter()
            run(spark, SF_DIR).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        seconds[name] = round(median(took), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": float(re.sub(r".*sf", "", SF_DIR.rstrip("/"))),
    }))


if __name__ == "__main__":
    main()
