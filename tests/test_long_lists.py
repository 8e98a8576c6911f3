"""Indicator lists beyond what a task can be sent, against brute force."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fleetsift.operators import detect as det
from fleetsift.operators import ioc
from fleetsift.operators.joins import is_small
from fleetsift.plans.rules import rule_from_dict
from fleetsift.schemas import EVENT_LOG, SOURCES

HEX = "substring(md5(cast(id AS string)), 1, 12) AS indicator"


def _lines(spark, listed, n=400):
    """Lines with a listed name, a name that is not listed, or none."""
    r = random.Random(2)
    rows = []
    for i in range(n):
        words = [f"word{r.randint(0, 50)}" for _ in range(r.randint(0, 12))]
        if i % 3 == 0:
            words.append(r.choice(listed).upper() + "x")
        if i % 3 == 1:
            words.append("".join(r.choices("0123456789abcdef", k=12)))
        rows.append((i, " ".join(words) if i % 50 else None))
    return spark.createDataFrame(rows, "n int, s string")


@pytest.mark.parametrize("n, path", [(300_000, "shards"), (1_000_000, "grams")])
def test_long_lists_equal_brute_force(spark, n, path):
    indicators = spark.range(n).selectExpr(HEX).cache()
    listed = {r.indicator for r in indicators.collect()}
    lines = _lines(spark, sorted(listed)[:2_000])
    # all indicators have twelve characters, so a window over the text finds every one
    expected = {(r.n, r.s[k:k + 12].lower()) for r in lines.collect() if r.s for k in range(len(r.s)) if r.s[k:k + 12].lower() in listed}
    met = ioc.match_literals(lines, "s", indicators)
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert ("_gram" in plan) == (path == "grams")
    found = met.select("n", "indicator").collect()
    assert {tuple(r) for r in found} == expected and len(found) == len(expected) > 100


def test_the_filter_before_the_gram_join_grows_with_the_list(spark):
    anchors = spark.range(1_000_000).select(F.substring(F.md5(F.col("id").cast("string")), 1, 6).alias("_gram"))
    pieces = spark.range(2_000_000, 2_200_000).select(F.concat(F.lit("z"), F.substring(F.md5(F.col("id").cast("string")), 1, 5)).alias("_gram"))
    assert ioc._maybe_filed(pieces, anchors).count() < 0.07 * 200_000
    assert ioc._maybe_filed(anchors, anchors).count() == 1_000_000


def _rule(operator, **more):
    node = {"type": "field", "field": "CommandLine", "operator": operator, "values": ["always"], **more}
    return rule_from_dict({"title": "t", "rule_file": "f", "level": "high", "sources": ["security_process_creation"],
                           "items": {"listed": node, "verb": {"type": "field", "field": "CommandLine", "operator": "contains", "values": ["w"]}},
                           "condition": {"type": "wildcard_ref", "pattern": "them", "mode": "all"}})


def _events(spark, listed):
    r = random.Random(3)
    rows = []
    for i in range(300):
        name = r.choice(listed)
        text = [f"w {name} tail", f"{name}w", f"w{name}", name + "w" * (i % 2), "w always", name, "", f"W {name.upper()}", "w glob-q-end", None][i % 10]
        rows.append((f"h{i % 3}", r.choice(["Security", "Security", "other"]), "p", 4688, i, datetime(2024, 1, 1), {"commandline": text}, None, ""))
    return spark.createDataFrame(rows, EVENT_LOG)


@pytest.mark.parametrize("operator, fold", [("contains", True), ("contains", False), ("exact", True), ("startswith", True), ("endswith", False)])
def test_an_injected_list_beyond_the_limit_gives_the_rows_of_operands(spark, operator, fold):
    listed = [f"name{i:04d}w" if operator == "exact" else f"name{i:04d}" for i in range(300)] + ["glob-?-end"]
    frame = spark.createDataFrame([(x,) for x in [*listed, "", None]], "indicator string")
    events, source = _events(spark, listed[:40]), next(s for s in SOURCES if s.id == "security_process_creation")
    told = []
    for most in (1_000, 50):
        given, rule, own = ioc.inject_indicators(events, _rule(operator, ignore_case=fold), "LISTED", frame, source, max_compiled=most)
        assert (given is events) == (most == 1_000)
        told.append(sorted(r.RecordId for r in det.detect(given, det.plan_scan(spark, [rule], [own]), "2024-01-02").collect()))
    assert told[0] == told[1] and len(told[0]) > 20


def test_three_hundred_thousand_injected_values(spark):
    indicators = spark.range(300_000).selectExpr(HEX)
    listed = [r.indicator for r in indicators.filter("id % 10000 = 7").collect()]
    events, source = _events(spark, listed), next(s for s in SOURCES if s.id == "security_process_creation")
    assert not is_small(indicators.distinct(), ioc.MAX_LITERALS, ioc.MAX_LITERAL_BYTES)
    given, rule, own = ioc.inject_indicators(events, _rule("contains"), "listed", indicators, source)
    found = sorted(r.RecordId for r in det.detect(given, det.plan_scan(spark, [rule], [own]), "2024-01-02").collect())
    every = {r.indicator for r in indicators.collect()}

    def hit(text):
        low = (text or "").lower()
        return "w" in low and ("always" in low or any(low[k:k + 12] in every for k in range(len(low))))

    assert found == sorted(r.record_id for r in events.filter("log_name = 'Security'").collect() if hit(r.event_data["commandline"]))


def test_what_a_join_cannot_express_is_refused(spark):
    frame = spark.range(20).selectExpr("concat('x', id) AS indicator")
    for more in ({"match": "all"}, {"windash": True}):
        with pytest.raises(ValueError, match="plain field matchers"):
            ioc.inject_indicators(_events(spark, ["x1"]), _rule("contains", **more), "listed", frame, SOURCES[0], max_compiled=10)
