import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetsift.functions import literals
from fleetsift.operators import detect as det
from fleetsift.plans.rules import rule_from_dict
from fleetsift.registry import tables
from fleetsift.registry.core import rulepack
from fleetsift.schemas import EVENT_LOG, SOURCES
from fleetsift.streaming.detect import detect_stream
from tests.reference import evaluate

SF = "/root/testdata/sf0.001"
WORDS = ["alpha", "beta", "gamma", "delta", "powershell", "-enc", "/enc", "mimikatz", "x*y", "C:\\Temp\\a.exe", "${v}", "it's"]


def _events(n, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        log, eid = rng.choice([("Security", 4688), ("Security", 4624), (tables.SYSMON, 1), (tables.SYSMON, 3), ("Windows PowerShell", 400)])
        text = " ".join(rng.choices(WORDS, k=rng.randint(0, 5)))
        data = {"commandline": text, "newprocessname": rng.choice(["C:\\a.exe", "C:\\Temp\\B.EXE"]), "image": rng.choice(["C:\\a.exe", ""]),
                "hostapplication": text.upper()}
        if rng.random() < 0.5:
            data["subjectusername"] = rng.choice(["", "bob"])
        record = None if rng.random() < 0.1 else rng.randint(0, n // 2)
        rows.append((f"h{rng.randint(0, 2)}", log, "p", eid, record, datetime(2024, 1, 1) + timedelta(minutes=rng.randint(0, 50000)),
                     data, rng.choice([None, "msg"]), "<x/>"))
    return rows


def _rules(n, seed=5):
    rng = random.Random(seed)
    rules = []
    for i in range(n):
        field = {"type": "field", "field": rng.choice(["CommandLine", "Image", "HostApplication"]),
                 "operator": rng.choice(["contains", "contains", "startswith", "endswith"]), "values": rng.sample(WORDS, 2) + [f"w{i}"],
                 "match": rng.choice(["any", "any", "all"]), "windash": rng.random() < 0.3, "ignore_case": rng.random() < 0.7}
        tree = rng.choice([field, {"type": "not", "child": field}, {"type": "all", "children": [field, {"type": "raw",
                           "operator": "contains", "values": ["msg"], "ignore_case": True}]}])
        rules.append({"title": f"t{i}", "rule_file": f"f{i // 2}", "level": rng.choice(["high", "Medium", "low"]), "tags": ["a", "b"],
                      "sources": rng.sample(["security_process_creation", "sysmon_process_creation", "powershell_classic"], 2),
                      "items": {"i": tree}, "condition": {"type": "item_ref", "name": "i"}})
    return rules


def _expected(rows, rules, as_of, days, cap=0):
    """The scan as it is described: newest first, one finding per host, source, rule file and record."""
    found = set()
    for source in SOURCES:
        live = [r for r in rules if source.id in r["sources"] and r["level"].lower() in ("high", "medium")]
        per_host = {}
        for row in rows:
            if row[1] == source.log_name and row[3] in source.event_ids and row[5] >= as_of - timedelta(days=days):
                per_host.setdefault(row[0], []).append(row)
        for host, events in per_host.items():
            events.sort(key=lambda r: (r[5], -1 if r[4] is None else r[4]), reverse=True)
            for row in events[:cap] if cap else events:
                fields = {f.lower(): row[6].get(ref[1].lower()) for f, ref in source.field_map.items() if ref[0] == "eventdata"}
                raw = f"{row[7]}\n{row[8]}" if row[7] else row[8]
                for rule in live:
                    if evaluate(rule["condition"], rule["items"], fields, raw):
                        found.add((host, source.id, rule["rule_file"], row[3] if row[4] is None else row[4]))
    return found


@pytest.mark.parametrize("rules, cap, indexed", [(12, 0, True), (80, 0, True), (80, 0, False), (30, 7, True)])
def test_scan_agrees_with_interpreter(spark, monkeypatch, rules, cap, indexed):
    if not indexed:
        monkeypatch.setattr(literals, "ahocorasick", None)
    rows, docs = _events(400), _rules(rules)
    plan = det.plan_scan(spark, [rule_from_dict(d) for d in docs])
    log = spark.createDataFrame(rows, EVENT_LOG)
    found = det.detect(log, plan, "2024-02-04", 20, max_events_per_source=cap).collect()
    keys = [(r.host, r.SourceId, r.RuleFile, r.RecordId) for r in found]
    assert len(keys) == len(set(keys))
    assert set(keys) == _expected(rows, docs, datetime(2024, 2, 4), 20, cap)
    assert {r.User for r in found} <= {"", "bob", "N/A"} and "N/A" in {r.User for r in found}
    raw = det.detect(log, plan, "2024-02-04", 20, max_events_per_source=cap, dedup=False)
    assert {(r.host, r.SourceId, r.RuleFile, r.RecordId) for r in det.dedup_findings(raw).collect()} == set(keys)


def test_dedup_keeps_the_newest(spark):
    def event(record, minute, text):
        return ("h", "Security", "p", 4688, record, datetime(2024, 1, 1, 0, minute), {"commandline": text}, None, "")

    rows = [event(1, 1, "one two"), event(1, 2, "one"), event(1, 3, "three"), event(None, 4, "one"), event(None, 5, "one two")]
    rules = [rule_from_dict({"title": w, "rule_file": w, "level": "high", "sources": ["security_process_creation"], "condition": {
        "type": "field", "field": "CommandLine", "operator": "contains", "values": [w]}}) for w in ("one", "two", "three")]
    found = det.detect(spark.createDataFrame(rows, EVENT_LOG), det.plan_scan(spark, rules), "2024-01-02").collect()
    assert sorted((r.RecordId, r.RuleFile, r.TimeCreated[-5:], r.CommandLine) for r in found) == [
        (1, "one", "02:00", "one"), (1, "three", "03:00", "three"), (1, "two", "01:00", "one two"),
        (4688, "one", "05:00", "one two"), (4688, "two", "05:00", "one two")]


@pytest.mark.parametrize("shared", [False, True])
def test_a_record_of_thousands_of_copies_with_different_hits(spark, shared):
    names = [f"w{k}x" for k in range(13)]
    rng, rows, newest = random.Random(9), [], {}
    for i in range(6000):
        # record 1 has most copies, each with its own words; all others have one or two
        record, own = 1 if i % 3 else 2 + i // 6, sorted(rng.sample(names, rng.randint(1, 9)))
        at = datetime(2024, 1, 1) + timedelta(seconds=rng.randint(0, 4000))
        text = " ".join(own)
        rows.append(("h", "Security", "p", 4688, record, at, {"commandline": text}, None, ""))
        firsts = {}
        for n in own:
            firsts.setdefault(names.index(n) // 2 if shared else n, n)
        for file, title in firsts.items():
            key = (record, f"f{file}")
            newest[key] = max(newest.get(key, (datetime.min, "", "")), (at, text, title))
    rules = [rule_from_dict({"title": n, "rule_file": f"f{k // 2}" if shared else f"f{n}", "level": "high", "tags": [f"attack.{n}", "attack.t1000"],
                             "sources": ["security_process_creation"], "condition": {
        "type": "field", "field": "CommandLine", "operator": "contains", "values": [n]}}) for k, n in enumerate(names)]
    log, plan = spark.createDataFrame(rows, EVENT_LOG), det.plan_scan(spark, rules)
    assert plan.shared_files == shared
    found = det.detect(log, plan, "2024-01-02").collect()
    got = {(r.RecordId, r.RuleFile): (datetime.fromisoformat(r.TimeCreated), r.CommandLine, r.RuleTitle) for r in found}
    assert len(found) == len(got) and got == newest
    tags = {r.tag: r.findings for r in det.tag_rollup(det.scan_tags(log, plan, "2024-01-02")).collect()}
    want = {}
    for _, _, title in newest.values():
        for tag in (f"attack.{title}", "attack.t1000"):
            want[tag] = want.get(tag, 0) + 1
    assert tags == want


def test_both_dedups_keep_the_same_of_two_copies_in_one_second(spark):
    rows = [("h", "Security", "p", 4688, 1, datetime(2024, 1, 1, 0, 0, 0, micro), {"commandline": text}, None, "")
            for micro, text in ((1000, "one z"), (6000, "one a"))]
    rule = rule_from_dict({"title": "one", "rule_file": "one", "level": "high", "sources": ["security_process_creation"], "condition": {
        "type": "field", "field": "CommandLine", "operator": "contains", "values": ["one"]}})
    log, plan = spark.createDataFrame(rows, EVENT_LOG), det.plan_scan(spark, [rule])
    raw = det.detect(log, plan, "2024-01-02", dedup=False, extra=["time_created"])
    assert raw.count() == 2
    kept = [det.detect(log, plan, "2024-01-02"), det.dedup_findings(raw).drop("time_created")]
    assert [[tuple(r) for r in k.collect()] for k in kept][0] == [tuple(r) for r in kept[1].collect()]
    assert kept[0].first().CommandLine == "one a"


def test_plan_sets_bad_rules_aside(spark):
    plan = det.plan_scan(spark, rulepack())
    assert {(e[0], e[1]) for e in plan.errors} == {
        ("powershell_script_block", "rules/own/unknown_operator.json"), ("powershell_classic", "rules/own/unknown_operator.json"),
        ("powershell_script_block", "rules/own/self_reference.json")}
    assert det.rule_errors(spark, plan).count() == 3
    files = {r.rule_file for _, _, r in plan.pairs}
    assert not files & {"rules/own/switched_off.json", "rules/own/unknown_level.json", "rules/own/one_char.json"}
    none = det.plan_scan(spark, rulepack(), include_ids=["no_such_source"])
    assert det.detect(tables.event_log(spark, SF), none, "2024-01-31").count() == 0


def test_scan_reads_each_log_once(spark):
    plan = det.plan_scan(spark, rulepack(), min_level="informational")
    found = det.detect(tables.event_log(spark, SF), plan, "2024-01-31", 11_000)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan parquet") == 4
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "GreaterThanOrEqual(ts" in text


def test_predicates_are_never_null(spark):
    log = spark.createDataFrame([("h", tables.POWERSHELL, None, 4104, None, None, {}, None, None)], EVENT_LOG)
    views = {"raw": det.raw_sql(), "field": det.payload_sql("scriptblocktext")}
    from fleetsift.functions.matching import Views
    from fleetsift.plans.rules import compile_rule

    for rule in rulepack():
        if rule.rule_file.endswith(("unknown_operator.json", "self_reference.json", "bad_regex.json")):
            continue
        test = compile_rule(rule, lambda name: Views(views["field"]), lambda: Views(views["raw"]))
        assert log.select(F.expr(test).alias("t")).first().t is not None


def test_stream_finds_what_the_batch_finds(spark, tmp_path):
    rows, docs = _events(200), _rules(20)
    log = spark.createDataFrame(rows, EVENT_LOG)
    log.write.parquet(str(tmp_path / "events"))
    plan = det.plan_scan(spark, [rule_from_dict(d) for d in docs])
    stream = spark.readStream.schema(EVENT_LOG).parquet(str(tmp_path / "events"))
    query = detect_stream(stream, plan, "2024-01-01").writeStream.format("memory").queryName("found").option(
        "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    streamed = {(r.host, r.SourceId, r.RuleFile, r.RecordId) for r in spark.table("found").collect()}
    batch = {(r.host, r.SourceId, r.RuleFile, r.RecordId) for r in det.detect(log, plan, "2024-01-01", 0).collect()}
    assert streamed == batch and batch


def test_rule_json_round_trip(spark):
    from fleetsift.plans.rules import rules_from_df, rules_to_df

    assert sorted(rules_from_df(rules_to_df(spark, rulepack())), key=lambda r: r.rule_id) == sorted(rulepack(), key=lambda r: r.rule_id)
    assert json.dumps(rulepack()[0].items)
