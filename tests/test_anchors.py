"""Anchors of rules: they occur wherever a rule holds, and a whole generated corpus scans like the plain interpreter."""

import json
import random
import re
from datetime import datetime

import pytest

from fleetsift.operators import detect as det
from fleetsift.plans.anchors import regex_runs, rule_anchors
from fleetsift.plans.rules import Options, rule_from_dict
from fleetsift.schemas import EVENT_LOG, SOURCES, Source
from fleetsift.sources.rule_files import load_rules
from tests.reference import evaluate
from tests.test_detect import _events, _expected

PIECES = ["alpha", "Beta", "gamma", "delta", "power", "shell", "-enc", "/enc", "mimi", "Katz", "x", "C:\\Temp\\", ".exe", "it's", "KELVIN", "é"]


def _matcher(rng, fields):
    operator = rng.choice(["contains"] * 4 + ["startswith", "endswith", "exact", "re", "is_null"])
    values = ["".join(rng.choices(PIECES, k=rng.randint(1, 2))) for _ in range(rng.randint(1, 3))]
    if operator == "re":
        values = [rng.choice([re.escape(v), f"{re.escape(v)}.*", f"(?:{re.escape(v)}|beta)", f"[a-z]+{re.escape(v)}?", rf"\b{re.escape(v)}+\W"]) for v in values]
    elif rng.random() < 0.3:
        values = [v + rng.choice(["*", "?", ""]) + rng.choice(PIECES) for v in values]
    if rng.random() < 0.1:
        values.append(rng.choice(["", None]))
    node = {"operator": operator, "values": values, "match": rng.choice(["any", "any", "all"]), "ignore_case": rng.random() < 0.7}
    if rng.random() < 0.15:
        return node | {"type": "raw"}
    return node | {"type": "field", "field": rng.choice(fields), "windash": rng.random() < 0.2}


def _tree(rng, fields, depth, items):
    kind = rng.choice(["leaf", "leaf", "all", "any", "not", "ref"] if depth else ["leaf"])
    if kind == "leaf":
        return _matcher(rng, fields)
    if kind == "ref" and items:
        return rng.choice([{"type": "item_ref", "name": rng.choice(items)}, {"type": "wildcard_ref", "pattern": rng.choice(["them", "s*"]), "mode": rng.choice(["any", "all"])}])
    if kind == "not":
        return {"type": "not", "child": _tree(rng, fields, depth - 1, items)}
    return {"type": "any" if kind == "any" else "all", "children": [_tree(rng, fields, depth - 1, items) for _ in range(rng.randint(1, 3))]}


def _corpus(n, sources, seed=8):
    rng = random.Random(seed)
    rules = []
    for i in range(n):
        fields = ["CommandLine", "Image", "HostApplication", "User"]
        items = {f"s{k}": _tree(rng, fields, 1, []) for k in range(rng.randint(1, 3))}
        rules.append({"title": f"t{i}", "rule_id": str(i), "rule_file": f"f{i}.json", "level": "high", "tags": ["attack.t1059"], "enabled": True,
                      "sources": rng.sample(sources, rng.choice([1, 1, 2])), "items": items, "condition": _tree(rng, fields, 2, list(items))})
    return rules


def _texts(n, seed=4):
    rng = random.Random(seed)
    return [rng.choice(["", " "]).join(rng.choices([*PIECES, *[p.upper() for p in PIECES], *[p.lower() for p in PIECES], "\n"], k=rng.randint(0, 6))) for _ in range(n)]


def test_an_anchor_occurs_wherever_a_rule_holds():
    """Against the interpreter, whose regexes fold case like the scan's."""
    texts = _texts(400)
    seen = 0
    for doc in _corpus(300, ["a", "b"]):
        for options in (Options(), Options(honour_escapes=True)):
            anchors = rule_anchors(rule_from_dict(doc), options)
            for k, text in enumerate(texts):
                fields = {"commandline": text, "image": texts[-k], "hostapplication": text, "user": ""}
                if not evaluate(doc["condition"], doc["items"], fields, texts[k // 2]):
                    continue
                seen += 1
                if anchors is not None:
                    whole = {None: texts[k // 2], **fields}
                    value = lambda f, w=whole: w[f.lower() if f else None]
                    assert any(literal in (value(f).lower() if view == "lower" else value(f)) for f, view, literal in anchors), (doc, text, anchors)
    assert seen > 5_000


def test_folding_of_regexes_beyond_lower_case_is_kept(spark):
    """A regex that ignores case takes the long s, the dotless i and the Kelvin sign for s, i and k."""
    docs = [{"title": f"t{i}", "rule_file": f"f{i}", "level": "high", "sources": ["security_process_creation"], "condition": {
        "type": "field", "field": "CommandLine", "operator": operator, "values": [value]}}
        for i, (operator, value) in enumerate([("re", "passkit"), ("contains", "pass*kit"), ("re", "kit pass"), ("re", "s+i")] + [("re", f"w{i}") for i in range(60)])]
    text = "pa\u017f\u017f\u212a\u0131t S\u0131"
    row = ("h", "Security", "p", 4688, 1, datetime(2024, 1, 1), {"commandline": text}, None, "")
    found = det.detect(spark.createDataFrame([row], EVENT_LOG), det.plan_scan(spark, [rule_from_dict(d) for d in docs]), "2024-01-02").collect()
    assert {r.RuleFile for r in found} == {"f0", "f1", "f3"}


@pytest.mark.parametrize("pattern, runs", [
    (r"abc\.def", ["abc.def"]), (r"ab+c*de", ["ab", "de"]), (r"a(b|c)de[xy]f", ["a", "de", "f"]), (r"ab|cd", []), (r"(?i)ab", []), (r"\Qa\E", []),
    (r"x{2}yz", ["yz"]), (r"[a[b]]cd", []), (r"\x41bc", []), (r"a\dbc?d", ["a", "b", "d"]), (r"(?:a(b)[)]c)de", ["de"]), (r"^ab$", ["ab"]), ("", [])])
def test_literal_runs_of_a_regex(pattern, runs):
    assert regex_runs(pattern) == runs


def _plain(doc):
    """The rule without regexes, whose dialect in the interpreter differs."""
    return json.loads(json.dumps(doc).replace('"re"', '"contains"'))


@pytest.mark.parametrize("n", [280, 1000])
def test_a_large_corpus_agrees_with_the_interpreter(spark, n):
    ids = ["security_process_creation", "sysmon_process_creation", "powershell_classic"]
    docs, rows = [_plain(d) for d in _corpus(n, ids)], _events(150)
    texts = _texts(600)
    rows = [(*r[:6], {**r[6], "commandline": texts[i], "hostapplication": texts[-i - 1]}, *r[7:]) for i, r in enumerate(rows)]
    plan = det.plan_scan(spark, [rule_from_dict(d) for d in docs])
    found = det.detect(spark.createDataFrame(rows, EVENT_LOG), plan, "2024-02-04", 60).collect()
    expected = _expected(rows, docs, datetime(2024, 2, 4), 60)
    assert {(r.host, r.SourceId, r.RuleFile, r.RecordId) for r in found} == expected and len(expected) > 500


def test_rules_without_an_anchor_still_run(spark):
    leaf = {"type": "field", "field": "CommandLine", "operator": "contains", "values": ["absent"]}
    docs = [{"title": f"t{i}", "rule_file": f"f{i}", "level": "high", "sources": ["security_process_creation"],
             "condition": {"type": "not", "child": leaf} if i % 2 else {**leaf, "values": [f"w{i}"]}} for i in range(100)]
    row = ("h", "Security", "p", 4688, 1, datetime(2024, 1, 1), {"commandline": "w4 w40"}, None, "")
    found = det.detect(spark.createDataFrame([row], EVENT_LOG), det.plan_scan(spark, [rule_from_dict(d) for d in docs]), "2024-01-02").collect()
    assert {r.RuleFile for r in found} == {f"f{i}" for i in range(100) if i % 2 or i in (4, 40)}


def test_a_generated_corpus_of_the_documented_size_loads_and_scans(spark, tmp_path):
    docs = _corpus(462, [s.id for s in SOURCES[:8]], seed=9)
    for i, doc in enumerate(docs):
        folder = tmp_path / f"set{i % 7}"
        folder.mkdir(exist_ok=True)
        (folder / doc["rule_file"]).write_text(json.dumps(doc), "utf-8")
    rules = load_rules(spark, str(tmp_path))
    assert len(rules) == 462
    plan = det.plan_scan(spark, rules)
    assert len(plan.pairs) == sum(len(set(d["sources"])) for d in docs) and not plan.errors
    assert det.detect(spark.createDataFrame(_events(60), EVENT_LOG), plan, "2024-02-04", 60).count() > 0


def test_payload_columns_of_their_own_are_read_only_where_rules_need_them(spark, tmp_path):
    columns = "host string, log_name string, event_id int, record_id long, time_created timestamp, CommandLine string, Image string, Parent string, Note string"
    rows = [("h", "Flat", 1, i, datetime(2024, 1, 1), f"run w{i}", "C:\\a.exe", "p", "n" * 50) for i in range(20)]
    spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / "flat"))
    source = Source("flat", "Flat", "process", (1,), {f: ("column", f) for f in ("CommandLine", "Image", "Parent", "Note")})
    rules = [rule_from_dict({"title": f"t{i}", "rule_file": f"f{i}", "level": "high", "sources": ["flat"], "condition": {
        "type": "field", "field": "commandline", "operator": "endswith", "values": [f"w{i}"]}}) for i in range(3)]
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    for many in (rules, rules * 20):
        log = spark.read.parquet(str(tmp_path / "flat"))
        found = det.detect(log, det.plan_scan(spark, many, [source]), "2024-01-02")
        schema = re.findall(r"ReadSchema: (\S+)", found._jdf.queryExecution().executedPlan().toString())
        assert schema and all("CommandLine" in s and "Image" in s and "Parent" not in s and "Note" not in s for s in schema)
        assert sorted((r.RecordId, r.RuleFile, r.CommandLine, r.Process, r.User) for r in found.collect()) == [
            (i, f"f{i}", f"run w{i}", "C:\\a.exe", "N/A") for i in range(3)]
    assert det.field_project(log, source, ["Note", "Absent"]).first().Note == "n" * 50
