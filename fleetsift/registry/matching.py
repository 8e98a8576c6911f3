"""Matchers and boolean composition over the event views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetsift.functions.matching import Views, match
from fleetsift.operators.detect import field_project, payload_sql, raw_sql
from fleetsift.plans.rules import compile_expression, compile_rule, rule_from_dict
from fleetsift.registry import tables as t
from fleetsift.registry.core import query
from fleetsift.schemas import SOURCES


def _value(name: str) -> str:
    return payload_sql(name.lower())


def _hits(events: DataFrame, predicate) -> DataFrame:
    return events.filter(predicate).select("host", "record_id")


def _tree(events: DataFrame, condition: dict, items: dict | None = None) -> DataFrame:
    test = compile_expression(condition, items or {}, lambda name: Views(_value(name)), lambda: Views(raw_sql()))
    return _hits(events, test)


def _field(field: str, operator: str, *values: str, **options) -> dict:
    return {"type": "field", "field": field, "operator": operator, "values": list(values), "ignore_case": True, **options}


@query("match_exact", "SELECT host, record_id FROM ev_process WHERE lower(image) = 'c:\\bin\\user.exe' "
       "OR lower(image) LIKE 'c:\\bin\\assist%'", "ev_process")
def match_exact(spark, d):
    return _hits(t.ev_process(spark, d), match(_value("image"), "exact", ["C:\\BIN\\user.EXE", "c:\\bin\\assist*"]))


@query("match_contains", "SELECT host, record_id FROM ev_script WHERE contains(lower(script), 'license') "
       "OR contains(lower(script), 'token =') OR contains(lower(script), 'été')", "ev_script")
def match_contains(spark, d):
    return _hits(t.ev_script(spark, d), match(_value("scriptblocktext"), "contains", ["LICENSE", "token =", "ÉTÉ"]))


@query("match_startswith", "SELECT host, record_id FROM ev_script WHERE starts_with(lower(script), 'th') "
       "OR starts_with(lower(script), 'é')", "ev_script")
def match_startswith(spark, d):
    return _hits(t.ev_script(spark, d), match(_value("scriptblocktext"), "startswith", ["TH", "É"]))


@query("match_endswith", "SELECT host, record_id FROM ev_script WHERE ends_with(lower(script), 'en.') "
       "OR ends_with(lower(script), 'version 2.0.')", "ev_script")
def match_endswith(spark, d):
    return _hits(t.ev_script(spark, d), match(_value("scriptblocktext"), "endswith", ["EN.", "Version 2.0."]))


@query("match_re", r"SELECT host, record_id FROM ev_script WHERE regexp_matches(script, "
       r"'[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}') OR regexp_matches(script, 'TOKEN +=', 'i')", "ev_script")
def match_re(spark, d):
    text = _value("scriptblocktext")
    address = match(text, "re", [r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"], ignore_case=False)
    return _hits(t.ev_script(spark, d), address | match(text, "re", ["TOKEN +="]))


@query("match_cidr", "SELECT host, record_id, CAST(ip1 = 10 OR (ip1 = 100 AND ip2 BETWEEN 16 AND 31) OR ip1 BETWEEN 64 AND 95 "
       "AS BOOLEAN) AS v4, CAST(ip1 BETWEEN 32 AND 63 AS BOOLEAN) AS v6 FROM ev_network", "ev_network")
def match_cidr(spark, d):
    octets = F.split(F.col("event_data")["destinationip"], r"\.")
    groups = [F.lower(F.hex(F.get(octets, F.lit(i)).cast("int"))) for i in range(2)]
    v6 = F.concat(F.lit("2001:db8:"), F.lpad(groups[0], 2, "0"), F.lit("00::"), groups[1])
    blocks = ["10.0.0.0/8", "100.16.0.0/12", "64.0.0.0/3", "fe80::/10", "bad"]
    return t.ev_network(spark, d).withColumn("v6", v6).select(
        "host", "record_id", match(_value("destinationip"), "cidr", blocks).alias("v4"),
        match("v6", "cidr", ["2001:db8:2000::/35", "0.0.0.0/0"]).alias("v6"))


@query("match_is_null", "SELECT host, record_id FROM ev_script WHERE record_id % 3 <> 2 OR trim(path) = ''", "ev_script")
def match_is_null(spark, d):
    path = F.expr(r"CASE record_id % 3 WHEN 0 THEN NULL WHEN 1 THEN ' \t\n ' ELSE event_data['path'] END")
    return _hits(t.ev_script(spark, d).withColumn("p", path), match("p", "is_null"))


@query("wildcard_to_regex", "SELECT host, record_id FROM ev_script WHERE regexp_matches(lower(script), "
       "'the.*and.a', 's') OR regexp_matches(lower(script), '^und.*\\.$', 's') AND NOT contains(script, '*')", "ev_script")
def wildcard_to_regex(spark, d):
    text = _value("scriptblocktext")
    star = F.contains(F.expr(text), F.lit("*"))
    return _hits(t.ev_script(spark, d), match(text, "contains", ["the*and?a"]) | (match(text, "exact", ["UND*."]) & ~star))


@query("windash_expand", "SELECT host, record_id, contains(command, '-k') OR contains(command, '/k') AS either, "
       "contains(command, '-k') AS plain FROM ev_security", "ev_security")
def windash_expand(spark, d):
    command = _value("commandline")
    return t.ev_security(spark, d).select(
        "host", "record_id", match(command, "contains", ["-k"], windash=True).alias("either"),
        match(command, "contains", ["-k"]).alias("plain"))


@query("ignore_case", "SELECT host, record_id, contains(lower(script), 'the') AS folded, contains(script, 'THE') AS exact "
       "FROM ev_script", "ev_script")
def ignore_case(spark, d):
    text = _value("scriptblocktext")
    return t.ev_script(spark, d).select(
        "host", "record_id", match(text, "contains", ["THE"]).alias("folded"),
        match(text, "contains", ["THE"], ignore_case=False).alias("exact"))


@query("match_any", "SELECT host, record_id FROM ev_process WHERE contains(lower(command), 'ing ') OR "
       "contains(lower(command), 'ung ')", "ev_process")
def match_any(spark, d):
    return _hits(t.ev_process(spark, d), match(_value("commandline"), "contains", ["ing ", "UNG "]))


@query("match_all", "SELECT host, record_id FROM ev_process WHERE contains(lower(command), 'the') AND "
       "contains(lower(command), 'ing')", "ev_process")
def match_all(spark, d):
    return _hits(t.ev_process(spark, d), match(_value("commandline"), "contains", ["THE", "ing"], match="all"))


@query("match_raw", "SELECT host, record_id FROM ev_security WHERE contains(lower(concat(message, chr(10), raw_xml)), "
       "'}' || chr(10) || '<event>') AND (contains(message, '\"k\": 42}') OR contains(raw_xml, '>4720<'))", "ev_security")
def match_raw(spark, d):
    def raw(*values):
        return {"type": "raw", "operator": "contains", "values": list(values), "ignore_case": True}

    return _tree(t.ev_security(spark, d), {"type": "all", "children": [raw("}\n<EVENT>"), raw('"k": 42}', ">4720<")]})


@query("field_project", "SELECT host, record_id, image AS \"Image\", command AS \"CommandLine\", usr AS \"User\", "
       "'4688' AS \"EventID\", 'Security' AS \"Channel\", provider AS \"Provider_Name\", '' AS \"ParentImage\" "
       "FROM ev_security WHERE event_id = 4688", "ev_security")
def field_projection(spark, d):
    source = next(s for s in SOURCES if s.id == "security_process_creation")
    fields = ["Image", "CommandLine", "User", "EventID", "Channel", "Provider_Name", "ParentImage"]
    events = t.ev_security(spark, d).filter(F.col("event_id") == 4688)
    return field_project(events, source, fields).select("host", "record_id", *fields)


@query("expr_all", "SELECT host, record_id FROM ev_process WHERE ends_with(lower(image), '\\user.exe') AND "
       "contains(lower(command), 'the')", "ev_process")
def expr_all(spark, d):
    return _tree(t.ev_process(spark, d), {"type": "all", "children": [
        _field("Image", "endswith", "\\user.exe"), _field("CommandLine", "contains", "the")]})


@query("expr_any", "SELECT host, record_id FROM ev_process WHERE ends_with(lower(image), '\\system.exe') OR "
       "contains(lower(command), 'the th')", "ev_process")
def expr_any(spark, d):
    return _tree(t.ev_process(spark, d), {"type": "any", "children": [
        _field("Image", "endswith", "\\SYSTEM.exe"), _field("CommandLine", "contains", "the th")]})


@query("expr_not", "SELECT host, record_id FROM ev_process WHERE NOT contains(lower(command), 'the')", "ev_process")
def expr_not(spark, d):
    missing = {"type": "not", "child": _field("ParentImage", "contains", "x")}
    return _tree(t.ev_process(spark, d), {"type": "all", "children": [
        missing, {"type": "not", "child": _field("CommandLine", "contains", "the")}]})


_ITEMS = {
    "selection_img": _field("Image", "endswith", "\\assistant.exe"),
    "selection_cmd": _field("CommandLine", "contains", "ing"),
    "filter_short": {"type": "not", "child": _field("CommandLine", "contains", "the")},
}


@query("expr_item_ref", "SELECT host, record_id FROM ev_process WHERE ends_with(image, '\\assistant.exe') AND "
       "contains(lower(command), 'the')", "ev_process")
def expr_item_ref(spark, d):
    unknown = {"type": "not", "child": {"type": "item_ref", "name": "no_such_item"}}
    return _tree(t.ev_process(spark, d), {"type": "all", "children": [
        {"type": "item_ref", "name": "SELECTION_IMG"}, {"type": "not", "child": {"type": "item_ref", "name": "filter_short"}},
        unknown]}, _ITEMS)


@query("expr_wildcard_ref", "SELECT host, record_id FROM ev_process WHERE (ends_with(image, '\\assistant.exe') OR "
       "contains(lower(command), 'ing')) AND NOT (ends_with(image, '\\assistant.exe') AND contains(lower(command), 'ing') "
       "AND NOT contains(lower(command), 'the'))", "ev_process")
def expr_wildcard_ref(spark, d):
    return _tree(t.ev_process(spark, d), {"type": "all", "children": [
        {"type": "wildcard_ref", "pattern": "selection_*", "mode": "any"},
        {"type": "not", "child": {"type": "wildcard_ref", "pattern": "them", "mode": "all"}},
        {"type": "not", "child": {"type": "wildcard_ref", "pattern": "nothing_*", "mode": "all"}}]}, _ITEMS)


@query("expr_inline_field", "SELECT host, record_id FROM ev_script WHERE contains(lower(script), 'mit license')", "ev_script")
def expr_inline_field(spark, d):
    return _tree(t.ev_script(spark, d), _field("ScriptBlockText", "contains", "MIT License"))


@query("rule_predicate", "SELECT host, record_id, (ends_with(image, '\\assistant.exe') OR contains(lower(command), 'ing')) AND "
       "contains(lower(command), 'the') AS fires FROM ev_process", "ev_process")
def rule_predicate(spark, d):
    rule = rule_from_dict({"title": "x", "items": _ITEMS, "condition": {"type": "all", "children": [
        {"type": "wildcard_ref", "pattern": "selection_*"}, {"type": "not", "child": {"type": "item_ref", "name": "filter_short"}}]}})
    fires = compile_rule(rule, lambda name: Views(_value(name)), lambda: Views(raw_sql()))
    return t.ev_process(spark, d).select("host", "record_id", F.expr(fires).alias("fires"))
