"""Rule tables, source selection and the detection scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetsift.operators import detect as det
from fleetsift.operators import ruleset as rs
from fleetsift.plans.rules import rule_from_dict, rules_from_df
from fleetsift.registry import tables as t
from fleetsift.registry.core import AS_OF, query, rulepack
from fleetsift.schemas import SOURCE_CATALOG, SYSMON, Source, sources_from_catalog
from fleetsift.session import scratch_dir
from fleetsift.sources.rule_files import load_rules

SCAN = {"as_of": AS_OF, "days_back": 11_000}
_RANK = ("CASE lower(level) WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 "
         "WHEN 'informational' THEN 1 ELSE 0 END")


@query("rules_enabled", "SELECT rule_id, title FROM rule_meta WHERE coalesce(enabled, true)", "rule_meta")
def rules_enabled(spark, d):
    return rs.rules_enabled(t.rule_meta(spark, d)).select("rule_id", "title")


@query("severity_rank", f"SELECT rule_id, {_RANK} AS rank FROM rule_meta", "rule_meta")
def severity_rank(spark, d):
    return t.rule_meta(spark, d).select("rule_id", rs.severity_rank(F.col("level")).alias("rank"))


@query("rules_min_level", f"SELECT rule_id, level FROM rule_meta WHERE {_RANK} >= 3", "rule_meta")
def rules_min_level(spark, d):
    return rs.rules_min_level(t.rule_meta(spark, d)).select("rule_id", "level")


@query("rule_set_summary", "SELECT count(*) FILTER (coalesce(enabled, true)) AS compiled_rule_count, "
       "count(*) FILTER (NOT coalesce(enabled, true)) AS skipped_rule_count FROM rule_meta", "rule_meta")
def rule_set_summary(spark, d):
    return rs.rule_set_summary(t.rule_meta(spark, d))


_PICK = {"include_logs": ["LOG_3", " log_5 ", "log_7", "", "log_11", "log_20"], "exclude_categories": ["CAT_1"]}
_PICKED = "log_name IN ('log_3', 'log_5', 'log_7', 'log_11', 'log_20') AND category <> 'cat_1'"


@query("select_sources", f"SELECT id, log_name, category FROM catalog WHERE {_PICKED}", "catalog")
def select_sources(spark, d):
    return rs.select_sources(t.catalog(spark, d), **_PICK)


@query("rules_for_sources", f"SELECT rule_id FROM rule_meta WHERE EXISTS (SELECT 1 FROM catalog WHERE {_PICKED} AND "
       "(lower(id) = lower(sources[1]) OR lower(id) = lower(sources[2])))", "rule_meta catalog")
def rules_for_sources(spark, d):
    chosen = rs.select_sources(t.catalog(spark, d), **_PICK)
    return rs.rules_for_sources(t.rule_meta(spark, d), chosen).select("rule_id")


@query("rules_by_source", f"SELECT s AS SourceId, count(*) AS rules, CAST(sum(CASE WHEN {_RANK} >= 4 THEN 1 ELSE 0 END) AS BIGINT) "
       f"AS severe_rules, CAST(max({_RANK}) AS BIGINT) AS top_rank FROM (SELECT *, unnest(sources) AS s FROM rule_meta) GROUP BY s",
       "rule_meta")
def rules_by_source(spark, d):
    return rs.rules_by_source(t.rule_meta(spark, d))


_EV = "ev_security ev_script ev_process ev_network"
_ALL = " UNION ALL ".join(f"SELECT {{0}} FROM {view}" for view in _EV.split())


@query("missing_log_skip", "SELECT id, log_name, category FROM catalog WHERE log_name NOT IN "
       f"(SELECT concat('log_', event_id % 25) FROM ({_ALL.format('event_id')}))", f"catalog {_EV}")
def missing_log_skip(spark, d):
    logs = t.event_log(spark, d).select(F.concat(F.lit("log_"), (F.col("event_id") % 25).cast("string")).alias("log_name"))
    return rs.missing_logs(t.catalog(spark, d), logs).select("id", "log_name", "category")


@query("event_filter", "SELECT host, record_id, event_id FROM ev_security WHERE event_id IN (4688, 4625) AND "
       "time_created >= TIMESTAMP '2024-01-11 00:00:00'", "ev_security")
def event_filter(spark, d):
    return det.event_filter(t.event_log(spark, d), "Security", [4688, 4625], AS_OF, 20).select("host", "record_id", "event_id")


@query("newest_n_per_source", "SELECT host, log_name, record_id FROM (SELECT *, row_number() OVER (PARTITION BY host, log_name "
       f"ORDER BY time_created DESC, record_id DESC) AS rn FROM ({_ALL.format('host, log_name, record_id, time_created')})) WHERE rn <= 20",
       _EV)
def newest_n_per_source(spark, d):
    return det.newest_n_per_source(t.event_log(spark, d), 20, ("host", "log_name")).select("host", "log_name", "record_id")


@query("scan_stats", """
SELECT 'security_process_creation' AS SourceId, CAST(sum(n) AS BIGINT) AS found, CAST(sum(least(n, 150)) AS BIGINT) AS scanned,
  max(n) >= 150 AS cap_reached FROM (SELECT host, count(*) AS n FROM ev_security WHERE event_id = 4688 GROUP BY host)
UNION ALL SELECT 'sysmon_process_creation', CAST(sum(n) AS BIGINT), CAST(sum(least(n, 150)) AS BIGINT), max(n) >= 150
  FROM (SELECT host, count(*) AS n FROM ev_process GROUP BY host)
UNION ALL SELECT 'powershell_script_block', CAST(sum(n) AS BIGINT), CAST(sum(least(n, 150)) AS BIGINT), max(n) >= 150
  FROM (SELECT host, count(*) AS n FROM ev_script GROUP BY host)
UNION ALL SELECT 'sysmon_network_connection', CAST(sum(n) AS BIGINT), CAST(sum(least(n, 150)) AS BIGINT), max(n) >= 150
  FROM (SELECT host, count(*) AS n FROM ev_network GROUP BY host)""", "ev_security ev_process ev_script ev_network")
def scan_stats(spark, d):
    plan = det.plan_scan(spark, rulepack())
    return det.scan_stats(t.event_log(spark, d), plan, max_events_per_source=150, **SCAN)


# One branch per rule and source: view, source id, user, command, process, file, title, level, tags, condition.
_SCRIPT = ("ev_script", "powershell_script_block", "'N/A'", "script", "'N/A'")
_PROC = ("ev_process", "sysmon_process_creation", "usr", "command", "image")
_SEC = ("ev_security", "security_process_creation", "usr", "command", "image")
_NET = ("ev_network", "sysmon_network_connection", "usr", "'N/A'", "image")
_BRANCHES = [
    (_SCRIPT, "license_notice", "License notice in script", "high", "attack.collection, attack.t1119",
     "contains(lower(script), 'apache license') OR contains(lower(script), 'mit license')"),
    (_SCRIPT, "token_assignment", "Token assigned in script", "critical", "attack.credential_access, attack.t1552.001",
     "contains(lower(script), 'token') AND contains(script, '=')"),
    (_PROC, "user_process", "User process with article", "medium", "attack.execution",
     "ends_with(lower(image), '\\user.exe') AND contains(lower(command), 'the')"),
    (_PROC, "bin_not_system", "Process from bin that is not the system one", "medium", "attack.defense_evasion, attack.t1036",
     "starts_with(lower(image), 'c:\\bin\\') AND NOT (ends_with(image, '\\system.exe') OR ends_with(image, '\\assistant.exe'))"),
    (_NET, "net_event", "Initiated connection of the R process", "high", "attack.command_and_control, attack.t1071",
     "initiated = 'true' AND ends_with(image, '\\powershell.exe')"),
    (_SCRIPT, "gnu_wildcard", "GNU license version", "medium", "attack.collection",
     "regexp_matches(lower(script), 'gnu.*version 3', 's')"),
    (_SCRIPT, "address_in_script", "Address in script", "critical", "attack.command_and_control, attack.t1095",
     "regexp_matches(script, '[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}')"),
    (_NET, "net_range", "Connection into a listed range", "high", "attack.exfiltration, attack.t1041",
     "ip1 = 10 OR (ip1 = 100 AND ip2 BETWEEN 16 AND 31)"),
    (_SEC, "dash_switch", "Switch with dash or slash", "medium", "attack.execution, attack.t1059",
     "contains(command, '-k') OR contains(command, '/k')"),
    (_SCRIPT, "selection_any", "Any selection", "medium", "attack.discovery",
     "contains(lower(script), 'pathetic') OR contains(lower(script), 'disgusting')"),
    (_SCRIPT, "them_all", "All of them", "high", "attack.discovery, attack.t1087",
     "contains(script, '555-') AND contains(lower(script), 'the')"),
    (_PROC, "nested_groups", "Nested groups", "medium", "attack.persistence",
     "(ends_with(image, '\\user.exe') AND starts_with(lower(command), 'than')) OR "
     "(ends_with(image, '\\assistant.exe') AND ends_with(lower(command), 'en.'))"),
    (_SEC, "no_parent", "Process creation without parent", "medium", "attack.execution",
     "contains(command, 'click {\"k\": 7')"),
    (_SEC, "raw_value", "Value in raw event", "high", "attack.impact", "contains(message, '\"k\": 42}')"),
    (_SCRIPT, "case_sensitive", "Capitalised license", "medium", "attack.collection", "contains(script, 'License')"),
]


# Only connections have repeated record ids; of equally new ones the payload in the order of its keys decides.
_TIES = {"ev_network": "[hostname, ip, image, initiated, usr]", "ev_security": "['']", "ev_script": "['']", "ev_process": "['']"}


def _finding_sql(branches) -> str:
    parts = []
    for (view, source, usr, command, process), name, title, level, tags, condition in branches:
        only = "event_id = 4688 AND " if view == "ev_security" else ""
        parts.append(
            f"SELECT host, '{source}' AS SourceId, record_id AS RecordId, '{title}' AS RuleTitle, '{level}' AS RuleLevel, "
            f"'{tags}' AS RuleTags, event_id AS EventId, log_name AS LogName, "
            f"strftime(time_created, '%Y-%m-%d %H:%M:%S') AS TimeCreated, {usr} AS \"User\", {command} AS CommandLine, "
            f"{process} AS Process, 'rules/own/{name}.json' AS RuleFile, {_TIES[view]} AS ties FROM {view} "
            f"WHERE {only}({condition})")
    return " UNION ALL ".join(parts)


_BEST = ("SELECT * EXCLUDE (rn, ties) FROM (SELECT *, row_number() OVER (PARTITION BY host, SourceId, RuleFile, RecordId "
         "ORDER BY TimeCreated DESC, ties DESC) AS rn FROM ({sql})) WHERE rn = 1")


def _plan(spark):
    return det.plan_scan(spark, rulepack())


@query("detect", _BEST.format(sql=_finding_sql(_BRANCHES)), _EV)
def detect(spark, d):
    return det.detect(t.event_log(spark, d), _plan(spark), **SCAN)


@query("dedup_findings", _BEST.format(sql=_finding_sql(_BRANCHES)).replace("ties DESC", "\"User\" DESC, CommandLine DESC, Process DESC"), _EV)
def dedup_findings(spark, d):
    found = det.detect(t.event_log(spark, d), _plan(spark), dedup=False, extra=["time_created"], **SCAN)
    return det.dedup_findings(found).drop("time_created")


@query("project_finding", "SELECT RuleTitle, RuleLevel, RuleTags, EventId, LogName, TimeCreated, \"User\", CommandLine, Process, "
       f"RuleFile FROM ({_finding_sql([b for b in _BRANCHES if b[0] in (_PROC, _SEC)])})", _EV)
def project_finding(spark, d):
    plan = det.plan_scan(spark, rulepack(), exclude_categories=["ps_script", "network_connection"])
    hits = det.detect_hits(t.event_log(spark, d), plan, **SCAN)
    return det.report_columns(det.project_finding(hits, plan))


@query("detect_newest", _BEST.format(sql="SELECT f.* FROM (" + _finding_sql([b for b in _BRANCHES if b[0] is _PROC]) + ") f JOIN "
       "(SELECT host, record_id FROM (SELECT host, record_id, row_number() OVER (PARTITION BY host ORDER BY time_created DESC, "
       "record_id DESC) AS rn FROM ev_process) WHERE rn <= 15) c ON f.host = c.host AND f.RecordId = c.record_id"), _EV)
def detect_newest(spark, d):
    plan = det.plan_scan(spark, rulepack(), include_logs=[SYSMON], include_categories=["process_creation"])
    return det.detect(t.event_log(spark, d), plan, max_events_per_source=15, **SCAN)


@query("tag_rollup", "SELECT tag, upper(regexp_extract(tag, '^attack\\.(t[0-9]{4}(?:\\.[0-9]{3})?)$', 1)) AS technique, "
       "CASE WHEN regexp_matches(tag, '^attack\\.t[0-9]{4}') THEN '' ELSE regexp_extract(tag, '^attack\\.(.+)$', 1) END AS tactic, "
       "count(*) AS findings FROM (SELECT unnest(string_split(RuleTags, ', ')) AS tag FROM "
       f"({_BEST.format(sql=_finding_sql(_BRANCHES))})) GROUP BY tag", _EV)
def tag_rollup(spark, d):
    return det.tag_rollup(det.scan_tags(t.event_log(spark, d), _plan(spark), **SCAN))


@query("rule_errors", "SELECT DISTINCT concat('src_', s_nationkey) AS SourceId, concat('rules/', s_nationkey, '-', s_acctbal < 0, '.json') "
       "AS RuleFile, 'near' AS RuleTitle FROM supplier WHERE s_acctbal < 0")
def rule_errors(spark, d):
    c, bad = F.col, F.col("s_acctbal") < 0
    kinds = t.table(spark, d, "supplier").select("s_nationkey", bad.alias("bad")).distinct()
    operator = F.when(c("bad"), "near").otherwise("contains")
    nation = c("s_nationkey").cast("string")
    meta = kinds.select(
        nation.alias("rule_id"), operator.alias("title"), F.lit("high").alias("level"), F.lit("").alias("status"), F.lit("").alias("category"),
        F.concat(F.lit("rules/"), nation, F.lit("-"), c("bad").cast("string"), F.lit(".json")).alias("rule_file"),
        F.lit(True).alias("enabled"), F.array().cast("array<string>").alias("tags"),
        F.array(F.concat(F.lit("src_"), nation)).alias("sources"), F.lit("{}").alias("items_json"),
        F.to_json(F.struct(F.lit("field").alias("type"), F.lit("x").alias("field"), operator.alias("operator"),
                           F.array(F.lit("a")).alias("values"))).alias("condition_json"))
    rules = rules_from_df(meta)
    sources = [Source(s, "log", "c", (1,), {"x": ("eventdata", "x")}) for s in sorted({r.sources[0] for r in rules})]
    return det.rule_errors(spark, det.plan_scan(spark, rules, sources)).select("SourceId", "RuleFile", "RuleTitle")


@query("user_rules", "SELECT w AS RuleTitle, count(*) AS findings FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part) "
       "JOIN documents ON contains(lower(text), w) GROUP BY w")
def user_rules(spark, d):
    words = t.table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("title")).distinct()
    item = F.struct(F.lit("field").alias("type"), F.lit("ScriptBlockText").alias("field"), F.lit("contains").alias("operator"),
                    F.array("title").alias("values"), F.lit(True).alias("ignore_case"))
    docs = words.select(
        "title", F.concat(F.lit("rules/"), F.col("title")).alias("rule_file"),
        F.lit("high").alias("level"), F.array(F.lit("powershell_script_block")).alias("sources"),
        F.struct(item.alias("word")).alias("items"),
        F.struct(F.lit("item_ref").alias("type"), F.lit("word").alias("name")).alias("condition"))
    folder = scratch_dir(spark, "rules")
    docs.write.option("maxRecordsPerFile", 1).json(folder)
    plan = det.plan_scan(spark, load_rules(spark, folder))
    return det.detect(t.ev_script(spark, d), plan, **SCAN).groupBy("RuleTitle").agg(F.count(F.lit(1)).alias("findings"))


@query("user_sources", "SELECT host, record_id AS RecordId, 'Logon seen' AS RuleTitle FROM ev_security WHERE event_id IN (4624, 4625) "
       "AND starts_with(image, 'C:\\app\\e')", "ev_security")
def user_sources(spark, d):
    rows = [("own_logons", "Security", "logon", [4624, 4625], {"Program": ("eventdata", "NewProcessName")})]
    sources = sources_from_catalog(spark.createDataFrame(rows, SOURCE_CATALOG))
    rule = rule_from_dict({"title": "Logon seen", "rule_file": "logon.json", "level": "low", "sources": ["OWN_logons"], "condition": {
        "type": "field", "field": "program", "operator": "startswith", "values": ["c:\\APP\\e"]}})
    plan = det.plan_scan(spark, [rule], sources, min_level="informational")
    return det.detect(t.event_log(spark, d), plan, **SCAN).select("host", "RecordId", "RuleTitle")
