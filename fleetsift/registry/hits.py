"""Hash and indicator hits as findings, and the report over all three sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetsift.operators import ioc
from fleetsift.operators import report as rep
from fleetsift.registry import rules
from fleetsift.registry import tables as t
from fleetsift.registry.core import query

_HASH_SQL = """
SELECT host, 'hash' AS SourceId, record_id AS RecordId, concat('Listed hash: ', md5(command)) AS RuleTitle, 'critical' AS RuleLevel, '' AS RuleTags,
  event_id AS EventId, log_name AS LogName, strftime(time_created, '%Y-%m-%d %H:%M:%S') AS TimeCreated, usr AS "User", command AS CommandLine,
  image AS Process, 'N/A' AS RuleFile
FROM ev_process WHERE md5(command) IN (SELECT md5(text) FROM conversations WHERE role = 'system')"""
_IOC_SQL = """
SELECT host, 'network' AS SourceId, record_id AS RecordId, concat('Listed destination: ', indicator) AS RuleTitle, 'high' AS RuleLevel, '' AS RuleTags,
  event_id AS EventId, log_name AS LogName, strftime(time_created, '%Y-%m-%d %H:%M:%S') AS TimeCreated, usr AS "User", 'N/A' AS CommandLine,
  image AS Process, 'N/A' AS RuleFile
FROM ev_network JOIN (SELECT DISTINCT indicator, kind FROM iocs WHERE list = 'custom') i ON (kind = 'ip' AND ip = indicator)
  OR (kind = 'domain' AND (hostname = indicator OR ends_with(hostname, concat('.', indicator))))
WHERE initiated = 'true' AND NOT ends_with(image, 'chrome.exe')
UNION ALL
SELECT NULL, 'browser', page_id, concat('Listed address: ', indicator), 'high', '', NULL, 'N/A', 'N/A', 'N/A', url, 'N/A', 'N/A' FROM history JOIN
  (SELECT DISTINCT indicator, kind FROM iocs WHERE kind = 'url' OR list = 'custom' AND kind = 'domain') j
  ON (kind = 'url' AND lower(url) = indicator)
  OR (kind = 'domain' AND (host_name = indicator OR ends_with(host_name, concat('.', indicator))))"""


def _event(**more):
    when = F.date_format("time_created", "yyyy-MM-dd HH:mm:ss")
    return {"host": F.col("host"), "RecordId": F.col("record_id"), "EventId": F.col("event_id"), "LogName": F.col("log_name"),
            "TimeCreated": when, "User": F.col("User"), "Process": F.col("Image"), **more}


@query("hash_hit_findings", _HASH_SQL, "ev_process")
def hash_hit_findings(spark, d):
    data = F.col("event_data")
    events = t.ev_process(spark, d).select(
        "host", "record_id", "event_id", "log_name", "time_created", data["user"].alias("User"), data["image"].alias("Image"),
        data["commandline"].alias("CommandLine"), data["hashes"].alias("Hashes"))
    bad = t.table(spark, d, "conversations").filter("role = 'system'").select(F.md5("text").alias("hash"))
    return ioc.hit_findings(ioc.hash_match(ioc.hash_extract(events), bad), "Listed hash", "critical", "hash", "hash",
                            **_event(CommandLine=F.col("CommandLine")))


@query("ioc_hit_findings", _IOC_SQL, "ev_network iocs history")
def ioc_hit_findings(spark, d):
    data, listed = F.col("event_data"), t.iocs(spark, d)
    events = t.ev_network(spark, d).select(
        "host", "record_id", "event_id", "log_name", "time_created", data["user"].alias("User"), data["image"].alias("Image"),
        data["destinationip"].alias("DestinationIp"), data["destinationhostname"].alias("DestinationHostname"),
        data["initiated"].alias("Initiated"))
    network = ioc.hit_findings(ioc.ioc_network(events, listed), "Listed destination", "high", "network", "indicator", **_event())
    browser = ioc.hit_findings(ioc.ioc_feed_url_only(t.history(spark, d), listed), "Listed address", "high", "browser", "indicator",
                               RecordId=F.col("page_id"), CommandLine=F.col("url"))
    return network.unionByName(browser)


def _sets(spark, d):
    return rules.detect(spark, d), hash_hit_findings(spark, d), ioc_hit_findings(spark, d)


_VIEWS = f"{rules._EV} iocs history"
_SETS = (f"SELECT RuleLevel, 'rule' AS kind FROM ({rules._BEST.format(sql=rules._finding_sql(rules._BRANCHES))}) UNION ALL "
         f"SELECT RuleLevel, 'hash' FROM ({_HASH_SQL}) UNION ALL SELECT RuleLevel, 'ioc' FROM ({_IOC_SQL})")


@query("scan_kpis", "SELECT count(*) AS total, count(*) FILTER (RuleLevel = 'critical' AND kind <> 'ioc') AS critical, count(*) FILTER (kind = 'rule') "
       f"AS rule_hits, count(*) FILTER (kind = 'hash') AS hash_hits, count(*) FILTER (kind = 'ioc') AS ioc_hits FROM ({_SETS})", _VIEWS)
def scan_kpis(spark, d):
    return rep.overview_kpis(*_sets(spark, d))


@query("scan_severity", f"SELECT concat(upper(RuleLevel[1]), RuleLevel[2:]) AS label, count(*) AS n FROM ({_SETS}) GROUP BY 1", _VIEWS)
def scan_severity(spark, d):
    return rep.severity_distribution(*_sets(spark, d))
