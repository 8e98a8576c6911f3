"""Triage report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetsift.functions.addresses import is_external
from fleetsift.operators import report as rep
from fleetsift.registry import tables as t
from fleetsift.registry.core import query

_LEVEL = "lower(CASE WHEN coalesce(RuleLevel, '') = '' THEN 'informational' ELSE RuleLevel END)"


@query("level_facets", "SELECT 'all' AS level, count(*) AS findings FROM findings UNION ALL SELECT l, (SELECT count(*) FROM findings "
       f"WHERE {_LEVEL} = l) FROM (VALUES ('critical'), ('high'), ('medium'), ('low'), ('informational')) AS v(l)", "findings")
def level_facets(spark, d):
    return rep.level_facets(t.findings(spark, d))


@query("level_filter", f"SELECT record_id, RuleLevel FROM findings WHERE {_LEVEL} = 'informational'", "findings")
def level_filter(spark, d):
    return rep.level_filter(t.findings(spark, d), "informational").select("record_id", "RuleLevel")


@query("finding_search", f"SELECT record_id FROM findings WHERE {_LEVEL} = 'high' AND contains(lower(concat(RuleTitle, ' ', \"User\", ' ', "
       "Process, ' ', coalesce(CommandLine, ''), ' ', RuleTags, ' ', EventId)), 'run 1')", "findings")
def finding_search(spark, d):
    return rep.finding_search(t.findings(spark, d), "RUN 1", "high").select("record_id")


@query("event_search", "SELECT \"Time\", EventId, \"User\", Message FROM events_view WHERE Category = 'click' AND contains(lower(concat(EventId, ' ', "
       "\"User\", ' ', Category, ' ', Message)), '8 user1')", "events_view")
def event_search(spark, d):
    return rep.event_search(t.events_view(spark, d), "8 USER1", "click").select("Time", "EventId", "User", "Message")


@query("table_search", "SELECT p_partkey FROM part WHERE contains(lower(concat(p_name, ' ', p_brand, ' ', p_size)), 'ring brand#1')")
def table_search(spark, d):
    return rep.table_search(t.table(spark, d, "part"), ["p_name", "p_brand", "p_size"], "Ring BRAND#1").select("p_partkey")


@query("category_facets", "SELECT Category, count(*) AS events FROM events_view GROUP BY Category", "events_view")
def category_facets(spark, d):
    return rep.category_facets(t.events_view(spark, d))


@query("event_id_counts", "SELECT concat('EID ', EventId) AS label, count(*) AS n FROM events_view GROUP BY EventId", "events_view")
def event_id_counts(spark, d):
    return rep.event_id_counts(t.events_view(spark, d))


_MAP = "(VALUES " + ", ".join(f"('{label}', {eid}, {len(ids)})" for label, ids in rep.EVENT_CATEGORIES.items() for eid in ids) + \
    ") AS m(label, eid, ids)"


@query("event_categories", f"SELECT label, count(*) AS n FROM ev_security JOIN {_MAP} ON event_id = eid GROUP BY label", "ev_security")
def event_categories(spark, d):
    return rep.event_categories(t.event_log(spark, d))


@query("event_id_allocation", f"SELECT concat('EID ', m2.eid) AS label, CAST(sum(n // m2.ids) AS BIGINT) AS n FROM (SELECT label, count(*) AS n "
       f"FROM ev_security JOIN {_MAP} ON event_id = eid GROUP BY label) c JOIN {_MAP.replace('AS m(', 'AS m2(')} ON c.label = m2.label "
       "GROUP BY m2.eid", "ev_security")
def event_id_allocation(spark, d):
    return rep.event_id_allocation(rep.event_categories(t.event_log(spark, d)))


@query("top8_bars", "SELECT label, n, CAST(floor(n / greatest(max(n) OVER (), 1) * 100 + 0.5) AS BIGINT) AS pct FROM (SELECT \"User\" AS label, "
       "count(*) AS n FROM events_view GROUP BY \"User\" ORDER BY n DESC, label LIMIT 8)", "events_view")
def top8_bars(spark, d):
    counts = t.events_view(spark, d).groupBy(F.col("User").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return rep.top_bars(counts)


_SETS = ("SELECT RuleLevel, 'rule' AS kind FROM findings UNION ALL SELECT RuleLevel, 'hash' FROM hash_findings UNION ALL "
         "SELECT RuleLevel, 'ioc' FROM ioc_findings")


@query("overview_kpis", "SELECT count(*) AS total, count(*) FILTER (lower(RuleLevel) = 'critical' AND kind <> 'ioc') AS critical, "
       "count(*) FILTER (kind = 'rule') AS rule_hits, count(*) FILTER (kind = 'hash') AS hash_hits, count(*) FILTER (kind = 'ioc') AS ioc_hits "
       f"FROM ({_SETS})", "findings hash_findings ioc_findings")
def overview_kpis(spark, d):
    return rep.overview_kpis(t.findings(spark, d), t.hash_findings(spark, d), t.ioc_findings(spark, d))


@query("severity_distribution", "SELECT concat(upper(substr(l, 1, 1)), substr(l, 2)) AS label, count(*) AS n FROM "
       f"(SELECT coalesce(RuleLevel, 'informational') AS l FROM ({_SETS})) GROUP BY 1", "findings hash_findings ioc_findings")
def severity_distribution(spark, d):
    return rep.severity_distribution(t.findings(spark, d), t.hash_findings(spark, d), t.ioc_findings(spark, d))


_EXTERNAL = ("NOT (starts_with(remote_addr, '10.') OR starts_with(remote_addr, '127.') OR starts_with(remote_addr, '192.168.') OR "
             "starts_with(remote_addr, '169.254.') OR regexp_matches(remote_addr, '^172\\.(1[6-9]|2[0-9]|3[0-1])\\.'))")


@query("external_ip", f"SELECT remote_addr, {_EXTERNAL} AS external FROM connections", "connections")
def external_ip(spark, d):
    return t.connections(spark, d).select("remote_addr", is_external(F.col("remote_addr")).alias("external"))


@query("network_cards", "SELECT count(*) FILTER (state = 'Established') AS established, count(*) FILTER (state = 'LISTEN') AS listening, "
       f"count(*) FILTER ({_EXTERNAL}) AS external FROM connections", "connections")
def network_cards(spark, d):
    return rep.network_cards(t.connections(spark, d))


_ARTIFACTS = ["customer", "supplier", "part", "orders", "events", "documents"]


@query("artifact_counts", " UNION ALL ".join(f"SELECT '{n}' AS artifact, count(*) AS rows FROM {n}" for n in _ARTIFACTS))
def artifact_counts(spark, d):
    return rep.artifact_counts({name: t.table(spark, d, name) for name in _ARTIFACTS})


@query("page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET "
       "(SELECT CAST(least(39, greatest(ceil(count(*) / 50), 1) - 1) * 50 AS BIGINT) FROM orders)")
def page(spark, d):
    return rep.page(t.table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["-o_totalprice", "o_orderkey"], 40, 50)


@query("page_last", "SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 250 OFFSET "
       "(SELECT (greatest(ceil(count(*) / 250), 1) - 1) * 250 FROM part)")
def page_last(spark, d):
    return rep.page(t.table(spark, d, "part").select("p_partkey", "p_name"), ["p_name", "p_partkey"], 10**9, 250)


@query("page_deep", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice, l_orderkey DESC, "
       "l_linenumber, l_partkey LIMIT 100 OFFSET (SELECT CAST(least(300, greatest(ceil(count(*) / 100), 1) - 1) * 100 AS BIGINT) FROM lineitem)")
def page_deep(spark, d):
    rows = t.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return rep.page(rows, ["l_extendedprice", "-l_orderkey", "l_linenumber", "l_partkey"], 301, 100, deep=10_000)


@query("page_info", "SELECT count(*) AS rows, CAST(greatest(ceil(count(*) / 25), 1) AS BIGINT) AS pages FROM orders")
def page_info(spark, d):
    return rep.page_info(t.table(spark, d, "orders"))
