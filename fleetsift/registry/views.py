"""The views of ``tables.py`` as DuckDB SQL."""

CAPTURE_NAMES = [
    "ps", "services", "systemctl", "cron", "p1", "p2", "p3", "p4", "p5", "p6", "p7", "p8", "p9", "bashrc", "hosts", "lsof",
]
LOG_NAMES = ["auth.log", "syslog", "kern.log", "messages", "other.log"]


def _list(names: list[str]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


_EVENT_ID = (
    "CASE event_type WHEN 'click' THEN 4688 WHEN 'view' THEN 4624 WHEN 'error' THEN 4625 WHEN 'signup' THEN 4720 "
    "ELSE 4663 END"
)
VIEWS = {
    "ev_security": rf"""
SELECT concat('host-', user_id % 10) AS host, 'Security' AS log_name, 'Microsoft-Windows-Security-Auditing' AS provider,
  CAST({_EVENT_ID} AS INTEGER) AS event_id, event_id AS record_id, ts AS time_created,
  concat('user', user_id) AS usr, concat('C:\app\', event_type, '.exe') AS image,
  concat(event_type, CASE event_id % 3 WHEN 0 THEN ' -k ' WHEN 1 THEN ' /k ' ELSE ' ' END, props) AS command,
  props AS message,
  concat('<Event><System><Provider Name="Microsoft-Windows-Security-Auditing"/><EventID>', {_EVENT_ID},
    '</EventID><Channel>Security</Channel><EventRecordID>', event_id, '</EventRecordID><Computer>host-', user_id % 10,
    '</Computer></System><EventData><Data Name="SubjectUserName">user', user_id, '</Data><Data Name="NewProcessName">C:\app\',
    event_type, '.exe</Data><Data>unnamed</Data><Data Name="CommandLine">first</Data><Data Name="CommandLine">', event_type,
    CASE event_id % 3 WHEN 0 THEN ' -k ' WHEN 1 THEN ' /k ' ELSE ' ' END, props, '</Data></EventData></Event>') AS raw_xml
FROM events""",
    "ev_script": """
SELECT concat('host-', doc_id % 10) AS host, 'Microsoft-Windows-PowerShell/Operational' AS log_name,
  'Microsoft-Windows-PowerShell' AS provider, 4104 AS event_id, doc_id AS record_id,
  TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS time_created, text AS script, source AS path
FROM documents""",
    "ev_process": r"""
SELECT concat('host-', conv_id % 10) AS host, 'Microsoft-Windows-Sysmon/Operational' AS log_name,
  'Microsoft-Windows-Sysmon' AS provider, 1 AS event_id, conv_id * 1000 + turn AS record_id,
  TIMESTAMP '2024-01-01' + to_minutes(conv_id) AS time_created, concat('user', conv_id % 50) AS usr,
  concat('C:\bin\', role, '.exe') AS image, text AS command,
  concat('MD5=', upper(md5(text)), ',SHA256=', upper(sha256(text))) AS hashes
FROM conversations""",
    "ev_network": r"""
SELECT concat('host-', l_orderkey % 10) AS host, 'Microsoft-Windows-Sysmon/Operational' AS log_name,
  'Microsoft-Windows-Sysmon' AS provider, 3 AS event_id, l_orderkey * 10 + l_linenumber AS record_id,
  l_shipdate AS time_created, concat('user', l_orderkey % 150) AS usr,
  concat('C:\net\', CASE l_returnflag WHEN 'A' THEN 'chrome' WHEN 'N' THEN 'svchost' ELSE 'powershell' END, '.exe') AS image,
  concat(l_partkey % 256, '.', l_suppkey % 256, '.', l_linenumber, '.', CAST(l_quantity AS INTEGER)) AS ip,
  concat('h', l_partkey % 100, '.net', l_suppkey % 50, '.example.org') AS hostname,
  CASE l_linestatus WHEN 'F' THEN 'true' ELSE 'false' END AS initiated,
  l_partkey % 256 AS ip1, l_suppkey % 256 AS ip2
FROM lineitem""",
    "captures": f"""
SELECT concat('host-', doc_id % 10) AS host, {_list(CAPTURE_NAMES)}[1 + doc_id % 16] AS capture,
  generate_subscripts(string_split(text, chr(10)), 1) AS line_no, unnest(string_split(text, chr(10))) AS line
FROM documents""",
    "connections": """
SELECT concat('host-', l_orderkey % 10) AS host,
  concat(l_partkey % 256, '.', l_suppkey % 256, '.', l_linenumber, '.', CAST(l_quantity AS INTEGER)) AS remote_addr,
  CASE l_returnflag WHEN 'A' THEN 'Established' WHEN 'N' THEN 'LISTEN' ELSE 'time_wait' END AS state
FROM lineitem""",
    "findings": """
SELECT concat('Order ', o_orderpriority) AS RuleTitle,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'High' WHEN '3-MEDIUM' THEN 'medium'
    WHEN '4-NOT SPECIFIED' THEN NULL ELSE CASE o_orderstatus WHEN 'P' THEN 'strange' ELSE 'LOW' END END AS RuleLevel,
  concat('attack.t1', o_custkey % 1000) AS RuleTags, CAST(4600 + o_orderkey % 30 AS INTEGER) AS EventId,
  concat('user', o_custkey) AS "User", o_orderstatus AS Process,
  CASE o_orderkey % 4 WHEN 0 THEN NULL ELSE concat('run ', o_orderkey) END AS CommandLine, o_orderkey AS record_id
FROM orders""",
    "hash_findings": "SELECT CASE WHEN c_acctbal < 0 THEN 'CRITICAL' ELSE 'high' END AS RuleLevel FROM customer",
    "ioc_findings": "SELECT CASE WHEN s_acctbal < 0 THEN 'critical' ELSE NULL END AS RuleLevel FROM supplier",
    "events_view": f"""
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS "Time", CAST({_EVENT_ID} AS INTEGER) AS EventId, event_type AS Category,
  concat('user', user_id) AS "User", concat('host-', user_id % 10) AS Computer, props AS Message
FROM events""",
    "log_lines": f"""
SELECT event_id, {_list(LOG_NAMES)}[1 + user_id % 5] AS file, ts,
  concat(strftime(ts, '%Y-%m-%d %H:%M:%S'), ' ', event_type, ' ', props) AS line
FROM events""",
    "audit": """
SELECT event_id, ts, concat('host-', user_id % 10) AS host, CASE WHEN user_id % 20 = 0 THEN 'Guest' ELSE concat('user', user_id) END AS "user",
  CASE event_type WHEN 'view' THEN 'lo' ELSE 'fw' END AS class, concat(event_type, ' ', props) AS line
FROM events""",
    "accounts": """
SELECT CASE WHEN c_custkey % 100 = 0 THEN 'Shared' WHEN c_custkey % 100 = 1 THEN 'Guest'
  ELSE concat('user', c_custkey) END AS "user", concat('host-', c_nationkey) AS host
FROM customer""",
    "visits": """
SELECT concat('host-', user_id % 10) AS host, event_id % (SELECT count(*) FROM pages) AS place_id, ts AS visit_time,
  CASE event_id % 5 WHEN 0 THEN 'System Profile' WHEN 1 THEN 'Default' ELSE 'Profile 2' END AS profile
FROM events""",
    "places": "SELECT page_id AS id, url, concat('page ', page_id) AS title FROM pages",
    "history": """
SELECT page_id, url, lower(regexp_extract(url, '://([^/:?#]+)', 1)) AS host_name, concat('page ', page_id) AS title
FROM pages""",
    "iocs": """
SELECT CASE WHEN contains(url, 'utm_source') THEN lower(url) ELSE concat(lower(url), '?gone=1') END AS indicator, 'url' AS kind,
  CASE page_id % 2 WHEN 0 THEN 'custom' ELSE 'feed' END AS list FROM pages
UNION SELECT 'cheap-pills.example.com', 'domain', 'custom'
UNION SELECT 'tionsh.example.net', 'domain', 'custom'
UNION SELECT 'ththan.example.net', 'domain', 'feed'
UNION SELECT 'www.cheap-pills.example.com', 'domain', 'custom'
UNION SELECT 'net7.example.org', 'domain', 'custom'
UNION SELECT 'net8.example.org', 'domain', 'feed'
UNION SELECT DISTINCT concat(l_partkey % 256, '.', l_suppkey % 256, '.1.50'), 'ip', 'custom' FROM lineitem""",
    "files": """
SELECT concat('host-', page_id % 10) AS host, url AS path, length(html) AS size,
  TIMESTAMP '2024-01-01' + to_hours(page_id) AS mtime
FROM pages""",
    "rule_meta": """
SELECT concat('r', p_partkey) AS rule_id, p_name AS title,
  CASE p_size % 6 WHEN 0 THEN 'critical' WHEN 1 THEN 'High' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'low'
    WHEN 4 THEN 'informational' ELSE 'extreme' END AS level,
  CASE p_partkey % 7 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END AS enabled,
  [concat('src_', p_partkey % 100), concat('SRC_', 200 + p_size)] AS sources
FROM part""",
    "catalog": """
SELECT concat('src_', s_suppkey) AS id, concat('log_', s_nationkey) AS log_name, concat('cat_', s_suppkey % 4) AS category
FROM supplier""",
}
