"""Parsers of captured text.

Lines are composed from table columns and parsed back, so the SQL is the columns they were composed from. A composed
field is written once, as an expression that means the same in Spark and DuckDB.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetsift.operators import snapshots as snap
from fleetsift.registry import tables as t
from fleetsift.registry.core import query

HOST = "concat('host-', {key} % 10)"
WORD = "replace(p_name, ' ', '_')"


def _composed(spark, d, table, key, line, capture):
    return t.table(spark, d, table).selectExpr(
        f"{HOST.format(key=key)} AS host", f"{capture} AS capture", f"{key} + 1 AS line_no", f"{line} AS line")


def _parser(name, fields, parse, table="part", key="p_partkey", sep=" ", line=None, skip=0, where="true", capture="'text'",
            extra=None):
    """Register a parser. ``fields`` maps output columns to the expressions that the line is joined from."""
    line = line or f"concat_ws('{sep}', " + ", ".join(fields.values()) + ")"
    out = {**fields, **(extra or {})}
    sql = (
        f"SELECT {HOST.format(key=key)} AS host, {key} + 1 AS line_no, "
        + ", ".join(f"CAST({expr} AS VARCHAR) AS \"{column}\"" for column, expr in out.items())
        + f" FROM {table} WHERE {key} + 1 > {skip} AND ({where})"
    )

    @query(name, sql)
    def run(spark, d):
        return parse(_composed(spark, d, table, key, line, capture)).select("host", "line_no", *out)

    return run


def _layout(name):
    return lambda captures: snap.parse_capture(captures, name)


_parser("parse_route", {"destination": "concat(p_partkey % 256, '.0.0.0/8')", "gateway": "concat('10.0.', p_size, '.1')",
                        "iface": "concat('eth', p_partkey % 4)"}, _layout("route"),
        line="concat('  ', p_partkey % 256, '.0.0.0/8  via 10.0.', p_size, '.1 dev   eth', p_partkey % 4, ' proto static')")
_parser("parse_ps", {"user": "concat('u', p_partkey % 7)", "pid": "p_partkey", "cpu": "p_size", "mem": "concat(p_size, '.5')",
                     "vsz": "p_partkey * 10", "rss": "p_partkey * 3", "tty": "'?'", "stat": "'Ss'", "start": "'10:01'",
                     "time": "'0:00'", "command": "concat('/usr/bin/', p_name, ' --brand ', p_brand)"}, _layout("ps"), skip=1)
_parser("parse_ss", {"state": "'ESTAB'", "recv_q": "p_size", "send_q": "0", "local": "concat('10.0.0.', p_size, ':', p_partkey)",
                     "peer": "concat('[fe80::', p_size, ']:443')", "process": "concat('users:((\"', p_name, '\",pid=', p_partkey, '))')"},
        snap.parse_ss, skip=1, extra={"local_addr": "concat('10.0.0.', p_size)", "local_port": "p_partkey",
                                      "remote_addr": "concat('[fe80::', p_size, ']')", "remote_port": "443"})
_parser("parse_iptables", {"chain": "concat('-A', p_size)", "rule": "concat('INPUT -s ', p_name, ' -j DROP')"}, _layout("iptables"))
_parser("parse_hosts", {"ip": "concat('10.0.', p_size, '.', p_partkey % 256)", "hostname": WORD}, _layout("hosts"),
        line=f"concat('10.0.', p_size, '.', p_partkey % 256, chr(9), {WORD}, ' alias')")
_parser("parse_w", {"user": "concat('u', p_partkey % 7)", "tty": "concat('pts/', p_size)", "from": "'10.0.0.1'", "login": "'09:10'",
                    "idle": "'1:00'", "jcpu": "'0.05s'", "pcpu": "'0.01s'", "what": "concat('-bash ', p_name)"}, _layout("w"), skip=2)
_PASSWD = {"username": "c_name", "password": "'x'", "uid": "c_custkey", "gid": "c_nationkey", "full_name": "concat(c_mktsegment, ' user')",
           "home": "concat('/home/', c_name)", "shell": "CASE c_nationkey % 3 WHEN 0 THEN '/bin/bash' WHEN 1 THEN '/usr/sbin/nologin' ELSE '' END"}
_parser("parse_passwd", _PASSWD, _layout("passwd"), "customer", "c_custkey", sep=":")
_parser("login_shell_users", _PASSWD, snap.login_shell_users, "customer", "c_custkey", sep=":", where="c_nationkey % 3 = 0")
_parser("parse_key_value", {"property": "concat('Key ', p_partkey)", "value": "concat(p_name, ': ', p_brand)"}, snap.parse_key_value,
        line="concat('  Key ', p_partkey, ':    ', p_name, ': ', p_brand, '  ')")
_parser("parse_lsblk", {"name": "concat('sd', p_partkey)", "maj_min": "concat('8:', p_size)", "rm": "0", "size": "concat(p_size, 'G')",
                        "ro": "0", "type": "'disk'", "mountpoint": "CASE p_size % 2 WHEN 0 THEN '/mnt/x y' ELSE '' END"}, _layout("lsblk"))
_parser("parse_lsusb", {"bus": "p_size", "device": "concat(p_partkey, ':')", "id": "concat('1d6b:', p_partkey)",
                        "description": "concat('ID 1d6b:', p_partkey, ' ', p_name)"}, snap.parse_lsusb,
        line="concat(CASE p_size % 2 WHEN 0 THEN 'Bus ' ELSE '  port ' END, p_size, ' Device ', p_partkey, ': ID 1d6b:', p_partkey, ' ', p_name)",
        where="p_size % 2 = 0")
_parser("parse_unit_files", {"unit": f"concat({WORD}, '.service')", "state": "'enabled'"}, _layout("unit_files"),
        line=f"concat({WORD}, '.service      enabled   enabled')")
_parser("parse_timers", {"next": "'Mon 2024-01-01'", "left": "concat(p_size, 'h')", "last": "'Sun 2023-12-31'",
                         "unit": "concat(p_partkey, '.timer')", "timer": "concat(p_partkey, '.service')"}, _layout("timers"))
_parser("parse_cron", {"user": "c_name", "crontab": "concat('*/5 * * * * run:', c_custkey)"}, _layout("cron"), "customer", "c_custkey", sep=":")
_parser("parse_last", {"user": "c_name", "tty": "concat('pts/', c_nationkey)", "from": "'10.0.0.1'", "login": "concat('Mon Jan 1 10:00:', c_nationkey, ' 2024')",
                       "logout": "concat('- Mon Jan 1 11:00:', c_nationkey)", "duration": "'2024'", "host_name": "'(01:00)'",
                       "ip": "concat('10.1.1.', c_nationkey)"}, _layout("last"), "customer", "c_custkey")
_parser("parse_lsmod", {"module": WORD, "size": "p_partkey", "used_by": "p_size"}, _layout("lsmod"), skip=1)
_parser("parse_ls", {"permissions": "'-rwxr-xr-x'", "links": "1", "owner": "concat('o', p_partkey % 5)", "group": "'root'", "size": "p_size",
                     "month": "'Jan'", "day": "p_size % 28 + 1", "time": "'10:00'", "name": "concat('/etc/cron.d/', p_name)"}, _layout("ls"))


@query("parse_lines", "SELECT host, capture, line_no, line AS content FROM captures WHERE capture IN ('hosts', 'lsof', 'bashrc')", "captures")
def parse_lines(spark, d):
    return snap.parse_lines(t.captures(spark, d), ["hosts", "lsof", "bashrc"])


@query("parse_indent", "SELECT concat('host-', p_partkey % 10) AS host, p_partkey + 1 AS line_no, CAST(p_size % 9 // 2 AS BIGINT) AS level, "
       "concat(repeat(' ', p_size % 9), p_name) AS content FROM part")
def parse_indent(spark, d):
    return snap.parse_indent(_composed(spark, d, "part", "p_partkey", "concat(repeat(' ', p_size % 9), p_name)", "'lshw'"))


@query("sudo_group", "SELECT concat('host-', c_custkey % 10) AS host, c_custkey + 1 AS line_no, "
       "unnest([concat('a', c_custkey), c_name]) AS member FROM customer WHERE c_nationkey % 2 = 0")
def sudo_group(spark, d):
    line = "concat(CASE c_nationkey % 2 WHEN 0 THEN 'sudo' ELSE 'sudoers' END, ':x:27:a', c_custkey, ',', c_name)"
    return snap.sudo_group(_composed(spark, d, "customer", "c_custkey", line, "'group'")).select("host", "line_no", "member")


@query("parse_getcap", "SELECT concat('host-', p_partkey % 10) AS host, p_partkey + 1 AS line_no, '/usr/bin/' AS root, "
       "concat('/usr/bin/', p_partkey) AS file, 'cap_net_raw=ep extra' AS capabilities FROM part UNION ALL "
       "SELECT concat('host-', s_suppkey % 10), s_suppkey + 1, '/', s_name, 'cap_setuid=ep' FROM supplier")
def parse_getcap(spark, d):
    first = _composed(spark, d, "part", "p_partkey", "concat('/usr/bin/', p_partkey, ' cap_net_raw=ep extra')", "'getcap'")
    second = _composed(spark, d, "supplier", "s_suppkey", "concat(s_name, ' cap_setuid=ep')", "'getcap3'")
    return snap.parse_getcap({"/usr/bin/": first, "/": second})


_AREA = "concat('p', p_size % 12)"
_AREAS = [f"p{i}" for i in range(1, 10)]
_LS = "concat('drwxr-xr-x 2 root root ', p_size, ' Jan 1 10:00 /etc/', p_name)"


@query("persistence_union", f"SELECT concat('host-', p_partkey % 10) AS host, {_AREA} AS area, CAST(p_size AS VARCHAR) AS size, "
       f"concat('/etc/', p_name) AS name FROM part WHERE p_size % 12 BETWEEN 1 AND 9 AND p_partkey % 3 <> 0")
def persistence_union(spark, d):
    line = f"CASE p_partkey % 3 WHEN 0 THEN 'total 12' ELSE {_LS} END"
    listing = snap.persistence_union(_composed(spark, d, "part", "p_partkey", line, _AREA), _AREAS)
    return listing.select("host", "area", "size", "name")


_MAC = ("concat(['/Library/LaunchAgents/', '/Library/LaunchDaemons/x/', '/Users/a/Library/Preferences/', '/Library/Extensions/', "
        "'/opt/'][1 + p_partkey % 5], CASE p_partkey % 5 WHEN 2 THEN 'com.apple.loginitems' ELSE p_name END, "
        "CASE p_partkey % 5 WHEN 3 THEN '.kext' ELSE '.plist' END)")


@query("macos_persistence", f"SELECT p_partkey + 1 AS line_no, {_MAC} AS name, ['launch', 'launch', 'login_items', 'kernel_extensions']"
       "[1 + p_partkey % 5] AS area FROM part WHERE p_partkey % 5 <> 4")
def macos_persistence(spark, d):
    folders = ("element_at(array('/Library/LaunchAgents/', '/Library/LaunchDaemons/x/', '/Users/a/Library/Preferences/', "
               "'/Library/Extensions/', '/opt/'), cast(p_partkey % 5 + 1 as int))")
    name = (f"concat({folders}, CASE p_partkey % 5 WHEN 2 THEN 'com.apple.loginitems' ELSE p_name END, "
            "CASE p_partkey % 5 WHEN 3 THEN '.kext' ELSE '.plist' END)")
    line = f"concat('-rw-r--r-- 1 root wheel 10 Jan 1 10:00 ', {name})"
    listing = snap.parse_capture(_composed(spark, d, "part", "p_partkey", line, "'ls'"), "ls")
    return snap.macos_persistence(listing).select("line_no", "name", "area")


@query("admin_users", "SELECT c_nationkey AS grp, unnest([c_name, concat('admin', c_custkey)]) AS username FROM customer")
def admin_users(spark, d):
    doc = "concat('{\"gid\":80,\"users\":[\"', c_name, '\",\"admin', c_custkey, '\"]}') AS json"
    return snap.admin_users(t.table(spark, d, "customer").selectExpr("c_nationkey AS grp", doc))


@query("security_status", "SELECT c_name AS host, 'FileVault' AS tool, c_mktsegment AS status FROM customer UNION ALL "
       "SELECT c_name, 'SIP', concat('enabled ', c_nationkey) FROM customer UNION ALL SELECT c_name, 'AirDrop', 'off' FROM customer")
def security_status(spark, d):
    tools = ["AirDrop", "FileVault", "SIP"]
    wide = t.table(spark, d, "customer").select(
        F.col("c_name").alias("host"), F.lit("off").alias("AirDrop"), F.col("c_mktsegment").alias("FileVault"),
        F.concat(F.lit("enabled "), F.col("c_nationkey").cast("string")).alias("SIP"))
    return snap.security_status(wide, tools, ["host"])


@query("parse_ioc_hits", "SELECT p_brand AS indicator, p_type AS source, concat(p_name, '|', p_size) AS line FROM part")
def parse_ioc_hits(spark, d):
    return snap.parse_ioc_hits(t.table(spark, d, "part").selectExpr("concat_ws('|', p_brand, p_type, p_name, p_size) AS value"))
