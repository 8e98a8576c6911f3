"""Log and timeline queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetsift.operators import logs
from fleetsift.registry import tables as t
from fleetsift.registry.core import query


@query("timeline_range", "SELECT event_id, file, line FROM log_lines WHERE file <> 'other.log' AND date_trunc('second', ts) BETWEEN "
       "TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-12 18:30:00'", "log_lines")
def timeline_range(spark, d):
    return logs.timeline_range(t.log_lines(spark, d), "2024-01-05 06:00:00", "2024-01-12 18:30:00").select("event_id", "file", "line")


# Orders as lines of four logs over all their years: a third with ISO times, a third with an offset, a third classic without a year.
_MOMENT = "o_orderdate + to_seconds(o_orderkey * 7919 % 86400)"


@query("timeline_years", f"SELECT o_orderkey FROM orders WHERE {_MOMENT} BETWEEN TIMESTAMP '1995-11-20 06:00:00' AND TIMESTAMP '1996-02-10 18:30:00'")
def timeline_years(spark, d):
    key, moment = F.col("o_orderkey"), F.expr("cast(o_orderdate AS timestamp) + make_dt_interval(0, 0, 0, o_orderkey * 7919 % 86400)")
    orders = t.table(spark, d, "orders").select(key, moment.alias("ts"))
    style = key % 3
    written = F.when(style == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")) \
        .when(style == 1, F.date_format(F.col("ts") + F.expr("INTERVAL 5 HOURS"), "yyyy-MM-dd'T'HH:mm:ss'+05:00'")) \
        .otherwise(F.concat(F.date_format("ts", "MMM "), F.lpad(F.dayofmonth("ts").cast("string"), 2, " "), F.date_format("ts", " HH:mm:ss")))
    lines = orders.select("o_orderkey", F.element_at(F.array(*[F.lit(f) for f in logs.LOG_FILES]), (F.floor(key / 3) % 4 + 1).cast("int")).alias("file"),
                          F.unix_seconds("ts").alias("line_no"), F.concat(written, F.lit(" host: order")).alias("line"))
    last = orders.agg(F.max("ts").cast("string")).first()[0]
    return logs.timeline_range(lines, "1995-11-20 06:00:00", "1996-02-10 18:30:00", as_of=last).select("o_orderkey")


@query("timeline_lexicographic", "SELECT event_id, line FROM log_lines WHERE file IN ('syslog', 'messages') AND line >= '2024-01-05 06' "
       "AND line <= '2024-01-12 18'", "log_lines")
def timeline_lexicographic(spark, d):
    return logs.timeline_range(
        t.log_lines(spark, d), "2024-01-05 06", "2024-01-12 18", ["syslog", "messages"], lexicographic=True).select("event_id", "line")


_DATE = "concat(1990 + o_orderkey % 30, '-', lpad(CAST(o_custkey % 15 AS VARCHAR), 2, '0'), '-', lpad(CAST(o_orderkey % 34 AS VARCHAR), 2, '0'))"


@query("date_validate", f"SELECT o_orderkey, try_strptime({_DATE}, '%Y-%m-%d') IS NOT NULL AS valid FROM orders")
def date_validate(spark, d):
    def two(number):
        return F.lpad(number.cast("string"), 2, "0")

    value = F.concat_ws("-", (1990 + F.col("o_orderkey") % 30).cast("string"), two(F.col("o_custkey") % 15), two(F.col("o_orderkey") % 34))
    return t.table(spark, d, "orders").select("o_orderkey", logs.valid_date(value).alias("valid"))


_AUTH = "['Session Opened for', 'ACCEPTED password', 'a new session', 'is not in sudoers', 'closed'][1 + user_id % 5]"


@query("auth_events", f"SELECT event_id, concat(event_type, ' ', {_AUTH}) AS line FROM events WHERE user_id % 5 <> 4")
def auth_events(spark, d):
    phrases = ["Session Opened for", "ACCEPTED password", "a new session", "is not in sudoers", "closed"]
    phrase = F.element_at(F.array(*[F.lit(p) for p in phrases]), (F.col("user_id") % 5 + 1).cast("int"))
    return logs.auth_events(t.table(spark, d, "events").select("event_id", F.concat_ws(" ", "event_type", phrase).alias("line")))


@query("days_diff", "SELECT o_orderkey, CAST(floor((epoch(TIMESTAMP '2002-01-01 12:00:00') - epoch(o_orderdate)) / 86400) AS BIGINT) AS days "
       "FROM orders")
def days_diff(spark, d):
    later = F.lit("2002-01-01 12:00:00").cast("timestamp")
    return t.table(spark, d, "orders").select("o_orderkey", logs.days_diff(later, F.col("o_orderdate")).alias("days"))


@query("mtime_window", "SELECT path, host FROM files WHERE mtime > TIMESTAMP '2024-01-06 00:00:00'", "files")
def mtime_window(spark, d):
    return logs.mtime_window(t.files(spark, d), "2024-01-09", 3).select("path", "host")


@query("process_log_24h", "SELECT event_id FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-29 12:00:00'")
def process_log_24h(spark, d):
    log = t.table(spark, d, "events").withColumnRenamed("event_type", "process")
    return logs.process_log_24h(log, "error", "2024-01-30 12:00:00").select("event_id")


@query("audit_rows", "SELECT event_id, line FROM log_lines WHERE file <> 'syslog'", "log_lines")
def audit_rows(spark, d):
    marked = F.when(F.col("file") == "syslog", F.concat(F.lit("header,"), "line")).otherwise(F.col("line"))
    return logs.audit_rows(t.log_lines(spark, d).withColumn("line", marked)).select("event_id", "line")


@query("login_audit", "SELECT event_id, \"user\", line FROM audit WHERE class = 'lo' AND ts >= TIMESTAMP '2024-01-14' "
       "AND ts < TIMESTAMP '2024-01-16'", "audit")
def login_audit(spark, d):
    return logs.login_audit(t.audit(spark, d), "2024-01-15").select("event_id", "user", "line")


@query("user_activity", """
SELECT a.host, a."user", line FROM (SELECT DISTINCT host, "user" FROM accounts WHERE "user" NOT IN ('Guest', 'Shared')) a
LEFT JOIN (SELECT host, "user", line FROM audit WHERE ts >= TIMESTAMP '2024-01-14' AND ts < TIMESTAMP '2024-01-16') r
ON a."user" = r."user" AND a.host = r.host
""", "accounts audit")
def user_activity(spark, d):
    return logs.user_activity(t.audit(spark, d), t.accounts(spark, d), "2024-01-15").select("host", "user", "line")


@query("log_difference", """
SELECT event_id, host, line FROM audit a WHERE ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-16' AND NOT EXISTS (
  SELECT 1 FROM audit b WHERE b.ts >= TIMESTAMP '2024-01-14' AND b.ts < TIMESTAMP '2024-01-15' AND b.line = a.line AND b.host = a.host)""", "audit")
def log_difference(spark, d):
    return logs.log_difference(t.audit(spark, d), "2024-01-15").select("event_id", "host", "line")


@query("shell_history_report", "SELECT c_name AS \"user\", 'bash' AS shell, c_mktsegment AS command FROM customer UNION ALL "
       "SELECT s_name, 'zsh', concat('run ', s_nationkey) FROM supplier")
def shell_history_report(spark, d):
    bash = t.table(spark, d, "customer").select(F.col("c_name").alias("user"), F.col("c_mktsegment").alias("command"))
    zsh = t.table(spark, d, "supplier").select(
        F.col("s_name").alias("user"), F.concat(F.lit("run "), F.col("s_nationkey").cast("string")).alias("command"))
    return logs.shell_history_report({"bash": bash, "zsh": zsh})


@query("user_list", "SELECT DISTINCT \"user\", host FROM accounts WHERE \"user\" NOT IN ('Guest', 'Shared')", "accounts")
def user_list(spark, d):
    return logs.user_list(t.accounts(spark, d)).distinct()
