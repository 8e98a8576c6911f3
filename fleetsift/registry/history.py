"""History joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetsift.operators import history as hist
from fleetsift.registry import tables as t
from fleetsift.registry.core import query

_TIME = "strftime(visit_time, '%Y-%m-%d %H:%M:%S.%f')"
_VISITS = f"SELECT {_TIME} AS visit_time, url, title FROM visits JOIN places ON place_id = id"


def _readable(df):
    return df.withColumn("visit_time", F.date_format("visit_time", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query("firefox_history", _VISITS, "visits places")
def firefox_history(spark, d):
    return _readable(hist.firefox_history(t.visits(spark, d), t.places(spark, d)))


@query("chrome_history", _VISITS, "visits places")
def chrome_history(spark, d):
    visits = t.visits(spark, d).select(
        F.col("place_id").alias("url"), (F.col("visit_date") + hist.CHROME_EPOCH_MICROS).alias("visit_time"))
    return _readable(hist.chrome_history(visits, t.places(spark, d)))


@query("profile_exclude", "SELECT host, place_id, profile FROM visits WHERE profile <> 'System Profile'", "visits")
def profile_exclude(spark, d):
    return hist.profile_exclude(t.visits(spark, d)).select("host", "place_id", "profile")


@query("download_history", "SELECT DISTINCT event_type AS agent, url, strftime(ts, '%Y-%m-%d') AS downloaded FROM events "
       "JOIN pages ON page_id = user_id")
def download_history(spark, d):
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp")) - hist.MAC_EPOCH_SECONDS
    events = t.table(spark, d, "events").select(F.col("user_id").alias("page_id"), "event_type", seconds.alias("s"))
    joined = events.join(t.table(spark, d, "pages").select("page_id", "url"), "page_id")
    return hist.download_history(joined.select(
        F.col("event_type").alias("LSQuarantineAgentName"), F.col("url").alias("LSQuarantineDataURLString"),
        F.col("s").alias("LSQuarantineTimeStamp")))


@query("install_history", """
SELECT host, line_no, coalesce(date, '') AS date, name FROM (SELECT host, line_no, name, last_value(d IGNORE NULLS) OVER (
    PARTITION BY host ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS date FROM (
  SELECT concat('host-', user_id % 3) AS host, event_id + 1 AS line_no,
    CASE WHEN event_type = 'signup' THEN strftime(ts, '%Y-%m-%d') END AS d,
    CASE WHEN event_type NOT IN ('signup', 'view') THEN concat(event_type, user_id) END AS name FROM events)) WHERE name IS NOT NULL""")
def install_history(spark, d):
    c = F.col
    line = (
        F.when(c("event_type") == "signup", F.concat(F.lit('  "date" =  '), F.date_format("ts", "yyyy-MM-dd"), F.lit(";")))
        .when(c("event_type") == "view", F.lit('  "version" = 1;'))
        .otherwise(F.concat(F.lit('  "displayName" = '), c("event_type"), c("user_id").cast("string"), F.lit(";")))
    )
    lines = t.table(spark, d, "events").select(
        F.concat(F.lit("host-"), (c("user_id") % 3).cast("string")).alias("host"), (c("event_id") + 1).alias("line_no"), line.alias("line"))
    return hist.install_history(lines)


@query("tcc_access", "SELECT c_mktsegment AS service, c_name AS client, c_nationkey AS auth, 'alice' AS \"user\" FROM customer "
       "UNION ALL SELECT 'kTCC', s_name, s_nationkey, 'bob' FROM supplier")
def tcc_access(spark, d):
    alice = t.table(spark, d, "customer").select(
        F.col("c_mktsegment").alias("service"), F.col("c_name").alias("client"), F.col("c_nationkey").alias("auth"))
    bob = t.table(spark, d, "supplier").select(
        F.lit("kTCC").alias("service"), F.col("s_name").alias("client"), F.col("s_nationkey").alias("auth"))
    return hist.tcc_access(alice, "alice").unionByName(hist.tcc_access(bob, "bob"))
