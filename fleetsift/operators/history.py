"""Browser, download and install history."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetsift.operators.joins import lookup

# Microseconds from 1601 and seconds from 1970 to 2001.
CHROME_EPOCH_MICROS = 11_644_473_600_000_000
MAC_EPOCH_SECONDS = 978_307_200
LINES_PER_CHUNK = 50_000


def firefox_history(visits: DataFrame, places: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Visits with the URL and title of their place. ``keys`` are further shared columns, such as the host."""
    known = places.select(*keys, F.col("id").alias("place_id"), "url", "title")
    return lookup(visits, known, [*keys, "place_id"]).select(
        *keys, F.timestamp_micros("visit_date").alias("visit_time"), "url", "title")


def chrome_history(visits: DataFrame, urls: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Visits with their URL and title; visit times count from 1601."""
    known = urls.select(*keys, F.col("id").alias("_url_id"), F.col("url"), "title")
    linked = lookup(visits.withColumnRenamed("url", "_url_id"), known, [*keys, "_url_id"])
    micros = F.col("visit_time") - F.lit(CHROME_EPOCH_MICROS)
    return linked.select(*keys, F.timestamp_micros(micros).alias("visit_time"), "url", "title")


def profile_exclude(history: DataFrame, profile: str = "System Profile") -> DataFrame:
    """History of user profiles only."""
    return history.filter(F.coalesce("profile", F.lit("")) != profile)


def mac_date(seconds: Column) -> Column:
    """Date of a moment given in seconds since 2001."""
    return F.to_date(F.timestamp_seconds(seconds.cast("double") + F.lit(MAC_EPOCH_SECONDS)))


def download_history(events: DataFrame) -> DataFrame:
    """Distinct (agent, url, date) of quarantine events, sorted."""
    return events.select(
        F.coalesce("LSQuarantineAgentName", F.lit("")).alias("agent"),
        F.coalesce("LSQuarantineDataURLString", F.lit("")).alias("url"),
        F.date_format(mac_date(F.col("LSQuarantineTimeStamp")), "yyyy-MM-dd").alias("downloaded"),
    ).distinct().orderBy("agent", "url", "downloaded")


def carry_forward(rows: DataFrame, value: str, group: list[str], position: str, into: str) -> DataFrame:
    """Fill each row with the last non-NULL ``value`` at or before its position in the group.

    A group is worked on in chunks of positions: first within each chunk, then the last value of every chunk is carried
    to the next ones. A long group is thereby spread over many tasks; only one row per chunk is ever ranked as a whole.
    """
    chunked = rows.withColumn("_chunk", F.floor(F.col(position) / LINES_PER_CHUNK))
    within = Window.partitionBy(*group, "_chunk").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    local = chunked.withColumn("_local", F.last(value, ignorenulls=True).over(within))
    last = F.max_by(value, F.when(F.col(value).isNotNull(), F.col(position)))
    across = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        chunked.groupBy(*group, "_chunk").agg(last.alias("_last"))
        .withColumn("_before", F.last("_last", ignorenulls=True).over(across)).select(*group, "_chunk", "_before")
    )
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*group, "_chunk")]
    joined = local.alias("a").join(before.alias("b"), reduce(lambda x, y: x & y, same)).select("a.*", "b._before")
    return joined.withColumn(into, F.coalesce("_local", "_before")).drop(
        "_chunk", "_local", "_before")


def install_history(lines: DataFrame) -> DataFrame:
    """Installed names with the date line that precedes them. Reads ``host``, ``line_no`` and ``line``."""
    line = F.col("line")
    words = F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")
    third = F.replace(F.coalesce(F.get(words, F.lit(2)), F.lit("")), F.lit(";"), F.lit(""))
    is_date = F.contains(line, F.lit("date"))
    is_name = ~is_date & F.contains(line, F.lit("displayName"))
    marked = lines.select(
        "host", "line_no", F.when(is_date, third).alias("_date"), F.when(is_name, third).alias("name"),
    ).filter(F.col("_date").isNotNull() | F.col("name").isNotNull())
    return carry_forward(marked, "_date", ["host"], "line_no", "date").filter(F.col("name").isNotNull()).select(
        "host", "line_no", F.coalesce("date", F.lit("")).alias("date"), "name")


def tcc_access(access: DataFrame, user: str | None = None) -> DataFrame:
    """Permission rows, tagged with the user whose table they come from."""
    return access.withColumn("user", F.lit(user)) if user is not None else access


def browser_ioc_only(history: DataFrame, hits: DataFrame) -> DataFrame:
    """History rows whose URL was flagged."""
    return lookup(history, hits.select("url").distinct(), ["url"], "left_semi")
