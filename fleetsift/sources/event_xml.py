"""Event records from exported XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_SHAPE = (
    "System struct<Provider:struct<_Name:string>,EventID:string,Channel:string,EventRecordID:string,Computer:string,"
    "TimeCreated:struct<_SystemTime:string>>, EventData struct<Data:array<struct<_Name:string,_VALUE:string>>>, "
    "RenderingInfo struct<Message:string>"
)


def last_entry_wins(entries: Column) -> Column:
    """(name, value) structs as a map with lower-case names; the last entry of a name counts."""
    named = F.transform(entries, lambda e: F.struct(F.lower(e["name"]).alias("name"), e["value"].alias("value")))
    last = F.filter(named, lambda e, i: ~F.exists(
        F.slice(named, i + F.lit(2), F.greatest(F.size(named) - i - 1, F.lit(0))), lambda later: later["name"] == e["name"]
    ))
    return F.coalesce(F.map_from_entries(last), F.create_map().cast("map<string,string>"))


def _parsed(records: DataFrame, xml: str) -> DataFrame:
    """Add the system values, the payload map and the parsed record itself as ``_doc``."""
    doc = F.from_xml(F.col(xml), _SHAPE, {"ignoreSurroundingSpaces": "false", "mode": "PERMISSIVE"})
    parsed = records.withColumn("_doc", doc)
    data = F.filter(F.col("_doc.EventData.Data"), lambda d: F.coalesce(d["_Name"], F.lit("")) != "")
    pairs = F.transform(data, lambda d: F.struct(
        d["_Name"].alias("name"), F.coalesce(d["_VALUE"], F.lit("")).alias("value")))
    system = F.col("_doc.System")
    return parsed.withColumns({
        "provider": system["Provider"]["_Name"],
        "event_id": F.trim(system["EventID"]).try_cast("int"),
        "log_name": F.trim(system["Channel"]),
        "event_data": last_entry_wins(pairs),
    })


def parse_event_xml(records: DataFrame, xml: str = "raw_xml") -> DataFrame:
    """Add the system values and the payload map of every XML record. Data nodes without a name are left out."""
    return _parsed(records, xml).drop("_doc")


def scan_event_xml(spark: SparkSession, path: str) -> DataFrame:
    """Exported XML files as ``event_log`` rows. Files are split at record ends, so one file feeds many tasks.

    ``message`` is the rendered one, NULL where the export holds none.
    """
    cut = spark.read.option("lineSep", "</Event>").text(path)
    start = F.expr("regexp_instr(value, '<Event[ >]')")
    raw = cut.withColumn("_at", start).filter(F.col("_at") > 0).select(
        F.concat(F.expr("substring(value, _at)"), F.lit("</Event>")).alias("raw_xml"))
    system = F.col("_doc.System")
    return _parsed(raw, "raw_xml").select(
        F.trim(system["Computer"]).alias("host"), "log_name", "provider", "event_id",
        F.trim(system["EventRecordID"]).try_cast("long").alias("record_id"),
        F.trim(system["TimeCreated"]["_SystemTime"]).try_cast("timestamp").alias("time_created"),
        "event_data", F.col("_doc.RenderingInfo.Message").alias("message"), "raw_xml",
    )


def fold_payload_keys(event_log: DataFrame) -> DataFrame:
    """Bring payload keys of a foreign event table to lower case."""
    entries = F.transform(F.map_entries("event_data"), lambda e: F.struct(
        e["key"].alias("name"), e["value"].alias("value")))
    return event_log.withColumn("event_data", last_entry_wins(entries))
