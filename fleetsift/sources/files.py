"""Readers of collected text, logs, inventories and history exports."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetsift.operators.joins import lookup


def scan_event_log(spark: SparkSession, path: str) -> DataFrame:
    """The event table. Best laid out as Parquet partitioned by log name and day, sorted by event id in each file."""
    return spark.read.parquet(path)


def scan_captures(spark: SparkSession, root: str) -> DataFrame:
    """Captured command output as numbered lines, from files below ``<root>/host=<host>/capture=<name>/``.

    Files are read by line and in splits. A split's rows stand in the order of the file, so a line's number is its place in its split plus the
    lines of the file's earlier splits; only one row per split is counted and ranked, and no row holds a file. Only ``\\n`` ends a line.
    An empty file has no lines.
    """
    lines = spark.read.option("lineSep", "\n").text(root).select(
        F.col("host").cast("string"), F.col("capture").cast("string"), F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_split"),
    ).withColumn("_id", F.monotonically_increasing_id())
    splits = lines.groupBy("_path", "_split").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    earlier = Window.partitionBy("_path").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    shifts = splits.select("_path", "_split", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    return lookup(lines, shifts, ["_path", "_split"]).select("host", "capture", (F.col("_id") + F.col("_shift")).alias("line_no"), "line")


def scan_weblogs(spark: SparkSession, root: str, as_of: str | None = None, days_back: int | None = None) -> DataFrame:
    """Lines of ``*.log`` files, optionally only of files modified within ``days_back`` days before ``as_of``."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.log")
    if as_of is not None and days_back is not None:
        since = datetime.fromisoformat(as_of) - timedelta(days=days_back)
        reader = reader.option("modifiedAfter", since.strftime("%Y-%m-%dT%H:%M:%S"))
    return reader.text(root).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """A collected file inventory."""
    return spark.read.parquet(path)


def scan_shared_files(spark: SparkSession, root: str) -> DataFrame:
    """Inventory of a shared store itself: path, size and modification time, without reading any content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(
        "path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def scan_table_export(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """An exported history or permission table (browser, quarantine events, access permissions)."""
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    return reader.format(fmt).load(path)


def union_by_user(tables: dict[str, DataFrame]) -> DataFrame:
    """One table per user as one table with a ``user`` column."""
    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [df.withColumn("user", F.lit(user)) for user, df in tables.items()],
    )


def scan_shell_history(spark: SparkSession, root: str) -> DataFrame:
    """(user, shell, command) of collected histories below ``<root>/user=<user>/shell=<bash or zsh>/``.

    Spark skips files whose name starts with a dot, so ``.bash_history`` must be collected under another name.
    """
    return spark.read.text(root).select(
        F.col("user").cast("string").alias("user"), F.col("shell").cast("string").alias("shell"),
        F.col("value").alias("command"))
