"""Indicator lists and configuration arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetsift.functions.addresses import v4_number


def _entries(spark: SparkSession, path: str) -> DataFrame:
    line = F.lower(F.trim(F.regexp_replace("value", r"[\t\r﻿]", " ")))
    return spark.read.text(path).select(line.alias("entry")).filter(
        (F.col("entry") != "") & ~F.startswith("entry", F.lit("#")))


def hash_algo(value: Column) -> Column:
    """MD5 or SHA256 by length; NULL for anything else."""
    return F.when(value.rlike(r"\A[0-9a-f]{32}\z"), "md5").when(value.rlike(r"\A[0-9a-f]{64}\z"), "sha256")


def ioc_type(indicator: str) -> Column:
    """url, ip or domain, of a column given by name."""
    value = F.lower(F.trim(indicator))
    v4 = v4_number(f"trim({indicator})")
    v6 = value.rlike(r"\A[0-9a-f]*:[0-9a-f:]*:[0-9a-f:.]*\z")
    return (
        F.when(value.rlike(r"\A[a-z][a-z0-9+.-]*://"), "url")
        .when(v4.isNotNull() | v6, "ip").otherwise("domain")
    )


def scan_hash_list(spark: SparkSession, path: str) -> DataFrame:
    """(hash, algo) of a hash list; lines that are neither MD5 nor SHA256 are dropped."""
    return _entries(spark, path).select(F.col("entry").alias("hash"), hash_algo(F.col("entry")).alias("algo")).filter(
        F.col("algo").isNotNull())


def scan_ioc_list(spark: SparkSession, path: str, list_name: str = "custom") -> DataFrame:
    """(indicator, kind, list) of a domain / IP / URL list."""
    return _entries(spark, path).select(
        F.col("entry").alias("indicator"), ioc_type("entry").alias("kind"), F.lit(list_name).alias("list"))


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """(path, config) rows of JSON configuration files."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("config"))


def config_values(config: DataFrame, key: str, column: str = "config") -> DataFrame:
    """The non-empty strings of one configuration array, in order."""
    values = F.try_variant_get(column, f"$.{key}", "array<string>")
    keep = [c for c in config.columns if c != column]
    return config.select(*keep, F.posexplode(values).alias("pos", "value")).filter(
        F.coalesce(F.col("value"), F.lit("")) != "")


def scan_config_list(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The strings under one key of a configuration file."""
    return config_values(read_config(spark, path), key)


def config_first_available(config: DataFrame, keys: list[str], column: str = "config") -> DataFrame:
    """The strings under the first of several keys that has any."""
    def usable(key: str) -> Column:
        values = F.filter(F.try_variant_get(column, f"$.{key}", "array<string>"), lambda v: F.coalesce(v, F.lit("")) != "")
        return F.when(F.size(values) > 0, values)

    keep = [c for c in config.columns if c != column]
    return config.select(*keep, F.posexplode(F.coalesce(*[usable(k) for k in keys])).alias("pos", "value"))
