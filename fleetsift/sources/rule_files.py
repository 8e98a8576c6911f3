"""Rule folders: every JSON file below a root, one rule object or an array of them per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetsift.plans.rules import Rule, rules_from_df
from fleetsift.schemas import SOURCE_CATALOG


def scan_sources(spark: SparkSession, path: str) -> DataFrame:
    """A source list: a JSON array, or one object per line, of sources."""
    return spark.read.schema(SOURCE_CATALOG).option("multiLine", True).json(path)


def read_rule_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of the rule files below a folder; the source list at the root is not a rule file."""
    files = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.[jJ][sS][oO][nN]")
        .text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    )
    return files.filter(~F.endswith(F.col("path"), F.lit(f"{root.rstrip('/')}/sources.json")))


def _parsed(files: DataFrame) -> DataFrame:
    return files.withColumn("_doc", F.try_parse_json(F.regexp_replace("content", r"\A﻿", "")))


def parse_rules(files: DataFrame) -> DataFrame:
    """Rule envelopes from (path, content) rows; files that are not JSON are left to ``broken_rule_files``."""
    doc = F.col("_doc")
    as_list = F.when(
        F.startswith(F.schema_of_variant(doc), F.lit("ARRAY")), F.variant_get(doc, "$", "array<variant>")
    ).otherwise(F.array(doc))
    rules = (
        _parsed(files).filter(doc.isNotNull()).select("path", F.explode(as_list).alias("_rule"))
        .filter(F.col("_rule").isNotNull() & ~F.is_variant_null("_rule"))
    )

    def text(key: str) -> Column:
        return F.coalesce(F.try_variant_get("_rule", f"$.{key}", "string"), F.lit(""))

    def texts(key: str) -> Column:
        single = F.try_variant_get("_rule", f"$.{key}", "string")
        several = F.try_variant_get("_rule", f"$.{key}", "array<string>")
        return F.coalesce(several, F.when(single.isNotNull(), F.array(single)), F.array().cast("array<string>"))

    def tree(key: str) -> Column:
        return F.to_json(F.variant_get("_rule", f"$.{key}", "variant"))

    enabled = F.lower(F.coalesce(F.try_variant_get("_rule", "$.enabled", "string"), F.lit("true"))) != "false"
    return rules.select(
        *[text(k).alias(k) for k in ("rule_id", "title", "level", "status", "category", "rule_file")],
        enabled.alias("enabled"), texts("tags").alias("tags"), texts("sources").alias("sources"),
        tree("items").alias("items_json"), tree("condition").alias("condition_json"),
    )


def broken_rule_files(files: DataFrame) -> DataFrame:
    """Paths of the files that are not JSON."""
    return _parsed(files).filter(F.col("_doc").isNull()).select("path")


def scan_rules(spark: SparkSession, root: str) -> DataFrame:
    """Rule table of a folder."""
    return parse_rules(read_rule_files(spark, root))


def load_rules(spark: SparkSession, root: str) -> list[Rule]:
    """Rules of a folder, on the driver and ready to compile."""
    return rules_from_df(scan_rules(spark, root))
