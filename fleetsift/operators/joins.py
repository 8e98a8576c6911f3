"""Lookup joins that stay safe when the lookup side grows or one key is hot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A lookup side is broadcast only if a count shows it at or below both limits.
MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 32 << 20
# Slices of a group in ``newest_n``, and the least of a hot key in a join.
SALTS = 16
# A key is hot if one row in a thousand shows it a thousand times: about a million rows.
SAMPLE_RATE = 0.001
HOT_IN_SAMPLE = 1000
MAX_HOT_KEYS = 1000


def is_small(df: DataFrame, rows: int = MAX_BROADCAST_ROWS, size: int = MAX_BROADCAST_BYTES) -> bool:
    """Whether a DataFrame is within the broadcast limits. Reads no more than ``rows + 1`` rows of it."""
    width = sum((F.coalesce(F.length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in df.columns), F.lit(0))
    seen = (
        df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()
    )
    return seen["n"] <= rows and 4 * seen["b"] <= size


def hot_keys(df: DataFrame, keys: list[str], rate: float = SAMPLE_RATE, seen: int = HOT_IN_SAMPLE) -> list:
    """Keys that a sample shows to hold very many rows, most frequent first, with their count there (``_n``). Only decides where rows go."""
    counts = df.select(*keys).sample(rate, seed=11).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counts.filter(F.col("_n") >= seen).orderBy(F.col("_n").desc()).limit(MAX_HOT_KEYS).collect()


def salted_join(
    left: DataFrame, right: DataFrame, keys: list[str], how: str, salts: int = SALTS, rate: float = SAMPLE_RATE,
    seen: int = HOT_IN_SAMPLE,
) -> DataFrame:
    """Equi-join in which the left rows of a hot key are spread over ``salts`` partitions, or more if its count asks for it.

    A partition then holds about as many rows as make a key hot, or fewer. Only the right rows of hot keys are repeated. The salt is a
    hash of the whole left row, so it is the same when a lost task runs again.
    """
    hot = hot_keys(left, keys, rate, seen)
    if not hot:
        return left.join(right, keys, how)
    # At most MAX_HOT_KEYS rows.
    schema = left.select(*keys).schema.add("_n", "long")
    marks = F.broadcast(left.sparkSession.createDataFrame(hot, schema).select(
        *keys, F.greatest(F.lit(salts), F.ceil(F.col("_n") / seen)).cast("int").alias("_salts")))
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in _hashable(left)]), F.coalesce("_salts", F.lit(salts))).cast("int")
    copies = F.sequence(F.lit(0), F.coalesce(F.col("_salts") - 1, F.lit(0)))
    # Rows without a key match nothing, so they may go anywhere.
    scattered = reduce(lambda a, b: a | b, [F.col(f"`{k}`").isNull() for k in keys], F.col("_salts").isNotNull())
    salted_left = left.join(marks, keys, "left").withColumn("_salt", F.when(scattered, spread).otherwise(0)).drop("_salts")
    salted_right = right.join(marks, keys, "left").withColumn("_salt", F.explode(copies)).drop("_salts")
    return salted_left.join(salted_right, [*keys, "_salt"], how).drop("_salt")


def _hashable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]


def lookup(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", small: bool | None = None) -> DataFrame:
    """Join rows to a lookup list by equal keys: broadcast when its size is checked, a shuffle with hot keys salted
    otherwise."""
    if is_small(right) if small is None else small:
        return left.join(F.broadcast(right), keys, how)
    return salted_join(left, right, keys, how)


def newest_n(df: DataFrame, keys: list[str], order: list[Column], n: int, salts: int = SALTS) -> DataFrame:
    """The first ``n`` rows of every group in the given order.

    A hot group is first cut down within ``salts`` slices, so that its last step ranks at most ``salts * n`` rows.
    """
    # by input split, so that the salt reads no column; the order alone decides which rows are kept
    spread = F.pmod(F.spark_partition_id(), F.lit(salts))
    slices = Window.partitionBy(*keys, "_salt").orderBy(*order)
    groups = Window.partitionBy(*keys).orderBy(*order)
    cut = df.withColumn("_salt", spread).withColumn("_rank", F.row_number().over(slices)).filter(F.col("_rank") <= n)
    return cut.withColumn("_rank", F.row_number().over(groups)).filter(F.col("_rank") <= n).drop("_salt", "_rank")
