"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetsift.session import scratch_dir

#: What a word is: a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """The rows written once to the shared scratch folder and read from there.

    Cuts the lineage, survives lost executors and gives joins real sizes. The files stay in the folder, as the returned frame is lazy.
    """
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def unit(*parts) -> Column:
    """A number in [0, 1) that depends on the values alone."""
    return F.pmod(F.xxhash64(*parts), F.lit(2**53)) / F.lit(float(2**53))


# -- groups too large for a task ------------------------------------------------------------------------------------------------------------

def split_groups(rows: DataFrame, keys: list[str], member: str, visit: str, cap: int) -> DataFrame:
    """Deal the rows of each group to tasks so that every resident meets every other row of its group exactly once.

    ``visit`` is true for rows that only meet residents. A group with at most ``cap`` residents and ``cap`` visitors is one task
    (``task_i`` 0, ``task_j`` 1, ``whole`` true). Larger groups are cut by the hash of ``member`` into pieces, and each pair of pieces
    is a task: rows are repeated once for each piece they must meet, but never gathered in one task.
    """
    counts = rows.groupBy(*keys).agg(F.sum(F.when(F.col(visit), 0).otherwise(1)).alias("residents"),
                                     F.sum(F.when(F.col(visit), 1).otherwise(0)).alias("visitors"))
    large = materialise(counts.filter((F.col("residents") > cap) | (F.col("visitors") > cap)), "large-groups")
    r = F.coalesce(F.ceil(F.col("residents") / cap), F.lit(1)).cast("int")
    v = F.coalesce(F.ceil(F.col("visitors") / cap), F.lit(1)).cast("int")
    r, v = F.greatest(r, F.lit(1)), F.greatest(v, F.lit(1))
    dealt = rows.join(large, keys, "left").withColumns({"pieces": r, "guests": v})
    hashed = F.xxhash64(member, F.lit(7))
    dealt = dealt.withColumn("piece", F.when(F.col(visit), F.col("pieces") + F.pmod(hashed, F.col("guests")).cast("int"))
                             .otherwise(F.pmod(hashed, F.col("pieces")).cast("int")))
    dealt = dealt.withColumn("whole", (F.col("pieces") == 1) & (F.col("guests") == 1))
    mine = F.col("piece")
    residents = F.transform(F.sequence(F.lit(0), F.col("pieces") - 1),
                            lambda q: F.struct(F.least(mine, q).alias("i"), F.greatest(mine, q).alias("j")))
    guests = F.transform(F.sequence(F.col("pieces"), F.col("pieces") + F.col("guests") - 1),
                         lambda q: F.struct(mine.alias("i"), q.alias("j")))
    visits = F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), lambda q: F.struct(q.alias("i"), mine.alias("j")))
    tasks = F.when(F.col("whole"), F.array(F.struct(F.lit(0).alias("i"), F.lit(1).alias("j")))) \
        .when(F.col(visit), visits).otherwise(F.concat(residents, guests))
    return dealt.withColumn("task", F.explode(tasks)).select(
        *rows.columns, "piece", "whole", F.col("task.i").alias("task_i"), F.col("task.j").alias("task_j"))


def sides(task_i: int, task_j: int, whole: bool, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Positions of the two sides of a task of ``split_groups``; whether the left side also meets itself."""
    left = np.flatnonzero(piece == task_i)
    right = np.flatnonzero(piece == task_j) if task_i != task_j else left[:0]
    return left, right, bool(whole) or task_i == task_j


class Forest:
    """Links between positions of one task, kept as the smallest position of each connected set."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while len(a):
            x, y = label[a], label[b]
            open_ = x != y
            if not open_.any():
                return
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label[:] = up

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        child = np.flatnonzero(self.label != np.arange(len(self.label)))
        return child, self.label[child]


# -- connected components -------------------------------------------------------------------------------------------------------------------

def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of all nodes on an edge; the component is its smallest node.

    Alternating large and small stars. A star is found by a minimum that is pre-aggregated before the shuffle, then joined with the
    edges; the minima are written first, so that Spark can split the join at a hub. No node's edges are gathered in a list.
    """
    current = materialise(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
                          .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _only_stars(current):
        both = current.union(current.select("v", "u"))
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "stars")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.filter("u <> v").distinct(), "edges")
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "stars")
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        current = materialise(small.distinct(), "edges")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _only_stars(edges: DataFrame) -> bool:
    """Whether each larger end has one edge, and to a node that is no larger end itself: then all edges lead to the smallest node."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).union(edges.select("v", F.lit(0)))
    seen = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return seen.filter("ups > 1 OR ups = 1 AND least = 0").isEmpty()


# -- numbering ------------------------------------------------------------------------------------------------------------------------------

def number_within(rows: DataFrame, group: str, order: list[str], name: str, per_bucket: int = 50_000) -> DataFrame:
    """Add ``name``: 0, 1, 2, ... without gaps within each ``group``, in an order that the values of ``order`` fix.

    Rows of a group are dealt by hash to buckets of about ``per_bucket`` rows, numbered there, and moved up by the sizes of the group's
    earlier buckets; only one count per bucket meets in a window. ``rows`` is read twice: pass written rows.
    """
    most = rows.groupBy(group).count().agg(F.max("count")).first()[0] or 0
    buckets = max(1, -(-most // per_bucket))
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order, F.lit(3)), F.lit(buckets)).cast("int"))
    sizes = materialise(dealt.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_start", F.sum("_n").over(Window.partitionBy(group).orderBy("_bucket")) - F.col("_n")), "buckets")
    within = F.row_number().over(Window.partitionBy(group, "_bucket").orderBy(*order)) - 1
    return dealt.withColumn("_within", within).join(sizes.drop("_n"), [group, "_bucket"]).withColumn(
        name, (F.col("_start") + F.col("_within")).cast("long")).drop("_bucket", "_start", "_within")
