"""Sharding by a k-d tree over metadata.

The space of the documents' metadata is split again and again at the weighted median along the dimension that is widest in the part at
hand, until every leaf has its share of the bytes. Medians come from histograms that Spark aggregates; the driver sees bin sums and
the few heaviest groups only.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetsift.llm.common import materialise, number_within

SHARDS = 16
#: The dimensions of a document, each a number; ``tie`` parts what the others do not.
DIMENSIONS = ("first_id", "log_bytes", "lang_at", "source_at")
BINS = 2_048


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1, 1 for null), text_crc32 (0 for null), and h1, h2: the group of equal texts."""
    text = F.col("text")
    return docs.select(
        "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), "lang", "source")


def _place(value: Column) -> Column:
    """A string's place in [0, 1) by its first bytes; null is -1."""
    lead = F.conv(F.hex(F.rpad(F.substring(value.cast("binary"), 1, 6), 6, F.lit(b"\0"))), 16, 10).cast("double") / F.lit(float(256**6))
    return F.coalesce(lead, F.lit(-1.0))


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``, in shards of nearly equal bytes.

    Documents with equal texts stay in one shard. Only a group larger than a shard is cut, by the hash of the id, into as few parts as
    fit, and each part stays in one shard. The law is ``bytes``: sizes near equal, as far as whole texts and groups allow. ``slot`` counts from 0 without gaps within each
    shard. Nulls in any column are values like others. The number of shards must be a power of two.
    """
    if shards < 1 or shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    rows = materialise(sized(docs), "sizes")
    total = rows.agg(F.sum("size")).first()[0] or 0
    target = max(1.0, total / shards)
    group = ["h1", "h2", "part"]
    # there are fewer groups larger than a shard than shards
    large = rows.groupBy("h1", "h2").agg(F.sum("size").alias("g")).filter(F.col("g") > target) \
        .withColumn("parts", F.ceil(F.col("g") / target).cast("int"))
    large = materialise(large.drop("g"), "large")
    parted = rows.join(F.broadcast(large), ["h1", "h2"], "left").withColumn("part", F.coalesce(
        F.pmod(F.xxhash64("doc_id", F.lit(5)), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
    items = materialise(parted.groupBy(*group).agg(
        F.sum("size").alias("weight"), F.coalesce(F.min("doc_id"), F.lit(-1)).cast("double").alias("first_id"),
        F.log2(F.max("size").cast("double")).alias("log_bytes"), F.min(_place(F.col("lang"))).alias("lang_at"),
        F.min(_place(F.col("source"))).alias("source_at")).withColumn("tie", F.xxhash64(*group).cast("double")), "items")
    placed = _tree(items, shards, target)
    out = parted.join(placed.select(*group, "shard"), group)
    out = materialise(out.select("doc_id", "size", "text_crc32", "h1", "shard"), "placed")
    numbered = number_within(out, "shard", ["doc_id", "text_crc32", "size", "h1"], "slot")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _tree(items: DataFrame, shards: int, target: float) -> DataFrame:
    """``items`` with ``shard``. Each level is one pass for the widths and one for each digit of the medians."""
    # Heavier than 1/100 of a shard: at most 100 of them for each shard, so they fit on the driver and in a broadcast.
    heavy = F.col("weight") > target / 100
    dims = [*DIMENSIONS, "tie"]
    giants = [r.asDict() for r in items.filter(heavy).select("h1", "h2", "part", "weight", *dims).collect()]
    for g in giants:
        g["node"] = 0
    light = items.filter(~heavy).withColumn("node", F.lit(0))
    spread = items.agg(*[F.stddev_pop(d).alias(d) for d in DIMENSIONS]).first().asDict()
    cuts: list[dict[int, tuple]] = []
    while 2 ** len(cuts) < shards:
        stats = light.groupBy("node").agg(F.sum("weight").alias("w"), *[F.stddev_pop(d).alias(f"s_{d}") for d in DIMENSIONS],
                                       *[F.min(d).alias(f"lo_{d}") for d in dims], *[F.max(d).alias(f"hi_{d}") for d in dims]).collect()
        stats = {r.node: r for r in stats}
        wanted, level = {}, {}
        for n in range(2 ** len(cuts)):
            r = stats.get(n)
            own = [g for g in giants if g["node"] == n]
            weight = float(r.w if r else 0) + sum(g["weight"] for g in own)
            dim = max(DIMENSIONS, key=lambda d: ((r[f"s_{d}"] or 0) / spread[d] if r and spread[d] else 0.0))
            level[n] = [dim, None, None]
            wanted[n] = (weight, own)
        level = _cut(light, stats, level, wanted, target)
        cuts.append({n: tuple(c) for n, c in level.items()})
        light = materialise(light.withColumn("node", _descend(cuts[-1])), "nodes")
    shard_of = light.select("h1", "h2", "part", F.col("node").alias("shard"))
    if not giants:
        return shard_of
    chosen = items.sparkSession.createDataFrame([(g["h1"], g["h2"], g["part"], g["node"]) for g in giants], "h1 long, h2 long, part int, shard int")
    return shard_of.union(chosen)


def _cut(at: DataFrame, stats: dict, level: dict, wanted: dict, target: float) -> dict:
    """Where to cut each node along its dimension: (dimension, value, tie). Light items below (value, tie) go to the first half."""
    # heavy groups first: each to the side that its coordinate names, then those nearest to the boundary move if that evens the halves
    dims = {n: c[0] for n, c in level.items()}
    heavy = {n: sum(g["weight"] for g in own) for n, (_, own) in wanted.items()}
    middle = _medians(at, stats, dims, {n: (wanted[n][0] - heavy[n]) / 2 for n in level}, target / 20) if any(heavy.values()) else {}
    goals = {}
    for n, (dim, _, _) in level.items():
        weight, own = wanted[n]
        r = stats.get(n)
        light = float(r.w if r else 0)
        edge = middle.get(n, (None, None))[0]
        own.sort(key=lambda g: (g[dim], g["tie"]))
        edge = own[len(own) // 2][dim] if edge is None and own else edge
        left = [g for g in own if g[dim] < edge] if own else []
        first = sum(g["weight"] for g in left)
        side = {id(g) for g in left}
        # what the light items can even out is not worth moving a group for
        for g in sorted(own, key=lambda g: -g["weight"]):
            here = id(g) in side
            moved = first - g["weight"] if here else first + g["weight"]
            if _miss(moved, light, weight) < _miss(first, light, weight) - 1e-9:
                first = moved
                side ^= {id(g)}
        for g in own:
            g["node"] = 2 * n + (id(g) not in side)
        goals[n] = min(max(weight / 2 - first, 0.0), light)
    values = _medians(at, stats, dims, goals, target / 2000)
    return {n: [c[0], *values.get(n, (None, None))] for n, c in level.items()}


def _miss(first: float, light: float, weight: float) -> float:
    """How far the first half stays from half of ``weight`` when light items fill it up."""
    return max(first - weight / 2, weight / 2 - first - light, 0.0)


def _medians(at: DataFrame, stats: dict, dims: dict[int, str], goals: dict[int, float], tolerance: float) -> dict[int, tuple]:
    """(value, tie) so that the light items below weigh ``goals``: histograms of ``BINS`` bins per node.

    The bin of the median is cut again until it weighs ``tolerance`` at most; one value that weighs more is cut by ``tie``.
    """
    open_ = {n: {"by": dims[n], "lo": stats[n][f"lo_{dims[n]}"], "hi": stats[n][f"hi_{dims[n]}"], "below": 0.0, "value": None} for n in dims if n in stats}
    found: dict[int, tuple] = {}
    for _ in range(8):
        for n in [n for n, s in open_.items() if s["value"] is None and s["lo"] == s["hi"]]:
            s = open_[n]
            s.update(value=s["lo"], by="tie", lo=stats[n]["lo_tie"], hi=stats[n]["hi_tie"])
        if not open_:
            break
        place, value = [], []
        for n, s in open_.items():
            x, lo, width = s["by"], _number(s["lo"]), _number((s["hi"] - s["lo"]) or 1.0)
            inside = f"node = {n} AND {x} BETWEEN {lo} AND {_number(s['hi'])}"
            if s["value"] is not None:
                inside += f" AND {dims[n]} = {_number(s['value'])}"
            place.append(f"WHEN {inside} THEN CAST(least(floor(({x} - {lo}) / {width} * {BINS}), {BINS - 1}) AS INT)")
            value.append(f"WHEN node = {n} THEN {x}")
        bins = at.withColumns({"bin": F.expr(f"CASE {' '.join(place)} END"), "x": F.expr(f"CASE {' '.join(value)} END")}).filter("bin IS NOT NULL")
        sums = defaultdict(list)
        for r in bins.groupBy("node", "bin").agg(F.sum("weight").alias("w"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect():
            sums[r.node].append(r)
        for n, s in list(open_.items()):
            below, chosen = s["below"], None
            for r in sorted(sums[n], key=lambda r: r.bin):
                if below + r.w > goals[n]:
                    chosen = r
                    break
                below += r.w
            settled = s["value"] is not None
            if chosen is None:
                found[n] = _edge(s, s["hi"], True)
            elif chosen.w <= tolerance or settled and chosen.lo == chosen.hi:
                after = goals[n] - below > below + chosen.w - goals[n]
                found[n] = _edge(s, chosen.hi if after else chosen.lo, after)
            else:
                s.update(below=below, lo=chosen.lo, hi=chosen.hi)
                continue
            del open_[n]
    for n, s in open_.items():
        found[n] = _edge(s, s["lo"], False)
    return found


def _edge(state: dict, at: float, after: bool) -> tuple[float, float]:
    """The cut (value, tie) just before or after ``at``."""
    if state["value"] is None:
        return at, float("inf" if after else "-inf")
    return state["value"], math.nextafter(at, math.inf) if after else at


def _number(x: float) -> str:
    return f"{x!r}D" if math.isfinite(x) else f"double('{x}')"


def _descend(cut: dict[int, tuple]) -> Column:
    """The node of the next level."""
    beyond = [f"WHEN node = {n} THEN CAST({dim} > {_number(value)} OR {dim} = {_number(value)} AND tie >= {_number(tie)} AS INT)"
              for n, (dim, value, tie) in cut.items() if value is not None]
    return F.expr(f"node * 2 + CASE {' '.join(beyond)} ELSE 0 END" if beyond else "node * 2")
