"""Mixing sources to target weights by pivotal dependent rounding.

Each document has a wished number of copies, the same for all documents of a source. The whole part is taken; of the fractional part,
counted in words, pairs of documents pass mass to each other at random until one of them holds a whole copy or none. What remains open
in a chunk is one document, and the open documents of all chunks meet again in the next level of a reduction tree. So the words taken from a
source differ from its target by less than one document, and each document's expected number of copies is the wished one.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetsift.llm.common import WORD, fresh, materialise, unit

#: Sources by code point get these weights, again and again.
WEIGHTS = (1, 2, 3)
#: A document is taken so many times at most.
MOST = 3


def word_count(text: Column) -> Column:
    """Words of the whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, size): shares by weight, none above ``MOST`` times the source's size.

    The common level is raised until no source exceeds its bound: sources that do are held at it, and the others share the rest. Each
    step is one aggregate over the sources. They are ranked in one window, which holds one row per source, not per document; null is
    the last source. No source, or none with words: targets of 0.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank % len(WEIGHTS) + 1).cast("int"))
    totals = materialise(sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", weight), "sources")
    bound = F.col("source_size") * MOST
    total = totals.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        held = bound <= F.col("weight") * F.lit(level)
        fixed, free = totals.agg(F.sum(F.when(held, bound).otherwise(0)), F.sum(F.when(held, 0).otherwise(F.col("weight")))).first()
        if not free:
            break
        raised = (total - fixed) / free
        if raised <= level:
            break
        level = raised
    return totals.select("source", "source_size", F.least(F.col("weight") * F.lit(level), bound.cast("double")).alias("target"))


def mix(docs: DataFrame, chunk: int = 256, seed: int = 11) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken and key for every row of ``docs``.

    ``key`` is the hash of the text. Rows with the same doc_id, text and source are told apart by a running number, so repeated rows are
    rounded one by one. Documents without words, and all documents of a source whose target is 0, get no copy. A null source is a
    source of its own; a null doc_id is a value like any other. Reruns give the same rows.
    """
    rows = docs.select("doc_id", "source", F.xxhash64("text").alias("key"), word_count(F.col("text")).alias("size"))
    same = Window.partitionBy("doc_id", "key", "source").orderBy("size")
    rows = materialise(rows.withColumn("copy", F.row_number().over(same)), "sizes")
    # one row per source and at most a few counts: Spark ships it if it is small and else splits the join at a large source
    wished = materialise(targets(rows).withColumn("wish", F.when(F.col("source_size") > 0, F.least(
        F.col("target") / F.col("source_size"), F.lit(float(MOST)))).otherwise(0.0)), "targets")
    rows = rows.alias("r").join(wished.alias("w"), F.col("r.source").eqNullSafe(F.col("w.source"))).select("r.*", "source_size", "target", "wish")
    rows = rows.withColumn("wish", F.when(F.col("size") > 0, F.col("wish")).otherwise(0.0))
    rows = rows.withColumn("whole", F.floor("wish")).withColumn("mass", (F.col("wish") - F.col("whole")) * F.col("size"))
    rows = materialise(rows, "wishes")
    member = F.struct("size", "mass", "doc_id", "key", "copy")
    open_ = rows.filter("mass > 0").select("source", member.alias("m"))
    settled = _reduce(open_, chunk, seed)
    extra = settled.select("source", "m.doc_id", "m.key", "m.copy", F.col("more"))
    keys = [F.col(f"r.{c}").eqNullSafe(F.col(f"x.{c}")) for c in ("doc_id", "key", "copy", "source")]
    out = rows.alias("r").join(extra.alias("x"), keys[0] & keys[1] & keys[2] & keys[3], "left").select(
        "r.*", (F.col("whole") + F.coalesce("more", F.lit(0))).cast("long").alias("copies"))
    return out.select("doc_id", "source", "key", "copy", "size", "source_size", "target", "copies",
                      (F.col("copies") * F.col("size")).alias("taken"))


def _reduce(open_: DataFrame, chunk: int, seed: int) -> DataFrame:
    """(source, m, more): for each open document whether it gets one copy more."""
    done = None
    level = 0
    while True:
        counts = open_.groupBy("source").count()
        most = counts.agg(F.max("count")).first()[0] or 0
        # Chunks by hash, small enough for one array; the last level has one chunk for each source.
        chunks = 1 if most <= chunk else -(-most * 2 // chunk)
        dealt = open_.withColumn("chunk", F.pmod(F.xxhash64("m.doc_id", "m.key", "m.copy", F.lit(seed), F.lit(level)), F.lit(chunks)))
        folded = dealt.groupBy("source", "chunk").agg(F.collect_list("m").alias("ms"))
        # the largest first, so that what remains open is likely a small document
        folded = folded.withColumn("ms", F.reverse(F.array_sort("ms"))).withColumn("f", _fold(F.col("ms"), seed + 1000 * level))
        folded = materialise(folded.select("source", "f"), "rounding")
        # explode first and then unnest, to keep the rows of a chunk apart from its open document
        now = folded.select("source", F.explode("f.done").alias("d")).select("source", "d.m", "d.more")
        done = now if done is None else done.unionByName(now)
        open_ = folded.select("source", F.col("f.open").alias("m")).filter("m.mass > 0 AND m.mass < m.size")
        last = folded.select("source", F.col("f.open").alias("m")).filter("m.mass <= 0 OR m.mass >= m.size")
        done = done.unionByName(last.select("source", "m", (F.col("m.mass") > 0).cast("int").alias("more")))
        if chunks == 1:
            break
        level += 1
    u = unit(F.col("m.doc_id"), F.col("m.key"), F.col("m.copy"), F.lit(seed), F.lit(-1))
    rest = open_.select("source", "m", (u * F.col("m.size") < F.col("m.mass")).cast("int").alias("more"))
    return done.unionByName(rest)


def _fold(members: Column, seed: int) -> Column:
    """Fold the documents of a chunk: struct(open, done).

    In each step the open document and the next one exchange mass. ``up`` is what can move to the open one until it has a whole copy or
    the other has none, ``down`` the other way; the direction is drawn so that the expected mass of both stays as it is.
    """
    kind = ("struct<open:struct<size:bigint,mass:double,doc_id:bigint,key:bigint,copy:int>,"
            "done:array<struct<m:struct<size:bigint,mass:double,doc_id:bigint,key:bigint,copy:int>,more:int>>>")

    def step(state, m):
        a = state["open"]
        up = F.least(a["size"] - a["mass"], m["mass"])
        down = F.least(a["mass"], m["size"] - m["mass"])
        rise = unit(a["doc_id"], a["key"], a["copy"], m["doc_id"], m["key"], m["copy"], F.lit(seed)) * (up + down) < down
        fills = a["size"] - a["mass"] <= m["mass"]
        drains = a["mass"] <= m["size"] - m["mass"]

        def settle(x, more):
            return F.concat(state["done"], F.array(F.struct(x.alias("m"), F.lit(more).alias("more"))))

        def keep(x, mass):
            return F.struct(x["size"].alias("size"), mass.alias("mass"), x["doc_id"].alias("doc_id"), x["key"].alias("key"), x["copy"].alias("copy"))

        def to(open_doc, settled):
            return F.struct(open_doc.alias("open"), settled.alias("done")).cast(kind)

        return F.when(rise & fills, to(keep(m, m["mass"] - up), settle(a, 1))) \
            .when(rise, to(keep(a, a["mass"] + up), settle(m, 0))) \
            .when(drains, to(keep(m, m["mass"] + down), settle(a, 0))) \
            .otherwise(to(keep(a, a["mass"] - down), settle(m, 1)))

    start = F.struct(members[0].alias("open"), F.array().cast("array<struct<m:struct<size:bigint,mass:double,doc_id:bigint,key:bigint,copy:int>,"
                                                              "more:int>>").alias("done")).cast(kind)
    return F.aggregate(F.slice(members, 2, F.size(members)), start, step)


def mixed(docs: DataFrame, chunk: int = 256, seed: int = 11) -> DataFrame:
    """The mix itself: each row of ``docs``, with its columns, as often as it is taken."""
    key, n, copies, p_id, p_key, p_source = fresh(docs, "key", "n", "copies", "p_id", "p_key", "p_source")
    plan = mix(docs, chunk, seed).groupBy("doc_id", "key", "source").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("copy", "copies"))), lambda x: x["copies"]).alias(copies))
    plan = materialise(plan.select(F.col("doc_id").alias(p_id), F.col("key").alias(p_key), F.col("source").alias(p_source), copies), "mix")
    keyed = docs.withColumn(key, F.xxhash64("text"))
    joined = keyed.join(plan, keyed["doc_id"].eqNullSafe(plan[p_id]) & (keyed[key] == plan[p_key])
                        & keyed["source"].eqNullSafe(plan[p_source])).drop(p_id, p_key, p_source)
    others = [c for c in docs.columns if c not in ("doc_id", "source", "text")]
    same = Window.partitionBy("doc_id", key, "source").orderBy(*(others or [key]))
    counted = joined.withColumn(n, F.row_number().over(same)).withColumn(n, F.element_at(copies, F.col(n)))
    return counted.filter(F.col(n) > 0).withColumn(n, F.explode(F.array_repeat(F.lit(1), F.col(n).cast("int")))).select(*docs.columns)
