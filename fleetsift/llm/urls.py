"""URL filters by a temporal list join.

Dated list entries (a value was added or removed at a time) become validity intervals. An as-of join then evaluates every capture against
the entries that were active when it was fetched. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetsift.llm.common import materialise

#: Rank of the kinds of entries: the most specific active entry decides.
KINDS = {"url": 3, "host": 2, "domain": 1}


def host(url: Column) -> Column:
    """The host in lower case without user, port and final dot; null without one."""
    found = F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:\\\s]+)", 1)
    return F.nullif(F.regexp_replace(found, r"\.$", ""), F.lit(""))


def plain(url: Column) -> Column:
    """The URL that ``url`` entries name: without fragment and white space around it."""
    return F.regexp_replace(F.trim(url), "#.*$", "")


def intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, value, verdict, valid_from, valid_to) from (list, kind, value, verdict, action, at).

    An entry holds from its adding to the next removal; adding what holds and removing what does not change nothing, and a change of
    verdict ends one interval and begins another. At equal times the removal counts first, and an allowing entry before a blocking one: the
    last one stands. The end is exclusive and null while the entry holds. Rows with a null in kind, value, action or at are left
    out; a null list is a list of its own, and a verdict other than ``allow`` blocks.
    """
    known = entries.filter("kind IS NOT NULL AND value IS NOT NULL AND action IN ('add', 'remove') AND at IS NOT NULL")
    state = F.when(F.col("action") == "remove", 0).when(F.col("verdict") == "allow", 1).otherwise(2)
    # one state per time: the strongest; then only its changes, each up to the next change
    key = F.to_json(F.struct("list", "kind", "value"))
    marks = materialise(known.groupBy("list", "kind", "value", "at").agg(F.max(state).alias("state")).withColumn("key", key), "marks")
    # The marks of a frequent key are cut in as many slices of time as a slice has marks. What a slice needs from those around it
    # is one row for each slice: the last state before it and the first change after it.
    seconds = F.unix_seconds("at")
    busy = marks.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(seconds).alias("first"), F.max(seconds).alias("last")).filter("n > 64")
    busy = materialise(busy.select("key", "first", F.ceil((F.col("last") - F.col("first") + 1) / F.sqrt("n")).alias("width")), "busy")
    sliced = materialise(marks.join(busy, "key", "left").withColumn("slice", F.coalesce(F.floor((seconds - F.col("first")) / F.col("width")), F.lit(0)))
                         .drop("first", "width"), "marks")
    of_key, of_slice = Window.partitionBy("key").orderBy("slice"), Window.partitionBy("key", "slice").orderBy("at")
    ends = sliced.groupBy("key", "slice").agg(F.max_by("state", "at").alias("end"))
    ends = materialise(ends.select("key", "slice", F.coalesce(F.lag("end").over(of_key), F.lit(0)).alias("carried")), "ends")
    changed = sliced.join(ends, ["key", "slice"]).withColumn("was", F.coalesce(F.lag("state").over(of_slice), "carried")).filter("state <> was")
    changed = materialise(changed.drop("carried", "was"), "changes")
    starts = changed.groupBy("key", "slice").agg(F.min("at").alias("start"))
    starts = materialise(starts.select("key", "slice", F.lead("start").over(of_key).alias("later")), "starts")
    spans = changed.join(starts, ["key", "slice"]).withColumn("valid_to", F.coalesce(F.lead("at").over(of_slice), "later")).filter("state > 0")
    return spans.select("list", "kind", "value", F.when(F.col("state") == 1, "allow").otherwise("block").alias("verdict"),
                        F.col("at").alias("valid_from"), "valid_to")


def as_of(captures: DataFrame, spans: DataFrame, key: str, per_slice: int = 16) -> DataFrame:
    """``captures`` (with ``key`` and ``at``) joined with the spans of (``key``, valid_from, valid_to) that hold at ``at``.

    A key with many spans has its time cut in slices of about ``per_slice`` spans each; a span is repeated for the slices it
    reaches into, at most one more than there are spans and slices in all. So a capture meets a few spans, however often its key was listed,
    and the captures of a frequent key go to many tasks.
    """
    begin, end = F.unix_seconds("valid_from"), F.unix_seconds("valid_to")
    busy = spans.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(begin).alias("first"), F.max(F.greatest(begin, F.coalesce(end, begin))).alias("last"))
    busy = busy.filter(F.col("n") > per_slice).select(
        key, "first", "last", F.greatest(F.lit(1), F.ceil((F.col("last") - F.col("first") + 1) * per_slice / F.col("n"))).cast("long").alias("width"))
    busy = materialise(busy, "slices")

    def slice_of(seconds: Column) -> Column:
        inside = F.least(F.greatest(seconds, F.col("first")), F.col("last"))
        return F.coalesce(F.floor((inside - F.col("first")) / F.col("width")), F.lit(0))

    cut = spans.join(busy, key, "left").withColumn("slice", F.explode(F.sequence(
        slice_of(begin), F.when(F.col("width").isNull(), 0).otherwise(slice_of(F.coalesce(end, F.col("last")))))))
    cut = materialise(cut.drop("first", "last", "width"), "spans")
    dealt = captures.join(busy, key, "left").withColumn("slice", slice_of(F.unix_seconds("at"))).drop("first", "last", "width")
    held = (F.col("c.at") >= F.col("s.valid_from")) & (F.col("s.valid_to").isNull() | (F.col("c.at") < F.col("s.valid_to")))
    same = (F.col(f"c.{key}") == F.col(f"s.{key}")) & (F.col("c.slice") == F.col("s.slice")) & held
    return dealt.alias("c").join(cut.alias("s"), same).select("c.*", *[F.col(f"s.{n}") for n in spans.columns if n != key]).drop("slice")


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, url, fetched_at, blocked, list, kind, value, valid_from, valid_to for every row of (page_id, url, fetched_at).

    ``url`` entries name a whole URL without its fragment, ``host`` entries one host, ``domain`` entries a host and all hosts below it. The
    most specific active entry decides, the longer domain among domains; then an allowing one, then the first list by name, null first.
    Without an active entry, or with a null url or fetched_at, a capture is not blocked and the columns of the entry are null.
    Repeated captures are evaluated once and all get the verdict.
    """
    spans = materialise(intervals(entries), "intervals")
    asked = captures.select("url", F.col("fetched_at").alias("at")).filter("url IS NOT NULL AND fetched_at IS NOT NULL").distinct()
    asked = materialise(asked.withColumns({"host": host(F.col("url")), "plain": plain(F.col("url"))}), "captures")
    # a capture asks for its URL, its host, and its host with all parent domains
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    names = F.concat(F.array(F.concat(F.lit("url:"), F.col("plain"))), F.when(F.col("host").isNull(), F.array().cast("array<string>")).otherwise(
        F.concat(F.array(F.concat(F.lit("host:"), F.col("host"))), F.transform(parents, lambda p: F.concat(F.lit("domain:"), p)))))
    rank = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[F.col("kind")]
    keyed = spans.withColumn("name", F.concat_ws(":", "kind", "value"))
    hits = as_of(asked.select("url", "at", F.explode(names).alias("name")), keyed, "name").drop("name")
    best = F.struct((-rank).alias("a"), (-F.length("value")).alias("b"), (F.col("verdict") != "allow").alias("c"), F.col("list"), F.col("kind"),
                    F.col("value"), F.col("verdict"), F.col("valid_from"), F.col("valid_to"))
    chosen = materialise(hits.groupBy("url", "at").agg(F.min(best).alias("e")), "verdicts")
    told = captures.select("page_id", "url", "fetched_at").alias("p").join(
        chosen.alias("v"), (F.col("p.url") == F.col("v.url")) & (F.col("p.fetched_at") == F.col("v.at")), "left")
    return told.select("p.page_id", "p.url", "p.fetched_at", F.coalesce(F.col("e.verdict") == "block", F.lit(False)).alias("blocked"),
                       "e.list", "e.kind", "e.value", "e.valid_from", "e.valid_to")
