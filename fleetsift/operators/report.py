"""Triage report: facets, counts, top lists, search and paging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetsift.functions.addresses import is_external

LEVELS = ["critical", "high", "medium", "low", "informational"]
BARS = 8
# Event categories and their event ids.
EVENT_CATEGORIES = {
    "Group Enumeration": [4798, 4799],
    "RDP Logins": [4624, 4778],
    "RDP Auths": [1149],
    "Outgoing RDP": [1102],
    "Created Users": [4720],
    "Password Resets": [4724],
    "Added to Group": [4732, 4728],
    "Enabled Users": [4722],
    "Disabled Users": [4723],
    "Deleted Users": [4726],
    "Locked Out Users": [4740],
    "Cred Manager Backup": [5376],
    "Cred Manager Restore": [5377],
    "Logon Events": [4624],
    "Failed Logon Events": [4625],
    "Object Access Events": [4656, 4663],
    "Process Execution Events": [4688],
}
# The two categories whose ids belong to terminal-services logs; those of all others belong to the security log.
CATEGORY_LOGS = {
    "RDP Auths": "Microsoft-Windows-TerminalServices-RemoteConnectionManager/Operational",
    "Outgoing RDP": "Microsoft-Windows-TerminalServices-RDPClient/Operational",
}


def level_of(column: str = "RuleLevel") -> Column:
    """Level in lower case; a missing or empty one is informational."""
    level = F.coalesce(F.col(column), F.lit(""))
    return F.lower(F.when(level == "", "informational").otherwise(level))


def level_facets(findings: DataFrame) -> DataFrame:
    """Count of all findings and of each known level, zero included; unknown levels count only in ``all``."""
    counts = findings.groupBy(level_of().alias("level")).agg(F.count(F.lit(1)).alias("n"))
    named = {"all": F.sum("n"), **{x: F.sum(F.when(F.col("level") == x, F.col("n"))) for x in LEVELS}}
    row = counts.agg(*[F.coalesce(total, F.lit(0)).cast("long").alias(name) for name, total in named.items()])
    return row.unpivot([], list(named), "level", "findings")


def level_filter(findings: DataFrame, level: str = "all") -> DataFrame:
    """Findings of one level, or all of them."""
    return findings if level == "all" else findings.filter(level_of() == level.lower())


def _holds(columns: list[str], query: str) -> Column:
    if not query:
        return F.lit(True)
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns]
    return F.contains(F.lower(F.concat_ws(" ", *cells)), F.lit(query.lower()))


def table_search(table: DataFrame, columns: list[str], query: str) -> DataFrame:
    """Rows whose chosen columns, joined by blanks, contain the query without regard to case."""
    return table.filter(_holds(columns, query))


def finding_search(findings: DataFrame, query: str, level: str = "all") -> DataFrame:
    """Findings of a level that contain the query."""
    return table_search(
        level_filter(findings, level), ["RuleTitle", "User", "Process", "CommandLine", "RuleTags", "EventId"], query)


def event_search(events: DataFrame, query: str, category: str = "all") -> DataFrame:
    """Event rows of a category that contain the query."""
    chosen = events if category == "all" else events.filter(F.col("Category") == category)
    return table_search(chosen, ["EventId", "User", "Category", "Message"], query)


def category_facets(events: DataFrame) -> DataFrame:
    """Events per category."""
    return events.groupBy("Category").agg(F.count(F.lit(1)).alias("events"))


def event_id_counts(events: DataFrame) -> DataFrame:
    """Events per event id, as ``EID n`` labels."""
    counts = events.groupBy("EventId").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.concat(F.lit("EID "), F.col("EventId").cast("string")).alias("label"), "n")


def event_categories(event_log: DataFrame, per_log: bool = True) -> DataFrame:
    """(label, n) of the event categories that occur; an id may count for several categories.

    An id counts only in the log of its category; without ``per_log``, for a table of one log under another name, in any.
    """
    rows = [
        (label, eid, CATEGORY_LOGS.get(label, "Security") if per_log else None)
        for label, ids in EVENT_CATEGORIES.items() for eid in ids
    ]
    known = event_log.sparkSession.createDataFrame(rows, "label string, event_id int, _log string")
    counts = event_log.filter(F.col("event_id").isin(sorted({r[1] for r in rows}))).groupBy("event_id", "log_name").agg(
        F.count(F.lit(1)).alias("_n"))
    joined = counts.join(F.broadcast(known), "event_id").filter(
        F.col("_log").isNull() | (F.col("_log") == F.col("log_name")))
    return joined.groupBy("label").agg(F.sum("_n").alias("n"))


def event_id_allocation(category_counts: DataFrame) -> DataFrame:
    """Category counts spread evenly over their ids, each share cut down to a whole number, summed per id."""
    ids = F.create_map(*[x for label, eids in EVENT_CATEGORIES.items()
                         for x in (F.lit(label), F.array(*[F.lit(e) for e in eids]))])
    spread = category_counts.filter(F.col("n") > 0).withColumn("_ids", ids[F.col("label")])
    share = F.floor(F.col("n") / F.size("_ids"))
    return spread.select(share.alias("_share"), F.explode("_ids").alias("_id")).groupBy("_id").agg(
        F.sum("_share").alias("n")).select(F.concat(F.lit("EID "), F.col("_id").cast("string")).alias("label"), "n")


def top_bars(counts: DataFrame, bars: int = BARS) -> DataFrame:
    """The largest counts, with their length in per cent of the largest; equal counts go by label."""
    top = counts.orderBy(F.col("n").desc(), F.col("label")).limit(bars)
    largest = F.greatest(F.max("n").over(Window.partitionBy()), F.lit(1))
    return top.select("label", "n", F.floor(F.col("n") / largest * 100 + F.lit(0.5)).cast("long").alias("pct"))


def _tagged(rule_hits: DataFrame, hash_hits: DataFrame, ioc_hits: DataFrame) -> DataFrame:
    sets = {"rule": rule_hits, "hash": hash_hits, "ioc": ioc_hits}
    return reduce(DataFrame.unionByName, [df.select("RuleLevel", F.lit(k).alias("kind")) for k, df in sets.items()])


def overview_kpis(rule_hits: DataFrame, hash_hits: DataFrame, ioc_hits: DataFrame) -> DataFrame:
    """Headline numbers. Critical counts rule and hash findings only."""
    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, 1)), F.lit(0)).cast("long")

    kind, level = F.col("kind"), F.lower(F.coalesce("RuleLevel", F.lit("")))
    return _tagged(rule_hits, hash_hits, ioc_hits).agg(
        F.count(F.lit(1)).alias("total"), total((level == "critical") & (kind != "ioc")).alias("critical"),
        total(kind == "rule").alias("rule_hits"), total(kind == "hash").alias("hash_hits"),
        total(kind == "ioc").alias("ioc_hits"),
    )


def severity_distribution(rule_hits: DataFrame, hash_hits: DataFrame, ioc_hits: DataFrame) -> DataFrame:
    """Findings per level over all three sets. Only the first letter is changed, so spellings stay apart."""
    level = F.when(F.coalesce("RuleLevel", F.lit("")) == "", "informational").otherwise(F.col("RuleLevel"))
    label = F.concat(F.upper(F.substring(level, 1, 1)), F.substring(level, F.lit(2), F.length(level)))
    return _tagged(rule_hits, hash_hits, ioc_hits).groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


def network_cards(connections: DataFrame, listening: DataFrame | None = None) -> DataFrame:
    """Established, listening and external connections.

    Without a separate table of listening sockets, those are the connections in state ``listen``.
    """
    state = F.lower(F.trim(F.coalesce("state", F.lit(""))))

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, 1)), F.lit(0)).cast("long")

    rows = connections.select(
        (state == "established").alias("_up"), is_external(F.col("remote_addr")).alias("_out"),
        (state == "listen" if listening is None else F.lit(False)).alias("_open"))
    if listening is not None:
        rows = rows.unionAll(listening.select(F.lit(False), F.lit(False), F.lit(True)))
    return rows.agg(
        total(F.col("_up")).alias("established"), total(F.col("_open")).alias("listening"),
        total(F.col("_out")).alias("external"))


def artifact_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per artifact table, zero for empty ones."""
    return reduce(DataFrame.unionByName, [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("artifact"), "rows")
        for name, df in tables.items()
    ])


def artifact_rows(table: DataFrame, artifact: str, host: str = "host") -> DataFrame:
    """Any table as (host, artifact, row) rows of one tagged artifact table."""
    cells = [x for c in table.columns if c != host for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]
    return table.select(F.col(host).alias("host"), F.lit(artifact).alias("artifact"), F.create_map(*cells).alias("row"))


# --- paging -----------------------------------------------------------------------------------------------------------

DEEP = 100_000
SPLITS = 16


def _before(keys: list[tuple[str, bool]], bound: tuple) -> Column:
    """Whether a row sorts strictly before a bound, column by column. NULLs come first upwards and last downwards."""
    out = F.lit(False)
    for (name, descending), value in reversed(list(zip(keys, bound))):
        col = F.col(name)
        if value is None:
            ahead, same = (col.isNotNull() if descending else F.lit(False)), col.isNull()
        else:
            edge = F.lit(value)
            ahead = F.coalesce(col > edge, F.lit(False)) if descending else F.coalesce(col < edge, F.lit(True))
            same = col.eqNullSafe(edge)
        out = ahead | (same & out)
    return out


def _narrow(
    table: DataFrame, keys: list[tuple[str, bool]], order: list[Column], start: int, size: int, total: int
) -> tuple[DataFrame, int, int]:
    """The ranges of sort keys that hold rows ``start`` to ``start + size``: the rows, where the page begins in them, and
    how many they are.

    The bounds come from a sample; they only decide how much is left to sort, not which rows the page has.
    """
    names = [n for n, _ in keys]
    fraction = min(1.0, 100.0 * SPLITS / total)
    sample = table.select(*names).sample(fraction, seed=7).orderBy(*order).limit(200 * SPLITS).collect()
    bounds = list(dict.fromkeys(tuple(sample[i * len(sample) // SPLITS]) for i in range(1, SPLITS))) if sample else []
    bucket = reduce(lambda a, b: a + b, [(~_before(keys, b)).cast("int") for b in bounds], F.lit(0))
    counts = {r.b: r.n for r in table.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
    first, last, skipped, held, seen = None, 0, 0, 0, 0
    for b in range(len(bounds) + 1):
        rows = counts.get(b, 0)
        if first is None and seen + rows > start:
            first, skipped = b, seen
        if first is not None and seen < start + size:
            last, held = b, held + rows
        seen += rows
    keep = F.lit(True)
    if first:
        keep = ~_before(keys, bounds[first - 1])
    if last < len(bounds):
        keep = keep & _before(keys, bounds[last])
    return table.filter(keep), start - skipped, held


def page(table: DataFrame, order: list[str], number: int, size: int = 25, deep: int = DEEP) -> DataFrame:
    """One page of a table in a total order (``-name`` sorts downwards); a page past the end is the last page.

    A page near either end is a top-k from that end. One further in is first narrowed to the range of sort keys that
    holds it, so the rows before it are counted but never sorted or moved. NULLs come first upwards and last downwards.
    """
    total = table.count()
    pages = max(1, -(-total // size))
    start = (min(max(number, 1), pages) - 1) * size
    rows = max(0, min(size, total - start))
    keys = [(n.lstrip("-"), n.startswith("-")) for n in order]
    down = [F.col(n).desc() if d else F.col(n).asc() for n, d in keys]
    up = [F.col(n).asc() if d else F.col(n).desc() for n, d in keys]
    while min(start, total - start - rows) > deep:
        table, start, held = _narrow(table, keys, down, start, rows, total)
        if held == total:
            break
        total = held
    after = total - start - rows
    if after < start:
        return table.orderBy(*up).offset(after).limit(rows).orderBy(*down)
    return table.orderBy(*down).offset(start).limit(rows)


def page_info(table: DataFrame, size: int = 25) -> DataFrame:
    """Row and page counts."""
    rows = F.count(F.lit(1))
    return table.agg(rows.alias("rows"), F.greatest(F.ceil(rows / size), F.lit(1)).cast("long").alias("pages"))
