"""Indicator matching. Containment is turned into joins on equal keys wherever the indicator has structure."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetsift.functions.literals import MAX_LITERAL_BYTES, MAX_LITERALS, can_ship, literal_ids
from fleetsift.functions.matching import text as matching_text
from fleetsift.operators.detect import field_sql
from fleetsift.operators.joins import is_small, lookup, salted_join
from fleetsift.operators.logs import days_before
from fleetsift.plans.rules import Rule, folds, inject_values, kind_of, map_matchers
from fleetsift.schemas import FINDING_COLUMNS, Source

BROWSERS = ["chrome.exe", "msedge.exe", "firefox.exe", "iexplore.exe", "opera.exe", "brave.exe"]
# Download verbs of the documented script rule.
DOWNLOAD_VERBS = ["DownloadString", "DownloadFile", "WebClient", "Invoke-WebRequest", "curl ", "wget "]
EXECUTABLE_CAPTURES = ["ps", "services", "systemctl", "cron", *[f"p{i}" for i in range(1, 10)]]
SHELL_CAPTURES = ["ps", "cron", *[f"p{i}" for i in range(1, 10)], "bashrc"]
GRAM = 6
# Lists a long one is cut into, each searched for in a pass over the rows; beyond, the join by grams moves less.
MAX_SHARDS = 8
# Of the filter before that join: one bit in sixteen is set at most; words of 64 bits that may be broadcast.
BITS_PER_GRAM = 16
MAX_FILTER_WORDS = 4 << 20


# --- lists ------------------------------------------------------------------------------------------------------------

def ioc_merge(*lists: DataFrame) -> DataFrame:
    """Custom and downloaded lists as one lookup set."""
    return reduce(DataFrame.unionByName, lists).distinct()


def driver_list(indicators: DataFrame, rows: int = MAX_LITERALS, size: int = MAX_LITERAL_BYTES) -> list[str]:
    """The distinct indicators as a Python list, to be compiled into a rule; refuses a list beyond the limits."""
    distinct = indicators.select("indicator").distinct()
    if not is_small(distinct, rows, size):
        raise ValueError(f"more than {rows} indicators: match them with match_literals, or add them to a rule with inject_indicators")
    return sorted(r.indicator for r in distinct.collect() if r.indicator)


# --- hashes -----------------------------------------------------------------------------------------------------------

def hash_extract(events: DataFrame, hashes: str = "Hashes") -> DataFrame:
    """One row per ``ALGO=value`` pair of a hash string, both in lower case."""
    pair = F.split(F.col("_pair"), "=", 2)
    keep = [c for c in events.columns if c != hashes]
    return events.select(*keep, F.explode(F.split(F.col(hashes), ",")).alias("_pair")).select(
        *keep, F.lower(F.trim(F.get(pair, F.lit(0)))).alias("algo"), F.lower(F.trim(F.get(pair, F.lit(1)))).alias("hash"),
    ).filter(F.coalesce(F.col("hash"), F.lit("")) != "")


def hash_match(hashed: DataFrame, bad: DataFrame) -> DataFrame:
    """Rows whose hash is on the list."""
    wanted = bad.select(F.lower("hash").alias("hash")).distinct()
    return lookup(hashed.withColumn("hash", F.lower("hash")), wanted, ["hash"], "left_semi")


def hit_findings(hits: DataFrame, title: str, level: str, layer: str, matched: str, **columns: Column) -> DataFrame:
    """Hits of a hash or indicator layer as findings: the columns of ``detect``, so that the report reads all three sets alike.

    ``matched`` is the column with the hash or indicator and ends the title; ``layer`` is the source. ``columns`` gives further finding
    columns from those of the hits; text columns left out are N/A, host and the numbers null.
    """
    given = {"SourceId": F.lit(layer), "RuleTitle": F.concat(F.lit(f"{title}: "), F.col(matched)), "RuleLevel": F.lit(level),
             "RuleTags": F.lit(""), **columns}
    blank = {"host": "string", "RecordId": "bigint", "EventId": "int"}
    names = ["host", "SourceId", "RecordId", *FINDING_COLUMNS]
    missing = {c: F.lit(None).cast(blank[c]) if c in blank else F.lit("N/A") for c in names}
    return hits.select(*[({**missing, **given})[c].alias(c) for c in names])


# --- addresses in history and connections -----------------------------------------------------------------------------

def url_host(url: Column) -> Column:
    """Host part of a URL in lower case; empty if there is none."""
    host = F.regexp_extract(F.lower(url), r"\A[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/:?#]+)", 1)
    return F.translate(host, "[]", "")


def parent_domains(host: Column) -> Column:
    """A host name and all its parents: c, b.c, a.b.c."""
    return F.transform(F.sequence(F.lit(1), F.size(F.split(host, r"\."))), lambda n: F.call_function(
        "substring_index", host, F.lit("."), -n))


def _kind(iocs: DataFrame, *kinds: str) -> DataFrame:
    return iocs.filter(F.col("kind").isin(*kinds)).select(F.lower("indicator").alias("indicator")).distinct()


def ioc_url_exact(history: DataFrame, iocs: DataFrame) -> DataFrame:
    """Visits to exactly a listed URL."""
    return lookup(history.withColumn("indicator", F.lower("url")), _kind(iocs, "url"), ["indicator"])


def ioc_domain(history: DataFrame, iocs: DataFrame) -> DataFrame:
    """Visits to exactly a listed host."""
    return lookup(history.withColumn("indicator", url_host(F.col("url"))), _kind(iocs, "domain", "ip"), ["indicator"])


def ioc_parent_domain(history: DataFrame, iocs: DataFrame) -> DataFrame:
    """Visits to a listed domain or anything below it."""
    walked = history.withColumn("indicator", F.explode(parent_domains(url_host(F.col("url")))))
    return lookup(walked, _kind(iocs, "domain"), ["indicator"])


def ioc_feed_url_only(history: DataFrame, iocs: DataFrame) -> DataFrame:
    """All browser layers. A downloaded feed counts for exact URLs only; its hosts are often shared platforms."""
    own = iocs.filter(F.col("list") == "custom")
    layers = [
        ioc_url_exact(history, iocs).withColumn("layer", F.lit("url")),
        ioc_domain(history, own.filter(F.col("kind") == "ip")).withColumn("layer", F.lit("ip")),
        ioc_parent_domain(history, own).withColumn("layer", F.lit("domain")),
    ]
    return reduce(DataFrame.unionByName, layers)


def ioc_network(connections: DataFrame, iocs: DataFrame, browsers: list[str] = BROWSERS) -> DataFrame:
    """Outbound connections of non-browser processes to an address or domain of the custom list.

    Reads ``Image``, ``DestinationIp``, ``DestinationHostname`` and ``Initiated``.
    """
    image = F.lower(F.regexp_extract(F.coalesce("Image", F.lit("")), r"([^\\/]*)\z", 1))
    outbound = connections.filter((F.lower("Initiated") == "true") & ~image.isin(browsers))
    hostname = F.lower(F.coalesce("DestinationHostname", F.lit("")))
    targets = F.array_distinct(F.concat(F.array(F.lower(F.coalesce("DestinationIp", F.lit("")))), parent_domains(hostname)))
    own = _kind(iocs.filter(F.col("list") == "custom"), "domain", "ip")
    return lookup(outbound.withColumn("indicator", F.explode(targets)), own, ["indicator"])


# --- literals in text -------------------------------------------------------------------------------------------------

def grams(value: Column, n: int) -> Column:
    """All distinct substrings of ``n`` characters."""
    return F.array_distinct(F.regexp_extract_all(value, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def _gram_join(rows: DataFrame, text: str, indicators: DataFrame) -> DataFrame:
    """Rows joined to the indicators they contain, for lists too long to ship to every task.

    Every indicator is filed under one of its grams, the one fewest other indicators share. Rows meet indicators through
    a join on that gram, carrying only a row hash, and each meeting is then checked against the text itself. Equal rows
    are folded into one for the joins and unfolded at the end.
    """
    n = F.least(F.length("needle"), F.lit(GRAM))
    needles = indicators.select("indicator", F.lower("indicator").alias("needle")).filter(F.col("needle") != "").distinct()
    sizes = [r.n for r in needles.select(n.alias("n")).distinct().collect()]
    by_size = [
        needles.filter(n == size).select("indicator", "needle", F.explode(grams(F.col("needle"), size)).alias("_gram"))
        for size in sizes
    ]
    if not by_size:
        return rows.withColumn("indicator", F.lit(None).cast("string")).limit(0)
    filed = reduce(DataFrame.unionByName, by_size)
    shared = filed.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    anchors = (
        filed.join(shared, "_gram").groupBy("indicator", "needle")
        .agg(F.min(F.struct("_n", "_gram"))["_gram"].alias("_gram"))
    )
    folded = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_copies"))
    keyed = folded.withColumn("_low", F.lower(F.coalesce(text, F.lit("")))).withColumn(
        "_row", F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x1e")) for c in rows.columns])))
    pieces = [keyed.select("_row", F.explode(grams(F.col("_low"), size)).alias("_gram")) for size in sizes]
    filed_as = anchors.select("indicator", "needle", "_gram")
    meetings = salted_join(
        _maybe_filed(reduce(DataFrame.unionByName, pieces), filed_as), filed_as, ["_gram"], "inner"
    ).select("_row", "indicator", "needle").distinct()
    met = keyed.join(meetings, "_row").filter(F.contains("_low", F.col("needle")))
    copies = F.explode(F.sequence(F.lit(1).cast("long"), "_copies")).alias("_copy")
    return met.select(*rows.columns, "indicator", copies).drop("_copy")


def _maybe_filed(pieces: DataFrame, anchors: DataFrame) -> DataFrame:
    """The grams that share a bit with an anchor's, the others dropped before any row moves; all true ones stay.

    There are at least ``BITS_PER_GRAM`` bits for each gram, so that a long list fills no more of them than a short one. The words of
    64 bits are counted before they are broadcast; beyond the limit the grams move untested.
    """
    grams_filed = anchors.select("_gram").distinct().count()
    bits = 1 << max(16, (BITS_PER_GRAM * grams_filed - 1).bit_length())
    slot = F.pmod(F.xxhash64("_gram"), F.lit(bits))
    word, mask = F.floor(slot / 64).alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))
    if min(bits // 64, grams_filed) > MAX_FILTER_WORDS:
        return pieces
    words = anchors.select(word, mask.alias("_mask")).groupBy("_word").agg(F.bit_or("_mask").alias("_bits"))
    tested = pieces.withColumns({"_word": word, "_mask": mask}).join(F.broadcast(words), "_word")
    return tested.filter(F.col("_bits").bitwiseAND(F.col("_mask")) != 0).select(*pieces.columns)


def match_literals(
    rows: DataFrame, text: str, indicators: DataFrame | list[str], max_shipped: int = MAX_LITERALS, max_shards: int = MAX_SHARDS
) -> DataFrame:
    """One row per (row, indicator contained in its text), ignoring case.

    A list whose size is checked travels to the tasks and is searched in one pass. A longer one is cut in up to ``max_shards`` such lists
    by the hash of the indicator, and the rows, which do not move, are searched once for each. Beyond that, rows and indicators are
    joined by grams.
    """
    if not isinstance(indicators, DataFrame):
        return _search_shipped(rows, text, indicators)
    distinct = indicators.select("indicator").filter(F.col("indicator") != "").distinct()
    if is_small(distinct, max_shipped, MAX_LITERAL_BYTES):
        return _search_shipped(rows, text, driver_list(distinct, max_shipped))
    size = distinct.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.lower("indicator"))).alias("b")).first()
    # filled to four fifths, as a hash does not deal evenly
    shards = -(-5 * max(-(-size.n // max_shipped), -(-size.b // MAX_LITERAL_BYTES)) // 4)
    if shards > max_shards:
        return _gram_join(rows, text, distinct)
    shard = F.pmod(F.xxhash64(F.lower("indicator")), F.lit(shards))
    lists = ([r.indicator for r in distinct.filter(shard == k).collect()] for k in range(shards))
    return reduce(DataFrame.unionByName, [_search_shipped(rows, text, listed) for listed in lists])


def _search_shipped(rows: DataFrame, text: str, indicators: list[str]) -> DataFrame:
    spelled: dict[str, list[str]] = {}
    for indicator in dict.fromkeys(i for i in indicators if i):
        spelled.setdefault(indicator.lower(), []).append(indicator)
    needles = list(spelled)
    if not can_ship(needles):
        return _gram_join(rows, text, rows.sparkSession.createDataFrame(
            [(name,) for names in spelled.values() for name in names], "indicator string"))
    if not needles:
        return rows.withColumn("indicator", F.lit(None).cast("string")).limit(0)
    low = rows.withColumn("_low", F.lower(F.coalesce(text, F.lit(""))))
    hit = low.withColumn("_id", F.explode_outer(literal_ids(F.col("_low"), needles))).filter(F.col("_id").isNotNull()).drop("_low")
    names = rows.sparkSession.createDataFrame(
        [(i, name) for i, needle in enumerate(needles) for name in spelled[needle]], "_id int, indicator string")
    return hit.join(F.broadcast(names), "_id").drop("_id")


# --- lists in rules ---------------------------------------------------------------------------------------------------

_TEXT_TESTS = ("contains", "exact", "startswith", "endswith")


def matched_values(values: DataFrame, indicators: DataFrame, operator: str, fold: bool) -> DataFrame:
    """The distinct non-empty ``value`` rows that some ``indicator`` matches literally, for lists of any length."""
    listed = indicators.select("indicator").filter(F.col("indicator") != "").distinct()
    if operator == "contains":
        met = match_literals(values, "value", listed)
        return (met if fold else met.filter(F.contains("value", F.col("indicator")))).select("value").distinct()
    form = F.lower if fold else F.col
    keys = listed.select(form("indicator").alias("_key")).distinct()
    if operator == "exact":
        return lookup(values.withColumn("_key", form("value")), keys, ["_key"], "left_semi").select("value").distinct()
    # one key per length that an indicator has, cut off the value's start or end
    lengths = [r.n for r in keys.select(F.length("_key").alias("n")).distinct().collect()]
    cut = F.left if operator == "startswith" else F.right
    parts = F.array_distinct(F.array(*[cut(form("value"), F.lit(n)) for n in lengths] or [F.lit("")]))
    return lookup(values.withColumn("_key", F.explode(parts)), keys, ["_key"], "left_semi").select("value").distinct()


def inject_indicators(
    events: DataFrame, rule: Rule, item: str, indicators: DataFrame, source: Source, max_compiled: int = MAX_LITERALS
) -> tuple[DataFrame, Rule, Source]:
    """Add indicators to a named item of a rule, as ``inject_values`` does, for a list of any length.

    A list of at most ``max_compiled`` entries becomes operands. Beyond that each matcher of the item gets an alternative: a column of the
    events that a join of the field's distinct values with the list sets. Indicators with wildcards stay operands, so
    that they keep their meaning; there may be ``max_compiled`` of them. Scan the returned events with the returned rule and source.
    """
    listed = indicators.select("indicator").distinct()
    if is_small(listed, max_compiled, MAX_LITERAL_BYTES):
        return events, inject_values(rule, item, driver_list(listed, max_compiled)), source
    wild = F.col("indicator").rlike(r"[*?]")
    flags: dict[tuple[str, str, bool], str] = {}

    def alternative(node: dict) -> dict:
        operator = str(node.get("operator", "")).lower()
        if kind_of(node) != "field" or operator not in _TEXT_TESTS or node.get("windash") or str(node.get("match") or "any").lower() == "all":
            raise ValueError("a list beyond the operand limit needs plain field matchers of which any value may match")
        key = (str(node.get("field", "")), operator, folds(node))
        name = flags.setdefault(key, f"_listed_{len(flags)}")
        return {"type": "any", "children": [node, {"type": "field", "field": name, "operator": "exact", "values": ["true"]}]}

    items = {name: map_matchers(tree, alternative) if str(name).lower() == item.lower() else tree for name, tree in rule.items.items()}
    for (field, operator, fold), name in flags.items():
        found = field_sql(source, field)
        if not found:
            events = events.withColumn(name, F.lit("false"))
            continue
        mine = F.col("log_name") == source.log_name
        value = F.when(mine, F.expr(matching_text(found[1])))
        values = events.select(value.alias("value")).filter(F.col("value") != "").distinct()
        hit = matched_values(values, listed.filter(~wild), operator, fold).select(F.sha2(F.col("value").cast("binary"), 256).alias("_key"), F.lit("true").alias(name))
        events = lookup(events.withColumn("_key", F.sha2(value.cast("binary"), 256)), hit, ["_key"], "left").drop("_key") \
            .withColumn(name, F.coalesce(name, F.lit("false")))
    source = replace(source, field_map={**source.field_map, **{name: ("column", name) for name in flags.values()}})
    return events, inject_values(replace(rule, items=items), item, driver_list(listed.filter(wild), max_compiled), skip=set(flags.values())), source


def ioc_text_match(captures: DataFrame, indicators: DataFrame | list[str], only: list[str] | None = None) -> DataFrame:
    """Distinct (host, indicator, source, line) rows of captured lines that contain an indicator."""
    lines = captures.filter(F.col("capture").isin(only)) if only is not None else captures
    rows = lines.select("host", F.col("capture").alias("source"), "line")
    return match_literals(rows, "line", indicators).select("host", "indicator", "source", "line").distinct()


def ioc_executables(captures: DataFrame, indicators) -> DataFrame:
    """Suspicious executables in process, service, timer and persistence captures."""
    return ioc_text_match(captures, indicators, EXECUTABLE_CAPTURES)


def ioc_shell_commands(captures: DataFrame, indicators) -> DataFrame:
    """Suspicious commands in process, cron, persistence and shell profile captures."""
    return ioc_text_match(captures, indicators, SHELL_CAPTURES)


def ioc_script(scripts: DataFrame, indicators: DataFrame | list[str], verbs: list[str] = DOWNLOAD_VERBS,
               text: str = "ScriptBlockText") -> DataFrame:
    """Script blocks that hold a domain or address of the custom list and a download verb.

    ``indicators`` are rows with ``indicator``, ``kind`` and ``list``, or a Python list taken from the custom one.
    """
    if isinstance(indicators, DataFrame):
        indicators = _kind(indicators.filter(F.col("list") == "custom"), "domain", "ip")
    low = F.lower(F.coalesce(text, F.lit("")))
    verb = reduce(lambda a, b: a | b, [F.contains(low, F.lit(v.lower())) for v in verbs])
    return match_literals(scripts.filter(verb), text, indicators)


# --- files ------------------------------------------------------------------------------------------------------------

def ransom_extensions(files: DataFrame, extensions: DataFrame) -> DataFrame:
    """One row per listed extension a file's path ends with. Extensions start with a dot, so the join is on equal suffixes."""
    name = F.regexp_extract("path", r"([^/\\]*)\z", 1)
    parts = F.split(name, r"\.")
    suffixes = F.transform(
        F.when(F.size(parts) > 1, F.sequence(F.lit(2), F.size(parts))).otherwise(F.array().cast("array<int>")),
        lambda i: F.concat(F.lit("."), F.array_join(F.slice(parts, i, F.size(parts)), ".")),
    )
    listed = extensions.select("extension").filter(F.startswith("extension", F.lit(".")))
    return lookup(files.withColumn("extension", F.explode(suffixes)), listed, ["extension"])


def susp_exec_location(files: DataFrame) -> DataFrame:
    """Executables below AppData, Temp or Downloads."""
    path = F.lower("path")
    return files.filter(
        path.rlike(r"[\\/](appdata|temp|downloads)[\\/]") & path.rlike(r"\.(exe|dll|scr|com|bat|cmd|ps1|msi)\z"))


def recent_files(files: DataFrame, as_of: str, days: int) -> DataFrame:
    """Files changed within some days before ``as_of``, newest first."""
    return files.filter(F.col("mtime") >= days_before(files, "mtime", as_of, days)).orderBy(
        F.col("mtime").desc(), F.col("path"))
