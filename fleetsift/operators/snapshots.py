"""Captured command output as tables: one positional parser and a table of layouts."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetsift.sources.sinks import NO_MATCHES

BLANKS = r"[ \t]+"


@dataclass(frozen=True)
class Layout:
    """Where the columns of a capture are.

    ``columns`` gives each column its first and last field (1-based). ``limit`` stops splitting, so that the last field
    keeps the rest of the line. ``skip`` drops leading lines, ``keep`` is a regex that lines must match.
    """

    columns: dict[str, tuple[int, int]] = field(hash=False)
    separator: str = BLANKS
    limit: int = -1
    skip: int = 0
    keep: str | None = None


def _layout(columns: str, **options) -> Layout:
    """Columns as text: a name alone takes the next field, ``name:3`` or ``name:4-8`` places it."""
    placed, nxt = {}, 1
    for item in columns.split():
        name, _, where = item.partition(":")
        first, _, last = where.partition("-")
        start = int(first) if first else nxt
        end = int(last) if last else start
        placed[name] = (start, end)
        nxt = end + 1
    return Layout(placed, **options)


PASSWD = "username password uid gid full_name home shell"
LS = "permissions links owner group size month day time name"
LAYOUTS = {
    "route": _layout("destination:1 gateway:3 iface:5"),
    "ps": _layout("user pid cpu mem vsz rss tty stat start time command", limit=11, skip=1),
    "ss": _layout("state recv_q send_q local peer process", limit=6, skip=1),
    "iptables": _layout("chain rule", limit=2),
    "hosts": _layout("ip hostname"),
    "w": _layout("user tty from login idle jcpu pcpu what", limit=8, skip=2),
    "passwd": _layout(PASSWD, separator=":"),
    "login_shells": _layout(PASSWD, separator=":", keep=r"sh\z"),
    "key_value": _layout("property value", separator=":", limit=2),
    "lsblk": _layout("name maj_min rm size ro type mountpoint", limit=7),
    "lsusb": _layout("bus:2 device:4 id:6", keep="Bus"),
    "unit_files": _layout("unit state"),
    "timers": _layout("next:1-2 left:3 last:4-5 unit:6 timer:7"),
    "cron": _layout("user crontab", separator=":", limit=2),
    "last": _layout("user tty from login:4-8 logout:9-13 duration:14 host_name:15 ip:16"),
    "lsmod": _layout("module size used_by", skip=1),
    "getcap": _layout("file capabilities", limit=2),
    "ls": _layout(LS, limit=9, keep=r"\A[-bcdlps]"),
}


def _trimmed(value: Column) -> Column:
    return F.regexp_replace(F.coalesce(value, F.lit("")), r"\A[ \t]+|[ \t]+\z", "")


def parse_capture(
    captures: DataFrame, layout: Layout | str, capture: str | None = None, extra: list[Column] = ()
) -> DataFrame:
    """Lines of a capture as a table of strings beside ``host`` and ``line_no``; missing fields are empty.

    ``extra`` are further named columns over the input line.
    """
    layout = LAYOUTS[layout] if isinstance(layout, str) else layout
    lines = captures.filter(F.col("capture") == capture) if capture is not None else captures
    if layout.skip:
        lines = lines.filter(F.col("line_no") > layout.skip)
    if layout.keep:
        lines = lines.filter(F.col("line").rlike(layout.keep))
    by_blank = layout.separator == BLANKS
    parts = F.split(_trimmed(F.col("line")) if by_blank else F.col("line"), layout.separator, layout.limit)
    fields = lines.select("host", "line_no", parts.alias("_f"), *extra)
    more = [c for c in fields.columns if c not in ("host", "line_no", "_f")]

    def column(first: int, last: int) -> Column:
        if first == last:
            return _trimmed(F.get("_f", F.lit(first - 1)))
        return F.array_join(F.slice("_f", first, last - first + 1), " ")

    return fields.select(
        "host", "line_no", *[column(*span).alias(name) for name, span in layout.columns.items()], *more)


def parse_lines(captures: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Captures that have no columns, as numbered lines."""
    kept = captures.filter(F.col("capture").isin(names)) if names is not None else captures
    return kept.select("host", "capture", "line_no", F.col("line").alias("content"))


def split_address(address: Column) -> tuple[Column, Column]:
    """An ``address:port`` text cut at its last colon."""
    return F.regexp_extract(address, r"\A(.*):[^:]*\z", 1), F.regexp_extract(address, r":([^:]*)\z", 1)


def parse_ss(captures: DataFrame, capture: str | None = None) -> DataFrame:
    """Socket listing with local and remote addresses and ports."""
    table = parse_capture(captures, "ss", capture)
    local, peer = split_address(F.col("local")), split_address(F.col("peer"))
    return table.withColumns({
        "local_addr": local[0], "local_port": local[1], "remote_addr": peer[0], "remote_port": peer[1]})


def parse_lsusb(captures: DataFrame, capture: str | None = None) -> DataFrame:
    """USB devices; the description is what follows the first colon."""
    description = _trimmed(F.regexp_extract("line", r"\A[^:]*:(.*)\z", 1)).alias("description")
    return parse_capture(captures, "lsusb", capture, [description])


def parse_indent(captures: DataFrame, capture: str | None = None) -> DataFrame:
    """Indented output: nesting level (two blanks each) and text."""
    lines = captures.filter(F.col("capture") == capture) if capture is not None else captures
    lead = F.length(F.regexp_extract("line", r"\A( *)", 1))
    return lines.select("host", "line_no", F.floor(lead / 2).cast("long").alias("level"), F.col("line").alias("content"))


def parse_key_value(captures: DataFrame, capture: str | None = None) -> DataFrame:
    """``property: value`` lines cut at the first colon; a line without one is both, as ``cut`` prints it."""
    lines = captures.filter(F.col("capture") == capture) if capture is not None else captures
    first_colon = F.instr("line", ":")
    head = F.when(first_colon > 0, F.substring_index("line", ":", 1)).otherwise(F.col("line"))
    tail = F.when(first_colon > 0, F.expr("substring(line, instr(line, ':') + 1)")).otherwise(F.col("line"))
    return lines.select("host", "line_no", _trimmed(head).alias("property"), _trimmed(tail).alias("value"))


def login_shell_users(captures: DataFrame, capture: str | None = None) -> DataFrame:
    """Accounts whose passwd line ends in ``sh``."""
    return parse_capture(captures, "login_shells", capture)


def sudo_group(captures: DataFrame, capture: str | None = None) -> DataFrame:
    """Members of the sudo group."""
    lines = captures.filter(F.col("capture") == capture) if capture is not None else captures
    members = F.coalesce(F.get(F.split("line", ":"), F.lit(3)), F.lit(""))
    return lines.filter(F.startswith("line", F.lit("sudo:"))).select(
        "host", "line_no", F.col("line").alias("content"), F.explode_outer(
            F.filter(F.split(members, ","), lambda m: F.trim(m) != "")).alias("member"))


def parse_getcap(captures: dict[str, DataFrame]) -> DataFrame:
    """File capabilities of several search roots, tagged with the root."""
    return reduce(DataFrame.unionByName, [
        parse_capture(df, "getcap").withColumn("root", F.lit(root)) for root, df in captures.items()])


def persistence_union(captures: DataFrame, areas: list[str]) -> DataFrame:
    """Listings of all persistence areas as one table; the area is the capture they come from."""
    return parse_capture(captures.filter(F.col("capture").isin(areas)), "ls", None, [F.col("capture").alias("area")])


# Where macOS keeps what starts by itself.
MACOS_AREAS = {
    "launch": r"\A/Library/Launch(Agents|Daemons)/.*\.plist\z",
    "login_items": r"/Library/Preferences/(.*/)?com\.apple\.loginitems\.plist\z",
    "kernel_extensions": r"\A/Library/Extensions/.*\.kext\z",
}


def macos_persistence(listing: DataFrame) -> DataFrame:
    """Rows of an ``ls`` listing that name a persistence item, with the area they belong to. Reads ``name``."""
    area = F.lit(None).cast("string")
    for label, pattern in MACOS_AREAS.items():
        area = F.when(F.col("name").rlike(pattern), F.lit(label)).otherwise(area)
    return listing.withColumn("area", area).filter(F.col("area").isNotNull())


def admin_users(groups: DataFrame, column: str = "json") -> DataFrame:
    """Members of a group document ``{"users": [...]}``."""
    users = F.from_json(F.col(column), "users array<string>")["users"]
    keep = [c for c in groups.columns if c != column]
    return groups.select(*keep, F.explode(users).alias("username"))


def security_status(status: DataFrame, tools: list[str], ids: list[str]) -> DataFrame:
    """One column per tool turned into (tool, status) rows."""
    return status.unpivot(ids, tools, "tool", "status")


def parse_ioc_hits(hits: DataFrame, column: str = "value") -> DataFrame:
    """``indicator|source|line`` texts as three columns; the line may itself hold bars."""
    parts = F.split(column, r"\|", 3)
    empty = F.col(column) == NO_MATCHES
    return hits.select(
        F.when(empty, "None").otherwise(F.get(parts, F.lit(0))).alias("indicator"),
        F.when(empty, "N/A").otherwise(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("source"),
        F.when(empty, NO_MATCHES).otherwise(F.coalesce(F.get(parts, F.lit(2)), F.lit(""))).alias("line"),
    )
