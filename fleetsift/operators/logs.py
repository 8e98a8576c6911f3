"""Log slices, audit queries and day-over-day comparison."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetsift.operators.history import LINES_PER_CHUNK
from fleetsift.operators.joins import lookup, salted_join

SYSTEM_ACCOUNTS = ["Guest", "Shared"]
LOG_FILES = ["auth.log", "syslog", "kern.log", "messages"]


def _literal(df: DataFrame, column: str, moment: datetime) -> Column:
    return F.lit(moment.strftime("%Y-%m-%d %H:%M:%S.%f")).cast(df.schema[column].dataType)


def days_before(df: DataFrame, column: str, as_of: str, days: int) -> Column:
    """The moment some days before ``as_of``, as a literal of the column's own type."""
    return _literal(df, column, datetime.fromisoformat(as_of) - timedelta(days=days))


_ISO = r"\A(\d{4}-\d{2}-\d{2})[ T](\d{2}:\d{2}:\d{2})(?:[.,]\d+)?(?:(Z)|([+-]\d{2}):?(\d{2}))?"
_SYSLOG = r"\A([A-Z][a-z]{2}) +(\d{1,2}) (\d{2}:\d{2}:\d{2})\b"
#: A year with every day of the calendar.
LEAP_YEAR = 2000


def _iso_time(line: Column) -> Column:
    def part(group: int) -> Column:
        return F.regexp_extract(line, _ISO, group)

    offset = F.when(part(4) != "", F.concat(part(4), F.lit(":"), part(5))).otherwise(part(3))
    return F.when(line.rlike(_ISO), F.try_to_timestamp(F.concat(part(1), F.lit(" "), part(2), offset)))


def _classic_time(line: Column, year: int) -> Column:
    def part(group: int) -> Column:
        return F.regexp_extract(line, _SYSLOG, group)

    text = F.concat_ws(" ", F.lit(f"{year:04d}"), part(1), F.lpad(part(2), 2, "0"), part(3))
    return F.when(line.rlike(_SYSLOG), F.try_to_timestamp(text, F.lit("yyyy MMM dd HH:mm:ss")))


def line_time(line: Column, year: int | None = None) -> Column:
    """The time a log line starts with, to the second; NULL if it starts with none.

    An offset counts if it is written; other times are in the session's time zone. Classic syslog times, which have no
    year, are read in ``year``, and are NULL without one.
    """
    found = _iso_time(line)
    return found if year is None else F.coalesce(found, _classic_time(line, year))


def with_line_time(lines: DataFrame, as_of: str | None = None, keys: list[str] = ("file",), position: str = "line_no", into: str = "time") -> DataFrame:
    """Lines with the time they start with as ``into``; the year of classic syslog times is inferred along each file.

    A log is written in the order of time, so where the date falls by more than a day from one timed line to the next, a year has
    passed; a smaller step back is a late line. The file's last timed line lies at most a day, the tolerance for clocks and
    zones, after the file's last change, the latest ``mtime`` of its lines, or else after ``as_of``. Without either, and for a date that
    the year does not have, the time is NULL. ``keys`` tell files apart and ``position`` orders their lines.

    Positions are cut in chunks as in ``carry_forward``: falls are counted within a chunk, and one row per chunk carries their number on. So a long
    file is spread over many tasks.
    """
    marked = lines.withColumns({"_iso": _iso_time(F.col("line")), "_classic": _classic_time(F.col("line"), LEAP_YEAR),
                                "_chunk": F.floor(F.col(position) / LINES_PER_CHUNK)})
    marked = marked.withColumn("_day", F.coalesce("_classic", _in_year(F.lit(LEAP_YEAR), F.col("_iso"))))
    within = Window.partitionBy(*keys, "_chunk").orderBy(position)
    before = F.last("_day", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, -1))
    counted = marked.withColumn("_fell", _fell(before, F.col("_day"))).withColumn(
        "_falls", F.sum("_fell").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    changed = F.max("mtime").cast("timestamp") if "mtime" in lines.columns else F.lit(None).cast("timestamp")
    at = F.when(F.col("_day").isNotNull(), F.col(position))
    chunks = counted.groupBy(*keys, "_chunk").agg(
        F.sum("_fell").alias("_inside"), F.min_by("_day", at).alias("_first"), F.max_by("_day", at).alias("_last"), changed.alias("_changed"))
    along, whole = Window.partitionBy(*keys).orderBy("_chunk"), Window.partitionBy(*keys)
    earlier = F.last("_last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    chunks = chunks.withColumn("_own", F.col("_inside") + _fell(earlier, F.col("_first"))).withColumn(
        "_start", F.sum("_own").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_inside"))
    last_day = F.last("_last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    anchor = F.coalesce(F.max("_changed").over(whole), F.lit(as_of).cast("timestamp")) + F.expr("INTERVAL 1 DAY")
    beyond = (F.date_format(last_day, "MMdd HHmmss") > F.date_format(anchor, "MMdd HHmmss")).cast("int")
    years = chunks.withColumn("_year", F.year(anchor) - beyond - F.sum("_own").over(whole) + F.col("_start")).select(*keys, "_chunk", "_year")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*keys, "_chunk")]
    placed = counted.alias("a").join(years.alias("b"), reduce(lambda x, y: x & y, same)).select("a.*", "b._year")
    classic = _in_year((F.col("_year") + F.col("_falls")).cast("int"), F.col("_classic"))
    return placed.withColumn(into, F.coalesce("_iso", classic)).drop("_iso", "_classic", "_day", "_chunk", "_fell", "_falls", "_year")


def _in_year(year: Column, moment: Column) -> Column:
    return F.try_make_timestamp(year, F.month(moment), F.dayofmonth(moment), F.hour(moment), F.minute(moment), F.second(moment))


def _fell(before: Column, day: Column) -> Column:
    """1 if the date falls by more than a day, -1 if it rises by all but a year (a late line of the last day of the year before), else 0."""
    return F.when(before > day + F.expr("INTERVAL 1 DAY"), 1).when(day > before + F.expr("INTERVAL 363 DAYS"), -1).otherwise(0).cast("long")


def timeline_range(
    lines: DataFrame, start: str, end: str, files: list[str] | None = LOG_FILES, lexicographic: bool = False,
    year: int | None = None, as_of: str | None = None,
) -> DataFrame:
    """Lines of the chosen log files from ``start`` to ``end``, both included.

    ``lexicographic`` compares whole lines with the two bounds as text instead of reading their time. A line whose time
    has no year is read in ``year`` if it is given; else, if lines are numbered (``line_no``), in the year that ``with_line_time`` infers along its
    file (and ``host``), from ``mtime`` or ``as_of``. Lines without a number have no place in a file; they are read in each year of the range.
    Lines without a time are left out; ``untimed_lines`` counts them.
    """
    chosen = lines.filter(F.col("file").isin(files)) if files is not None else lines
    if lexicographic:
        return chosen.filter((F.col("line") >= start) & (F.col("line") <= end))
    first, last = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    if year is None and "line_no" in lines.columns:
        timed = with_line_time(chosen, as_of, [c for c in ("host", "file") if c in lines.columns], into="_time")
        return timed.filter(F.col("_time").between(first, last)).drop("_time")
    years = [year] if year is not None else range(datetime.fromisoformat(start).year, datetime.fromisoformat(end).year + 1)
    classic = reduce(lambda a, b: a | b, [_classic_time(F.col("line"), y).between(first, last) for y in years], F.lit(False))
    return chosen.filter(F.coalesce(_iso_time(F.col("line")).between(first, last), classic, F.lit(False)))


def untimed_lines(lines: DataFrame) -> DataFrame:
    """Per log file: all lines, and those whose time cannot be read. The year 2000 has every day of the calendar."""
    untimed = line_time(F.col("line"), LEAP_YEAR).isNull()
    return lines.groupBy("file").agg(F.count(F.lit(1)).alias("lines"), F.count_if(untimed).alias("untimed"))


def valid_date(value: Column) -> Column:
    """Whether a text is a date, or a date and time."""
    return (
        F.try_to_timestamp(value, F.lit("yyyy-MM-dd")).isNotNull()
        | F.try_to_timestamp(value, F.lit("yyyy-MM-dd HH:mm:ss")).isNotNull()
    )


def auth_events(lines: DataFrame) -> DataFrame:
    """Session, password and sudo lines."""
    return lines.filter(F.col("line").rlike(
        r"(?i)session opened for|accepted password|new session|not in sudoers"))


def days_diff(later: Column, earlier: Column) -> Column:
    """Whole days between two moments, cut towards zero."""
    seconds = F.unix_timestamp(later.cast("timestamp")) - F.unix_timestamp(earlier.cast("timestamp"))
    return (seconds / 86400).cast("long")


def mtime_window(files: DataFrame, as_of: str, days: int) -> DataFrame:
    """Files modified less than ``days`` days before ``as_of``."""
    return files.filter(F.col("mtime") > days_before(files, "mtime", as_of, days))


def process_log_24h(log: DataFrame, process: str, as_of: str) -> DataFrame:
    """Unified-log rows of one process in the last day."""
    return log.filter((F.col("process") == process) & (F.col("ts") >= days_before(log, "ts", as_of, 1)))


def audit_rows(lines: DataFrame) -> DataFrame:
    """Audit lines proper: those that start with a digit."""
    return lines.filter(F.col("line").rlike(r"\A[0-9]"))


def _two_days(audit: DataFrame, today: str) -> Column:
    day = datetime.fromisoformat(today)
    return (F.col("ts") >= _literal(audit, "ts", day - timedelta(days=1))) & (
        F.col("ts") < _literal(audit, "ts", day + timedelta(days=1)))


def login_audit(audit: DataFrame, today: str) -> DataFrame:
    """Login and logout records of yesterday and today."""
    return audit.filter((F.col("class") == "lo") & _two_days(audit, today))


def user_list(users: DataFrame, excluded: list[str] = SYSTEM_ACCOUNTS) -> DataFrame:
    """Accounts without the system ones."""
    return users.filter(~F.col("user").isin(excluded))


def user_activity(audit: DataFrame, users: DataFrame, today: str) -> DataFrame:
    """Audit records of yesterday and today per host and account; an account without any keeps one empty row.

    Kept as a semi join plus the accounts nothing was found for, so a busy account is not gathered in one place.
    """
    account = ["host", "user"]
    accounts = user_list(users).select(*account).distinct()
    recent = audit.filter(_two_days(audit, today)).select(*account, "ts", "line")
    active = lookup(recent, accounts, account, "left_semi")
    idle = accounts.join(recent.select(*account).distinct(), account, "left_anti")
    return active.unionByName(idle, allowMissingColumns=True)


def log_difference(lines: DataFrame, today: str, keys: tuple[str, ...] = ("host", "line")) -> DataFrame:
    """Lines of today that yesterday's log of the same host does not have; repeated lines are kept.

    Reads ``ts`` and the key columns. A line with a NULL key is equal to no other, so it is always kept.
    """
    day = datetime.fromisoformat(today)
    now, before = _literal(lines, "ts", day), _literal(lines, "ts", day - timedelta(days=1))
    after = _literal(lines, "ts", day + timedelta(days=1))
    ts = F.col("ts")
    yesterday = lines.filter((ts >= before) & (ts < now)).select(*keys).distinct()
    return salted_join(lines.filter((ts >= now) & (ts < after)), yesterday, list(keys), "left_anti")


def shell_history_report(histories: dict[str, DataFrame]) -> DataFrame:
    """History tables of several shells as (user, shell, command) rows."""
    return reduce(DataFrame.unionByName, [
        df.select("user", F.lit(shell).alias("shell"), "command") for shell, df in histories.items()
    ])
