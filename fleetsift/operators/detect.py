"""The detection scan: every live rule over every candidate event, reading each log once."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetsift.functions.literals import can_index, literal_ids
from fleetsift.functions.matching import BLANK, VIEWS, Views, bad_patterns, quoted, rlike, text
from fleetsift.operators.joins import newest_n
from fleetsift.operators.ruleset import live_rules, pick_sources
from fleetsift.plans.anchors import file_rules
from fleetsift.plans.rules import Options, Rule, RuleError, compile_rule, regexes
from fleetsift.schemas import FINDING_COLUMNS, RULE_ERRORS, SOURCES, Source

COMPILED_TESTS = 40
# Pair ids are (number of the rule file in a source) * FILE_STRIDE + (position of the rule in the file).
FILE_STRIDE = 1_000_000
KEPT = ["host", "log_name", "event_id", "record_id", "time_created"]
# Logical fields and payload names that findings report.
REPORTED = {
    "User": (["User"], ["subjectusername", "targetusername"]),
    "CommandLine": (["CommandLine", "ScriptBlockText", "Payload"], []),
    "Process": (["Image", "ImageLoaded"], []),
}
SYSTEM_COLUMNS = {"eventid": "event_id", "channel": "log_name", "providername": "provider"}


# --- candidates -----------------------------------------------------------------------------------------------------

def time_literal(df: DataFrame, column: str, moment: str | datetime) -> Column:
    """A literal of the same timestamp type as the column, so that the comparison reaches the Parquet reader."""
    moment = datetime.fromisoformat(moment) if isinstance(moment, str) else moment
    return F.lit(moment.strftime("%Y-%m-%d %H:%M:%S.%f")).cast(df.schema[column].dataType)


def event_filter(
    event_log: DataFrame, log_name: str, event_ids: Iterable[int], as_of: str | datetime, days_back: int = 30
) -> DataFrame:
    """Records of one log with the given event ids (none given: all) since ``days_back`` days before ``as_of``."""
    as_of = datetime.fromisoformat(as_of) if isinstance(as_of, str) else as_of
    since = time_literal(event_log, "time_created", as_of - timedelta(days=days_back))
    keep = (F.col("log_name") == log_name) & (F.col("time_created") >= since)
    ids = [int(i) for i in event_ids]
    if ids:
        keep = keep & F.col("event_id").isin(ids)
    return event_log.filter(keep)


def newest_n_per_source(events: DataFrame, n: int, keys: tuple[str, ...] = ("host",)) -> DataFrame:
    """The newest ``n`` candidates of every host, before any rule is looked at; 0 keeps all."""
    if n <= 0:
        return events
    return newest_n(events, list(keys), [F.col("time_created").desc(), F.col("record_id").desc()], n)


# --- fields -----------------------------------------------------------------------------------------------------------

def field_sql(source: Source, name: str) -> tuple[str, str] | None:
    """(column key, SQL of the raw value) of a rule field in a source; None if the source has no such field.

    The value is NULL where the record lacks it.
    """
    mapping = {f.lower(): ref for f, ref in source.field_map.items()}.get(name.lower())
    if mapping is None:
        return None
    kind, target = mapping[0].lower(), mapping[1].lower()
    if kind == "column":
        # a payload value with a column of its own, which the reader can leave out
        return f"col:{target}", f"cast({identifier(target)} AS string)"
    if kind == "system":
        column = SYSTEM_COLUMNS.get(target)
        return (f"sys:{target}", f"cast({column} AS string)") if column else None
    return (f"data:{target}", payload_sql(target)) if kind == "eventdata" else None


def identifier(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def payload_columns(source: Source, fields: Iterable[str]) -> list[str]:
    """Columns of their own that hold some of the logical fields, in lower case."""
    refs = {f.lower(): ref for f, ref in source.field_map.items()}
    found = [refs[f.lower()] for f in fields if f.lower() in refs]
    return [target.lower() for kind, target in found if kind.lower() == "column"]


def payload_sql(name: str) -> str:
    """A payload value by name, in lower case."""
    return f"event_data[{quoted(name)}]"


def field_project(events: DataFrame, source: Source, fields: Iterable[str] | None = None) -> DataFrame:
    """Events with the source's logical fields as string columns; an absent field is the empty string."""
    wanted = list(fields) if fields is not None else list(source.field_map)
    cols = []
    for name in wanted:
        found = field_sql(source, name)
        cols.append(F.expr(text(found[1]) if found else "''").alias(name))
    return events.select("host", "log_name", "event_id", "record_id", "time_created", *cols)


def raw_sql(message: str = "message", raw_xml: str = "raw_xml") -> str:
    """The text a ``raw`` matcher sees: message and XML on separate lines, or the XML alone for a blank message."""
    blank = rlike(text(message), BLANK)
    return f"CASE WHEN {blank} THEN {text(raw_xml)} ELSE concat({text(message)}, '\n', {text(raw_xml)}) END"


class ScanColumns:
    """What the rules of one scan read: field views, and the literals each view is searched for."""

    def __init__(self):
        self.views: dict[str, str] = {}
        self.literals: dict[str, dict[str, int]] = {}
        self.indexed: frozenset[str] = frozenset()
        self.filed: dict[str, dict[str, list[int]]] = {}

    def index(self) -> None:
        """Choose the views with enough literals for an index; rules compiled from now on use it."""
        self.indexed = frozenset(alias for alias, found in self.literals.items() if can_index(list(found)))

    def project(self, events: DataFrame, kept: list[str]) -> DataFrame:
        out = events.select(*kept, *[F.expr(sql).alias(alias) for alias, sql in self.views.items()])
        return out.withColumns({
            f"{alias}#ids": literal_ids(F.col(f"`{alias}`"), list(self.literals[alias]))
            for alias in sorted(self.indexed)
        })

    def waiting(self) -> str:
        """The ids of the rules that an event holds an anchor of, as an array in SQL."""
        found = []
        for alias, filed in sorted(self.filed.items()):
            known = self.literals[alias]
            ids = [f"array({', '.join(f'{i}L' for i in filed.get(literal, ()))})" for literal in known]
            if alias in self.indexed:
                table = f"cast(array({', '.join(ids)}) AS array<array<bigint>>)"
                found.append(f"flatten(transform(`{alias}#ids`, k -> {table}[k]))")
            else:
                flags = (f"CASE WHEN contains(`{alias}`, {quoted(x)}) THEN {own} END" for x, own in zip(known, ids) if x in filed)
                found.append(f"flatten(array_compact(array({', '.join(flags)})))")
        return f"array_distinct(concat({', '.join(found)}))"


class _Projected(Views):
    """Views that become columns of the scan, shared by all rules that read the same field."""

    def __init__(self, key: str, value: str, scan: ScanColumns):
        super().__init__(value)
        self.key, self.scan = key, scan

    def get(self, view: str) -> str:
        alias = f"{self.key}#{view}"
        if alias not in self.scan.views:
            self.scan.views[alias] = VIEWS[view](self.value)
        return f"`{alias}`"

    def contains(self, operand: str, fold: bool) -> str:
        view, literal = ("lower", operand.lower()) if fold else ("raw", operand)
        value, alias = self.get(view), f"{self.key}#{view}"
        if not literal:
            return "true"
        known = self.scan.literals.setdefault(alias, {})
        position = known.setdefault(literal, len(known))
        if alias in self.scan.indexed:
            return f"array_contains(`{alias}#ids`, {position})"
        return f"contains({value}, {quoted(literal)})"


def _views_for(source: Source, scan: ScanColumns):
    def views_of(name: str) -> Views:
        found = field_sql(source, name)
        return _Projected(found[0], found[1], scan) if found else Views("''")

    def raw_views() -> Views:
        return _Projected("raw", raw_sql(), scan)

    return views_of, raw_views


# --- planning ---------------------------------------------------------------------------------------------------------

@dataclass
class ScanPlan:
    """What a scan evaluates, worked out on the driver before any data is read."""

    sources: list[Source]
    pairs: list[tuple[int, Source, Rule]]
    errors: list[tuple[str, str, str, str]] = field(default_factory=list)
    options: Options = Options()

    @property
    def shared_files(self) -> bool:
        """Whether some file of a source holds several rules."""
        return any(i % FILE_STRIDE for i, _, _ in self.pairs)

    def pairs_of(self, source: Source) -> list[tuple[int, Rule]]:
        """Pairs of a source in the order of their ids, so that the rules of one file follow each other."""
        return [(i, rule) for i, s, rule in self.pairs if s.id == source.id]


def plan_scan(
    spark: SparkSession, rules: Iterable[Rule], sources: list[Source] = SOURCES, min_level: str = "medium",
    options: Options = Options(), include_ids=None, exclude_ids=None, include_logs=None, exclude_logs=None,
    include_categories=None, exclude_categories=None,
) -> ScanPlan:
    """Select sources, prune rules, pair them, and set aside the rules that cannot be compiled."""
    chosen = pick_sources(
        sources, include_ids, exclude_ids, include_logs, exclude_logs, include_categories, exclude_categories
    )
    live = live_rules(list(rules), chosen, min_level)
    rejected = frozenset(bad_patterns(spark, regexes(live)))
    options = Options(options.honour_escapes, options.singleline, options.rejected | rejected)
    plan = ScanPlan(chosen, [], options=options)
    files: dict[tuple[str, str], tuple[int, list[Rule]]] = {}
    for source in chosen:
        for rule in live:
            if source.id.lower() not in {s.lower() for s in rule.sources}:
                continue
            try:
                compile_rule(rule, *_views_for(source, ScanColumns()), options)
            except RuleError as failure:
                plan.errors.append((source.id, rule.rule_file, rule.title, str(failure)))
                continue
            number, members = files.setdefault((source.id, rule.rule_file), (len(files), []))
            plan.pairs.append((number * FILE_STRIDE + len(members), source, rule))
            members.append(rule)
    plan.pairs.sort(key=lambda pair: pair[0])
    return plan


def rule_errors(spark: SparkSession, plan: ScanPlan) -> DataFrame:
    """Rules left out of the scan, once per source and rule file."""
    first = {(source, file): row for row in reversed(plan.errors) for source, file in [row[:2]]}
    return spark.createDataFrame(list(first.values()), RULE_ERRORS)


# --- evaluation -------------------------------------------------------------------------------------------------------

def _hit_array(tests: list[tuple[int, str]]) -> str:
    """Ids of the tests that hold, as an array.

    A few tests stay in generated code. Many of them would make a method too long for the JVM to compile, so they go
    through ``array_compact``, which Spark evaluates as an expression tree.
    """
    if len(tests) <= COMPILED_TESTS:
        flags = ", ".join(f"CASE WHEN {test} THEN {i}L ELSE -1L END" for i, test in tests)
        return f"array_remove(array({flags}), -1L)"
    flags = ", ".join(f"CASE WHEN {test} THEN {i}L END" for i, test in tests)
    return f"array_compact(array({flags}))"


def _dispatch(tests: list[tuple[int, str]]) -> str:
    """The test of pair ``p`` among tests in the order of their ids, found by halving."""
    if len(tests) == 1:
        return f"(p = {tests[0][0]}L AND {tests[0][1]})"
    half = len(tests) // 2
    return f"CASE WHEN p < {tests[half][0]}L THEN {_dispatch(tests[:half])} ELSE {_dispatch(tests[half:])} END"


def _of_source(source: Source, sources: list[Source], test: str, otherwise: str) -> str:
    """``test`` for the events of one of several sources of a log."""
    if len(sources) == 1 or not source.event_ids:
        return test
    return f"CASE WHEN event_id IN ({', '.join(str(i) for i in source.event_ids)}) THEN {test} ELSE {otherwise} END"


def _file_anchors(sources: list[Source], plan: ScanPlan, scan: ScanColumns) -> tuple[set[int], set[int]]:
    """File the rules of a log under their anchors; the ids of the rules that wait for one, and of those that always run."""
    waiting, always = set(), set()
    for source in sources:
        def alias_of(name: str | None, view: str) -> str | None:
            found = ("raw", raw_sql()) if name is None else field_sql(source, name)
            if found is None:
                return None
            _Projected(*found, scan).get(view)
            return f"{found[0]}#{view}"

        filed, rest = file_rules(plan.pairs_of(source), plan.options, alias_of)
        always.update(rest)
        for alias, literals in filed.items():
            known, own = scan.literals.setdefault(alias, {}), scan.filed.setdefault(alias, {})
            for literal, ids in literals.items():
                known.setdefault(literal, len(known))
                own.setdefault(literal, []).extend(ids)
                waiting.update(ids)
    return waiting, always


def _scan_log(events: DataFrame, sources: list[Source], plan: ScanPlan) -> DataFrame:
    """The events of one log that some rule of its sources hits, with the ids of the pairs as ``_hits``.

    Up to ``COMPILED_TESTS`` rules are tests in generated code. Of more rules, those with anchors wait for them: one pass per field finds
    the anchors and the other literals of all rules of the log, and an event evaluates the rules it holds an anchor of, each found by
    its id. The others always run.
    """
    scan = ScanColumns()
    pairs = [(i, source, rule) for source in sources for i, rule in plan.pairs_of(source)]
    waiting, always = _file_anchors(sources, plan, scan) if len(pairs) > COMPILED_TESTS else (set(), {i for i, _, _ in pairs})

    def compiled() -> dict[int, str]:
        return {i: compile_rule(rule, *_views_for(source, scan), plan.options) for i, source, rule in pairs if i in waiting or i in always}

    compiled()
    scan.index()
    tests, hits = compiled(), []
    if waiting:
        own = [(i, _of_source(source, sources, tests[i], "false")) for i, source, _ in pairs if i in waiting]
        hits.append(f"filter({scan.waiting()}, p -> {_dispatch(sorted(own))})")
    for source in sources:
        run = [(i, tests[i]) for i, _ in plan.pairs_of(source) if i in always]
        if run:
            hits.append(_of_source(source, sources, _hit_array(run), "cast(array() AS array<bigint>)"))
    together = hits[0] if len(hits) == 1 else f"concat({', '.join(hits)})" if hits else "cast(array() AS array<bigint>)"
    # As the output of an outer explode, the array is made once per event; a plain filter on it would be pushed down
    # and run all rules a second time.
    made = F.explode_outer(F.array(F.expr(f"sort_array({together})" if waiting else together))).alias("_hits")
    kept = _kept(events, sources)
    return scan.project(events, kept).select(*kept, made).filter(F.size("_hits") > 0)


def _kept(events: DataFrame, sources: list[Source]) -> list[str]:
    """What findings are made of: the payload as a map if there is one, and reported fields with columns of their own."""
    wanted = [f for fields, _ in REPORTED.values() for f in fields]
    own = dict.fromkeys(c for s in sources for c in payload_columns(s, wanted))
    names = {c.lower(): c for c in events.columns}
    mapped = any(kind.lower() == "eventdata" for s in sources for kind, _ in s.field_map.values())
    return [*KEPT, *(["event_data"] if mapped and "event_data" in events.columns else []), *(names[c] for c in own if c in names)]


def _by_log(plan: ScanPlan) -> dict[str, list[Source]]:
    logs: dict[str, list[Source]] = {}
    for source in plan.sources:
        if plan.pairs_of(source):
            logs.setdefault(source.log_name, []).append(source)
    return logs


def _first_present(hits: DataFrame, source: Source, column: str) -> Column:
    """First non-missing of some logical fields, then of some payload names, else "N/A"; an empty string counts."""
    fields, payload = REPORTED[column]
    here = {c.lower() for c in hits.columns}
    found = [f for f in (field_sql(source, name) for name in fields) if f]
    values = [sql for key, sql in found if key[4:] in here or not key.startswith("col:") and "event_data" in here or key.startswith("sys:")]
    values += [payload_sql(p) for p in payload if "event_data" in here]
    return F.expr(f"coalesce({', '.join([*values, quoted('N/A')])})")


def project_finding(hits: DataFrame, plan: ScanPlan, extra: list[str] = ()) -> DataFrame:
    """Hits as findings: the ten report columns, led by host, source and record id."""
    spark = hits.sparkSession
    meta = spark.createDataFrame(
        [(i, s.id, r.title, r.level, ", ".join(r.tags), r.rule_file) for i, s, r in plan.pairs],
        "_pair bigint, SourceId string, RuleTitle string, RuleLevel string, RuleTags string, RuleFile string",
    )

    def per_source(pick) -> Column:
        out = F.lit("N/A")
        for source in plan.sources:
            out = F.when(F.col("SourceId") == source.id, pick(source)).otherwise(out)
        return out

    # One row per (source, rule) of a corpus that was compiled on this driver: always small enough to broadcast.
    return hits.join(F.broadcast(meta), "_pair").select(
        "host", "SourceId",
        F.coalesce(F.col("record_id"), F.col("event_id").cast("long")).alias("RecordId"),
        "RuleTitle", "RuleLevel", "RuleTags",
        F.col("event_id").alias("EventId"), F.col("log_name").alias("LogName"),
        F.date_format("time_created", "yyyy-MM-dd HH:mm:ss").alias("TimeCreated"),
        *(per_source(lambda s, c=c: _first_present(hits, s, c)).alias(c) for c in REPORTED),
        "RuleFile", *extra,
    )


FINDING_KEY = ["host", "SourceId", "RuleFile", "RecordId"]


def dedup_findings(findings: DataFrame) -> DataFrame:
    """One finding per host, source, rule file and record: the newest, with ties broken by the other columns.

    Findings that carry ``time_created`` (``detect(..., extra=["time_created"])``) are compared by it, others by the second.
    """
    rest = [c for c in findings.columns if c not in FINDING_KEY]
    times = [c for c in ("time_created", "TimeCreated") if c in rest]
    order = [*times, *[c for c in rest if c not in times]]
    best = findings.groupBy(*FINDING_KEY).agg(F.max(F.struct(*order)).alias("_best"))
    return best.select(*[F.col(c) if c in FINDING_KEY else F.col(f"_best.{c}").alias(c) for c in findings.columns])


def hit_events(
    event_log: DataFrame, plan: ScanPlan, as_of: str | datetime, days_back: int = 30, max_events_per_source: int = 0
) -> DataFrame:
    """Events that some rule hits. Sources of one log share one scan, unless a cap makes their candidates differ."""
    scans = []
    for log_name, sources in _by_log(plan).items():
        groups = [[s] for s in sources] if max_events_per_source > 0 else [sources]
        for group in groups:
            ids = [] if any(not s.event_ids for s in group) else [i for s in group for i in s.event_ids]
            events = event_filter(event_log, log_name, ids, as_of, days_back)
            candidates = newest_n_per_source(events, max_events_per_source)
            scans.append(_scan_log(candidates, group, plan))
    if not scans:
        return event_log.limit(0).select(*KEPT, F.array().cast("array<bigint>").alias("_hits"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans)


def detect_hits(
    event_log: DataFrame, plan: ScanPlan, as_of: str | datetime, days_back: int = 30, max_events_per_source: int = 0
) -> DataFrame:
    """(event, pair) rows."""
    events = hit_events(event_log, plan, as_of, days_back, max_events_per_source)
    return events.select(*[c for c in events.columns if c != "_hits"], F.explode("_hits").alias("_pair"))


def dedup_hits(events: DataFrame, shared_files: bool = True) -> DataFrame:
    """(event, pair) rows, one per host, source, rule file and record: the first rule of the file on the newest event.

    Works on events rather than findings, so that a long text moves once however many rules hit it. Copies of a record
    with the same hits are folded before they are moved. Only a record of which several copies are left is taken apart by
    file, in the partition it lies in, so that its cost grows with its hits and not with their square.
    Without ``shared_files`` every file is taken to hold one rule, so that a pair stands for its file.
    """
    def file_of(pair: Column) -> Column:
        return F.floor(pair / FILE_STRIDE) if shared_files else pair

    hits = F.col("_hits")
    if shared_files:
        hits = F.filter(hits, lambda pair, i: (i == 0) | (file_of(F.get("_hits", i - 1)) != file_of(pair)))
    # a map cannot be compared, its sorted entries can
    payload = {c: F.sort_array(F.map_entries(c)) if c == "event_data" else F.col(c) for c in events.columns if c not in (*KEPT, "_hits")}
    record = ["host", "log_name", "_record"]
    newest = events.select(
        "host", "log_name", F.coalesce(F.col("record_id"), F.col("event_id").cast("long")).alias("_record"),
        hits.alias("_hits"), F.struct("time_created", "event_id", *(value.alias(c) for c, value in payload.items())).alias("_row"),
    ).groupBy(*record, "_hits").agg(F.max("_row").alias("_row"))
    # the second window finds its rows where the first has put them: partitions by record hold all files of a record
    copies = newest.withColumn("_copies", F.count(F.lit(1)).over(Window.partitionBy(*record)))
    apart = copies.select("*", F.explode_outer(F.when(F.col("_copies") > 1, F.col("_hits"))).alias("_one")).withColumn("_file", file_of(F.col("_one")))
    place = F.row_number().over(Window.partitionBy(*record, "_file").orderBy(F.col("_row").desc()))
    left = apart.withColumn("_place", place).filter("_place = 1").withColumn(
        "_hits", F.when(F.col("_one").isNull(), F.col("_hits")).otherwise(F.array("_one")))
    return left.select(
        "host", "log_name", F.col("_row.event_id").alias("event_id"), F.col("_record").alias("record_id"),
        F.col("_row.time_created").alias("time_created"),
        *((F.map_from_entries("_row.event_data") if c == "event_data" else F.col(f"_row.{c}")).alias(c) for c in payload),
        F.explode("_hits").alias("_pair"),
    )


def detect(
    event_log: DataFrame, plan: ScanPlan, as_of: str | datetime, days_back: int = 30, max_events_per_source: int = 0,
    dedup: bool = True, extra: list[str] = (),
) -> DataFrame:
    """Findings of a whole scan, one per host, source, rule file and record unless ``dedup`` is off.

    ``extra`` names event columns that the findings carry besides their own.
    """
    if dedup:
        events = hit_events(event_log, plan, as_of, days_back, max_events_per_source)
        return project_finding(dedup_hits(events, plan.shared_files), plan, extra)
    return project_finding(detect_hits(event_log, plan, as_of, days_back, max_events_per_source), plan, extra)


def report_columns(findings: DataFrame) -> DataFrame:
    """Findings as the ten report columns only."""
    return findings.select(*FINDING_COLUMNS)


def scan_stats(
    event_log: DataFrame, plan: ScanPlan, as_of: str | datetime, days_back: int = 30, max_events_per_source: int = 0
) -> DataFrame:
    """Per source with live rules: candidates found, candidates scanned under the cap, and whether some host reached it.

    The cap is per host, so the counts are taken per host first and need no ranking of events. One pass counts the
    events of each log, id and host; these counts then meet the sources. A source without candidates has zeros.
    """
    cap, spark = max_events_per_source, event_log.sparkSession
    live = [s for sources in _by_log(plan).values() for s in sources]
    as_of = datetime.fromisoformat(as_of) if isinstance(as_of, str) else as_of
    since = time_literal(event_log, "time_created", as_of - timedelta(days=days_back))
    wanted = reduce(lambda a, b: a | b, [
        (F.col("log_name") == s.log_name) & (F.col("event_id").isin(list(s.event_ids)) if s.event_ids else F.lit(True)) for s in live
    ], F.lit(False))
    counts = event_log.filter(wanted & (F.col("time_created") >= since)).groupBy("log_name", "event_id", "host").agg(
        F.count(F.lit(1)).alias("n"))
    # A few rows per source of a catalog that was compiled on this driver.
    listed = spark.createDataFrame(
        [(s.id, s.log_name, i) for s in live for i in sorted(set(s.event_ids)) or [None]], "SourceId string, _log string, _id int")
    met = (F.col("log_name") == F.col("_log")) & (F.col("_id").isNull() | (F.col("_id") == F.col("event_id")))
    per_host = counts.join(F.broadcast(listed), met).groupBy("SourceId", "host").agg(F.sum("n").alias("n"))
    scanned = F.least(F.col("n"), F.lit(cap)) if cap > 0 else F.col("n")
    found = per_host.groupBy("SourceId").agg(
        F.sum("n").alias("found"), F.sum(scanned).alias("scanned"),
        (F.max((F.col("n") >= cap).cast("int")) == 1 if cap > 0 else F.lit(False)).alias("cap_reached"),
    )
    return spark.createDataFrame([(s.id,) for s in live], "SourceId string").join(found, "SourceId", "left").select(
        "SourceId", F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("scanned", F.lit(0)).alias("scanned"),
        F.coalesce("cap_reached", F.lit(False)).alias("cap_reached"))


def scan_tags(event_log: DataFrame, plan: ScanPlan, as_of: str | datetime, days_back: int = 30, max_events_per_source: int = 0) -> DataFrame:
    """(RuleTags) of every finding of ``detect``, without its texts.

    Where every file holds one rule, a finding is a distinct record and pair, whichever copy is the newest, so that only keys are moved.
    Else the newest copy decides which rule of a file is reported, and copies are compared as in ``detect``.
    """
    if plan.shared_files:
        return detect(event_log, plan, as_of, days_back, max_events_per_source).select("RuleTags")
    events = hit_events(event_log, plan, as_of, days_back, max_events_per_source)
    meta = event_log.sparkSession.createDataFrame([(i, ", ".join(r.tags)) for i, _, r in plan.pairs], "_pair bigint, RuleTags string")
    keys = events.select("host", "log_name", F.coalesce(F.col("record_id"), F.col("event_id").cast("long")).alias("_record"), F.explode("_hits").alias("_pair"))
    # One row per (source, rule) of a corpus that was compiled on this driver: always small enough to broadcast.
    return keys.distinct().join(F.broadcast(meta), "_pair").select("RuleTags")


def tag_rollup(findings: DataFrame) -> DataFrame:
    """Findings per tag, with the technique id for technique tags and the tactic name for the others, from ``detect`` or ``scan_tags``."""
    tag = F.explode(F.split("RuleTags", ", ")).alias("tag")
    technique = F.upper(F.regexp_extract("tag", r"^attack\.(t\d{4}(?:\.\d{3})?)$", 1))
    tactic = F.when(technique == "", F.regexp_extract("tag", r"^attack\.(.+)$", 1)).otherwise(F.lit(""))
    return (
        findings.groupBy("RuleTags").agg(F.count(F.lit(1)).alias("n"))
        .select("n", tag).filter(F.col("tag") != "")
        .groupBy("tag").agg(F.sum("n").alias("findings"))
        .select("tag", technique.alias("technique"), tactic.alias("tactic"), "findings")
    )
