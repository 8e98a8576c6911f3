"""Table schemas and the catalog of event sources."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_S, _I, _L, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.TimestampType()


def _struct(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in cols.items()])


# Payload keys are lower case: lookups by field name ignore case, and folding once on the way in
# keeps the per-event lookup a plain map access.
EVENT_LOG = _struct(
    host=_S, log_name=_S, provider=_S, event_id=_I, record_id=_L, time_created=_TS,
    event_data=T.MapType(_S, _S), message=_S, raw_xml=_S,
)
FIELD_REF = _struct(kind=_S, name=_S)
SOURCE_CATALOG = _struct(
    id=_S, log_name=_S, category=_S, event_ids=T.ArrayType(_I), field_map=T.MapType(_S, FIELD_REF)
)
RULE_META = _struct(
    rule_id=_S, title=_S, level=_S, status=_S, category=_S, rule_file=_S, enabled=T.BooleanType(),
    tags=T.ArrayType(_S), sources=T.ArrayType(_S), items_json=_S, condition_json=_S,
)
RULE_ERRORS = _struct(SourceId=_S, RuleFile=_S, RuleTitle=_S, Error=_S)
FINDING_COLUMNS = [
    "RuleTitle", "RuleLevel", "RuleTags", "EventId", "LogName", "TimeCreated", "User", "CommandLine",
    "Process", "RuleFile",
]
CAPTURES = _struct(host=_S, capture=_S, line_no=_L, line=_S)
FILES = _struct(host=_S, path=_S, size=_L, mtime=_TS, perms=_S, owner=_S, grp=_S)
HISTORY = _struct(host=_S, browser=_S, profile=_S, visit_time=_TS, url=_S, title=_S)
CONNECTIONS = _struct(
    host=_S, proto=_S, local_addr=_S, local_port=_S, remote_addr=_S, remote_port=_S, state=_S, process=_S
)


@dataclass(frozen=True)
class Source:
    """One event source: which records it reads and how rule fields map onto the record."""

    id: str
    log_name: str
    category: str
    event_ids: tuple[int, ...]
    field_map: dict[str, tuple[str, str]] = field(default_factory=dict, hash=False)


# The ten documented sources (log, category, event ids, fields).
SYSMON = "Microsoft-Windows-Sysmon/Operational"
POWERSHELL = "Microsoft-Windows-PowerShell/Operational"
SYSTEM_FIELDS = {"EventID": "EventID", "Channel": "Channel", "Provider_Name": "ProviderName"}
_DOCUMENTED = [
    ("security_process_creation", "Security", "process_creation", (4688,),
     "Image CommandLine ParentImage ParentCommandLine User ProcessId EventID Channel Provider_Name"),
    ("sysmon_process_creation", SYSMON, "process_creation", (1,),
     "Image CommandLine OriginalFileName ParentImage ParentCommandLine User ProcessId CurrentDirectory Description "
     "Company Product Hashes IntegrityLevel Signed Signature SignatureStatus EventID Channel"),
    ("powershell_script_block", POWERSHELL, "ps_script", (4104,),
     "ScriptBlockText Path EventID Channel Provider_Name"),
    ("powershell_module_logging", POWERSHELL, "ps_module", (4103,),
     "Payload Path EventID Channel Provider_Name"),
    ("powershell_classic", "Windows PowerShell", "ps_classic", (400, 800),
     "HostApplication EngineVersion EventID Channel Provider_Name"),
    ("sysmon_image_load", SYSMON, "image_load", (7,),
     "Image ImageLoaded OriginalFileName Description Company Product Hashes Signed Signature SignatureStatus User "
     "EventID Channel"),
    ("sysmon_network_connection", SYSMON, "network_connection", (3,),
     "Image User Protocol SourceIp SourceHostname SourcePort DestinationIp DestinationHostname DestinationPort "
     "Initiated EventID Channel"),
    ("sysmon_pipe_created", SYSMON, "pipe_created", (17, 18), "Image PipeName User EventID Channel"),
    ("sysmon_file_event", SYSMON, "file_event", (11,), "Image TargetFilename User EventID Channel"),
    ("sysmon_registry_event", SYSMON, "registry_event", (12, 13, 14),
     "Image EventType TargetObject Details User EventID Channel"),
]
_RENAMED = {"security_process_creation": {"Image": "NewProcessName", "User": "SubjectUserName"}}


def _field_map(source_id: str, fields: str) -> dict[str, tuple[str, str]]:
    renamed = _RENAMED.get(source_id, {})
    return {
        name: ("system", SYSTEM_FIELDS[name]) if name in SYSTEM_FIELDS else ("eventdata", renamed.get(name, name))
        for name in fields.split()
    }


SOURCES = [
    Source(sid, log, category, ids, _field_map(sid, fields)) for sid, log, category, ids, fields in _DOCUMENTED
]


def source_catalog(spark: SparkSession, sources: list[Source] = SOURCES) -> DataFrame:
    """The source list as a DataFrame."""
    rows = [
        (s.id, s.log_name, s.category, list(s.event_ids), {f: tuple(ref) for f, ref in s.field_map.items()})
        for s in sources
    ]
    return spark.createDataFrame(rows, SOURCE_CATALOG)


def sources_from_catalog(catalog: DataFrame, limit: int = 10_000) -> list[Source]:
    """Bring a (user-supplied) source catalog to the driver; refuses one that is not a small list."""
    rows = catalog.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"source catalog has more than {limit} rows")
    return [
        Source(r.id, r.log_name, r.category, tuple(r.event_ids or ()),
               {f: (ref.kind, ref.name) for f, ref in (r.field_map or {}).items()})
        for r in rows
    ]
