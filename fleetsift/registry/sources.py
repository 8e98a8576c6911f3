"""Readers and writers, as round trips through files that Spark writes from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetsift.operators.detect import event_filter
from fleetsift.operators.ioc import match_literals
from fleetsift.registry import tables as t
from fleetsift.registry.core import AS_OF, query
from fleetsift.registry.indicators import WORDS, _TRIPLES, _WORDS
from fleetsift.schemas import POWERSHELL, SOURCES, source_catalog
from fleetsift.session import scratch_dir
from fleetsift.sources import event_xml, files, lists, rule_files, sinks


def _written(df, label, fmt="parquet", **options):
    path = scratch_dir(df.sparkSession, label)
    df.write.options(**options).format(fmt).save(path)
    return path


def _json_files(df, key, entry, document, label, per_file=1_000):
    """JSON files, each one document over the entries of up to ``per_file`` keys, so that neither files nor folders are as many as keys.

    A key stands for a file of its own, of which only the first document is read: of a task's rows that share a key the first one counts.
    The rows come straight from a table, so a repeated task numbers them alike.
    """
    rows = df.select(F.col(key).alias("_key"), entry.alias("entry"), F.monotonically_increasing_id().alias("_id"))
    # the upper bits of the number are the task's
    firsts = rows.groupBy(F.shiftright("_id", 33).alias("_task"), "_key").agg(F.min(F.struct("_id", "entry")).alias("_first"))
    docs = firsts.groupBy(F.expr(f"_first._id div {per_file}").alias("_file")).agg(
        F.to_json(document(F.collect_list("_first.entry"))).alias("value")).select("value")
    # JSON holds no raw control characters: the one column needs no quotes
    return _written(docs, label, "csv", extension="json", maxRecordsPerFile=1, sep="\x01", quote="")


@query("scan_event_log", "SELECT host, record_id, script FROM ev_script", "ev_script")
def scan_event_log(spark, d):
    path = scratch_dir(spark, "events")
    t.event_log(spark, d).write.partitionBy("log_name").parquet(path)
    events = event_filter(files.scan_event_log(spark, path), POWERSHELL, [4104], AS_OF, 11_000)
    return events.select("host", "record_id", F.col("event_data")["scriptblocktext"].alias("script"))


_XML_SQL = ("SELECT record_id, event_id, log_name, provider, usr, image, command, CAST(3 AS INTEGER) AS entries FROM ev_security")


def _xml_columns(events):
    data = F.col("event_data")
    return events.select(
        "record_id", "event_id", "log_name", "provider", data["subjectusername"].alias("usr"), data["newprocessname"].alias("image"),
        data["commandline"].alias("command"), F.size(data).alias("entries"))


@query("parse_event_xml", _XML_SQL, "ev_security")
def parse_event_xml(spark, d):
    return _xml_columns(event_xml.parse_event_xml(t.ev_security(spark, d).select("record_id", "raw_xml")))


@query("scan_event_xml", _XML_SQL, "ev_security")
def scan_event_xml(spark, d):
    return _xml_columns(event_xml.scan_event_xml(spark, _written(t.ev_security(spark, d).select("raw_xml"), "xml", "text")))


@query("scan_rules", "SELECT concat('r', s_suppkey) AS rule_id, s_name AS title, CASE WHEN s_acctbal < 0 THEN 'critical' ELSE 'low' END AS level, "
       "s_nationkey % 2 = 0 AS enabled, concat('tag', s_nationkey) AS tag, concat('src_', s_nationkey) AS source, "
       "'{\"type\":\"item_ref\",\"name\":\"x\"}' AS condition FROM supplier")
def scan_rules(spark, d):
    c = F.col
    rule = F.struct(
        F.concat(F.lit("r"), c("s_suppkey").cast("string")).alias("rule_id"), c("s_name").alias("title"),
        F.when(c("s_acctbal") < 0, "critical").otherwise("low").alias("level"), (c("s_nationkey") % 2 == 0).alias("enabled"),
        F.array(F.concat(F.lit("tag"), c("s_nationkey").cast("string"))).alias("tags"),
        F.array(F.concat(F.lit("src_"), c("s_nationkey").cast("string"))).alias("sources"),
        F.struct(F.lit("item_ref").alias("type"), F.lit("x").alias("name")).alias("condition"))
    path = _json_files(t.table(spark, d, "supplier"), "s_suppkey", rule, lambda rules: rules, "rules")
    condition = F.from_json("condition_json", "type string, name string")
    return rule_files.scan_rules(spark, path).select(
        "rule_id", "title", "level", "enabled", c("tags")[0].alias("tag"), c("sources")[0].alias("source"),
        F.to_json(condition).alias("condition"))


_SOURCE_ROWS = ", ".join(f"('{s.id}', '{s.log_name}', '{s.category}', {i})" for s in SOURCES for i in s.event_ids)


@query("scan_sources", f"SELECT id, s.log_name, category, count(e.log_name) AS records FROM (VALUES {_SOURCE_ROWS}) AS "
       "s(id, log_name, category, eid) LEFT JOIN (SELECT log_name, event_id FROM ev_security UNION ALL SELECT log_name, event_id FROM "
       "ev_script UNION ALL SELECT log_name, event_id FROM ev_process UNION ALL SELECT log_name, event_id FROM ev_network) e "
       "ON s.log_name = e.log_name AND eid = event_id GROUP BY ALL", "ev_security ev_script ev_process ev_network")
def scan_sources(spark, d):
    rows = source_catalog(spark).select(F.to_json(F.struct("*")).alias("value"))
    path = scratch_dir(spark, "sources")
    rows.agg(F.concat(F.lit("["), F.array_join(F.collect_list("value"), ",\n"), F.lit("]")).alias("value")).write.text(path)
    catalog = rule_files.scan_sources(spark, path)
    counts = t.event_log(spark, d).groupBy("log_name", "event_id").agg(F.count(F.lit(1)).alias("n"))
    wanted = catalog.select("id", "log_name", "category", F.explode("event_ids").alias("event_id"))
    return wanted.join(counts, ["log_name", "event_id"], "left").groupBy("id", "log_name", "category").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("records"))


@query("scan_hash_list", "SELECT md5(text) AS hash, 'md5' AS algo FROM documents UNION ALL SELECT sha256(text), 'sha256' FROM documents")
def scan_hash_list(spark, d):
    entries = F.array(F.concat(F.lit("# "), F.md5("text")), F.upper(F.md5("text")), F.concat(F.lit(" "), F.sha2("text", 256)),
                      F.lit(""), F.lit("not a hash"))
    path = _written(t.table(spark, d, "documents").select(F.explode(entries).alias("value")), "hashes", "text")
    return lists.scan_hash_list(spark, path)


@query("scan_ioc_list", "SELECT lower(url) AS indicator, 'url' AS kind, 'feed' AS list FROM pages UNION ALL "
       "SELECT regexp_extract(url, '://([^/:?#]+)', 1), 'domain', 'feed' FROM pages UNION ALL "
       "SELECT concat('10.0.', page_id % 256, '.7'), 'ip', 'feed' FROM pages")
def scan_ioc_list(spark, d):
    host = F.upper(F.regexp_extract("url", "://([^/:?#]+)", 1))
    address = F.concat(F.lit("10.0."), (F.col("page_id") % 256).cast("string"), F.lit(".7 "))
    entries = F.explode(F.array("url", F.concat(F.lit("#"), "url"), host, F.lit("  "), address)).alias("value")
    return lists.scan_ioc_list(spark, _written(t.table(spark, d, "pages").select(entries), "iocs", "text"), "feed")


@query("scan_config_list", "SELECT unnest([s_name, lower(s_name)]) AS value FROM supplier")
def scan_config_list(spark, d):
    path = _json_files(
        t.table(spark, d, "supplier"), "s_suppkey", F.array("s_name", F.lower("s_name"), F.lit("")),
        lambda names: F.struct(F.flatten(names).alias("suspicious_executables"), F.lit(1).alias("other")), "config")
    return lists.scan_config_list(spark, path, "suspicious_executables").select("value")


@query("config_first_available", "SELECT s_suppkey, CASE s_nationkey % 3 WHEN 0 THEN concat('sh-', s_name) ELSE concat('ps-', s_name) END AS value "
       "FROM supplier WHERE s_nationkey % 3 <> 2")
def config_first_available(spark, d):
    kind, name = F.col("s_nationkey") % 3, F.col("s_name")
    first = F.when(kind == 0, F.array(F.concat(F.lit("sh-"), name))).when(kind == 1, F.array(F.lit("")))
    second = F.when(kind != 2, F.array(F.concat(F.lit("ps-"), name)))
    config = t.table(spark, d, "supplier").select("s_suppkey", F.parse_json(F.to_json(F.struct(
        first.alias("suspicious_SH_commands"), second.alias("suspicious_PS_commands")))).alias("config"))
    return lists.config_first_available(config, ["suspicious_SH_commands", "suspicious_PS_commands"]).select("s_suppkey", "value")


@query("scan_captures", "SELECT concat('host-', item_id % 10) AS host, concat('item-', item_id) AS capture, "
       "generate_subscripts(string_split(text, chr(10)), 1) AS line_no, unnest(string_split(text, chr(10))) AS line FROM benchmark")
def scan_captures(spark, d):
    key = F.col("item_id")
    path = scratch_dir(spark, "captures")
    t.table(spark, d, "benchmark").select(
        F.concat(F.lit("host-"), (key % 10).cast("string")).alias("host"), F.concat(F.lit("item-"), key.cast("string")).alias("capture"),
        F.col("text").alias("value")).write.partitionBy("host", "capture").text(path)
    return files.scan_captures(spark, path)


@query("scan_weblogs", "SELECT concat('10.0.0.', page_id % 256, ' GET ', url, ' 200') AS line FROM pages")
def scan_weblogs(spark, d):
    line = F.concat(F.lit("10.0.0."), (F.col("page_id") % 256).cast("string"), F.lit(" GET "), "url", F.lit(" 200"))
    path = _written(t.table(spark, d, "pages").select(line.alias("value")), "weblogs", "csv", extension="log", sep="\x01", quote="")
    return files.scan_weblogs(spark, path, "2024-01-31", 30).select("line")


@query("scan_files", "SELECT host, path, size FROM files", "files")
def scan_files(spark, d):
    return files.scan_files(spark, _written(t.files(spark, d), "files")).select("host", "path", "size")


@query("scan_firefox", "SELECT id, url, title FROM places", "places")
def scan_firefox(spark, d):
    return files.scan_table_export(spark, _written(t.places(spark, d), "places"))


@query("scan_chrome", "SELECT CAST(id AS VARCHAR) AS id, url, title FROM places", "places")
def scan_chrome(spark, d):
    return files.scan_table_export(spark, _written(t.places(spark, d), "urls", "csv", header=True), "csv")


@query("scan_quarantine", "SELECT event_type AS agent, props AS url, user_id AS stamp FROM events")
def scan_quarantine(spark, d):
    rows = t.table(spark, d, "events").selectExpr("event_type AS agent", "props AS url", "user_id AS stamp")
    return files.scan_table_export(spark, _written(rows, "quarantine"))


@query("scan_tcc", "SELECT c_name AS client, c_nationkey AS auth, 'alice' AS \"user\" FROM customer UNION ALL "
       "SELECT s_name, s_nationkey, 'bob' FROM supplier")
def scan_tcc(spark, d):
    alice = t.table(spark, d, "customer").selectExpr("c_name AS client", "c_nationkey AS auth")
    bob = t.table(spark, d, "supplier").selectExpr("s_name AS client", "s_nationkey AS auth")
    return files.union_by_user({
        user: files.scan_table_export(spark, _written(df, "tcc")) for user, df in (("alice", alice), ("bob", bob))})


@query("scan_shell_history", "SELECT concat('u', event_id % 20) AS \"user\", CASE user_id % 2 WHEN 0 THEN 'bash' ELSE 'zsh' END AS shell, "
       "concat(event_type, ' ', props) AS command FROM events")
def scan_shell_history(spark, d):
    c = F.col
    path = scratch_dir(spark, "shells")
    t.table(spark, d, "events").select(
        F.concat(F.lit("u"), (c("event_id") % 20).cast("string")).alias("user"),
        F.when(c("user_id") % 2 == 0, "bash").otherwise("zsh").alias("shell"), F.concat_ws(" ", "event_type", "props").alias("value"),
    ).write.partitionBy("user", "shell").text(path)
    return files.scan_shell_history(spark, path)


@query("sink_findings_json", "SELECT record_id, RuleTitle, RuleLevel, CommandLine FROM findings", "findings")
def sink_findings_json(spark, d):
    path = scratch_dir(spark, "findings")
    found = t.findings(spark, d)
    sinks.sink_findings_json(found, path)
    return spark.read.schema(found.schema).json(path).select("record_id", "RuleTitle", "RuleLevel", "CommandLine")


@query("sink_csv", "SELECT CAST(page_id AS VARCHAR) AS page_id, url, title FROM history", "history")
def sink_csv(spark, d):
    path = scratch_dir(spark, "history")
    sinks.sink_csv(t.history(spark, d), path)
    return spark.read.option("header", True).csv(path)


@query("sink_hits_text", f"SELECT DISTINCT concat(indicator, '|', source, '|', line) AS value FROM ({_TRIPLES.format(words=_WORDS)}) "
       "UNION ALL SELECT 'No matches found'", "captures")
def sink_hits_text(spark, d):
    lines = t.captures(spark, d).select(F.col("capture").alias("source"), "line")
    out = []
    for words in (WORDS, ["no such indicator"]):
        path = scratch_dir(spark, "hits")
        sinks.sink_hits_text(match_literals(lines, "line", words), path)
        out.append(spark.read.text(path))
    return out[0].unionByName(out[1])
