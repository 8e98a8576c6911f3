"""Indicator matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetsift.operators import history, ioc
from fleetsift.operators.detect import detect, plan_scan
from fleetsift.plans.rules import inject_values, rule_from_dict
from fleetsift.registry import tables as t
from fleetsift.registry.core import AS_OF, query
from fleetsift.session import scratch_dir
from fleetsift.sources.lists import config_values, ioc_type, scan_ioc_list

WORDS = ["apache license", "TOKEN = ", "disgusting", "Pathetic", "555-", "die der die", "no such indicator"]
_WORDS = "(VALUES " + ", ".join(f"('{w}')" for w in WORDS) + ") AS w(indicator)"


@query("ioc_merge", "SELECT indicator, kind FROM (SELECT indicator, kind FROM iocs UNION SELECT lower(regexp_extract(url, "
       "'://([^/:?#]+)', 1)), 'domain' FROM pages)", "iocs")
def ioc_merge(spark, d):
    hosts = t.history(spark, d).select(ioc.url_host(F.col("url")).alias("indicator"), F.lit("domain").alias("kind"))
    return ioc.ioc_merge(t.iocs(spark, d).select("indicator", "kind"), hosts)


@query("hash_extract", "SELECT host, record_id, 'md5' AS algo, md5(text) AS hash FROM (SELECT concat('host-', conv_id % 10) AS host, "
       "conv_id * 1000 + turn AS record_id, text FROM conversations) UNION ALL SELECT concat('host-', conv_id % 10), "
       "conv_id * 1000 + turn, 'sha256', sha256(text) FROM conversations")
def hash_extract(spark, d):
    return ioc.hash_extract(_hashed(spark, d))


def _hashed(spark, d):
    return t.ev_process(spark, d).select("host", "record_id", F.col("event_data")["hashes"].alias("Hashes"))


@query("hash_match", "SELECT doc_id, md5(text) AS hash FROM documents WHERE md5(text) IN (SELECT md5(text) FROM documents "
       "JOIN labels USING (doc_id) WHERE toxic = 1)")
def hash_match(spark, d):
    docs = t.table(spark, d, "documents")
    bad = docs.join(t.table(spark, d, "labels").filter("toxic = 1"), "doc_id").select(F.upper(F.md5("text")).alias("hash"))
    return ioc.hash_match(docs.select("doc_id", F.md5("text").alias("hash")), bad)


@query("ioc_type", "SELECT indicator, kind FROM iocs", "iocs")
def ioc_kinds(spark, d):
    return t.iocs(spark, d).select("indicator", ioc_type("indicator").alias("kind"))


@query("ioc_url_exact", "SELECT page_id, indicator FROM history JOIN iocs ON lower(url) = indicator WHERE kind = 'url'",
       "history iocs")
def ioc_url_exact(spark, d):
    return ioc.ioc_url_exact(t.history(spark, d), t.iocs(spark, d)).select("page_id", "indicator")


@query("ioc_domain", "SELECT page_id, indicator FROM history JOIN iocs ON host_name = indicator WHERE kind IN ('domain', 'ip')",
       "history iocs")
def ioc_domain(spark, d):
    return ioc.ioc_domain(t.history(spark, d), t.iocs(spark, d)).select("page_id", "indicator")


_BELOW = "(host_name = indicator OR ends_with(host_name, concat('.', indicator)))"


@query("ioc_parent_domain", f"SELECT page_id, indicator FROM history JOIN iocs ON {_BELOW} WHERE kind = 'domain'", "history iocs")
def ioc_parent_domain(spark, d):
    return ioc.ioc_parent_domain(t.history(spark, d), t.iocs(spark, d)).select("page_id", "indicator")


@query("ioc_feed_url_only", f"SELECT page_id, indicator, 'domain' AS layer FROM history JOIN iocs ON {_BELOW} "
       "WHERE kind = 'domain' AND list = 'custom' UNION ALL SELECT page_id, indicator, 'url' FROM history JOIN iocs "
       "ON lower(url) = indicator WHERE kind = 'url'", "history iocs")
def ioc_feed_url_only(spark, d):
    return ioc.ioc_feed_url_only(t.history(spark, d), t.iocs(spark, d)).select("page_id", "indicator", "layer")


@query("browser_ioc_only", f"SELECT page_id, url FROM history WHERE EXISTS (SELECT 1 FROM iocs WHERE kind = 'domain' AND list = 'custom' AND {_BELOW})",
       "history iocs")
def browser_ioc_only(spark, d):
    visits = t.history(spark, d)
    return history.browser_ioc_only(visits, ioc.ioc_parent_domain(visits, t.iocs(spark, d).filter("list = 'custom'"))).select("page_id", "url")


@query("ioc_network", "SELECT record_id, ip AS DestinationIp, indicator FROM ev_network JOIN iocs ON (kind = 'ip' AND ip = indicator) "
       "OR (kind = 'domain' AND (hostname = indicator OR ends_with(hostname, concat('.', indicator)))) "
       "WHERE list = 'custom' AND initiated = 'true' AND NOT ends_with(image, 'chrome.exe')", "ev_network iocs")
def ioc_network(spark, d):
    data = F.col("event_data")
    events = t.ev_network(spark, d).select(
        "record_id", data["image"].alias("Image"), data["destinationip"].alias("DestinationIp"),
        data["destinationhostname"].alias("DestinationHostname"), data["initiated"].alias("Initiated"))
    return ioc.ioc_network(events, t.iocs(spark, d)).select("record_id", "DestinationIp", "indicator")


_ADDRESS = "unnest(regexp_extract_all(text, '([0-9]{1,3}\\.){3}[0-9]{1,3}'))"


@query("ioc_script", f"SELECT DISTINCT doc_id, indicator FROM documents JOIN (SELECT DISTINCT {_ADDRESS} AS indicator FROM documents) "
       "ON indicator <> '' AND contains(text, indicator) WHERE contains(lower(text), ' is ') OR contains(lower(text), ' de ')")
def ioc_script(spark, d):
    docs = t.table(spark, d, "documents")
    address = F.explode(F.regexp_extract_all("text", F.lit(r"([0-9]{1,3}\.){3}[0-9]{1,3}"), F.lit(0)))
    listed = docs.select(address.alias("indicator"), F.lit("ip").alias("kind"), F.lit("custom").alias("list"))
    # A feed domain and a URL that texts hold and that must not count.
    others = spark.createDataFrame([("the", "domain", "feed"), ("is", "url", "custom")], listed.schema)
    listed = listed.unionByName(others)
    return ioc.ioc_script(docs.select("doc_id", "text"), listed, [" IS ", " de "], "text").select("doc_id", "indicator")


@query("ioc_inject", "SELECT doc_id AS \"RecordId\" FROM documents WHERE contains(lower(text), 'the') AND EXISTS (SELECT 1 FROM "
       "(SELECT DISTINCT unnest(string_split(p_name, ' ')) AS indicator FROM part) WHERE contains(lower(text), indicator))")
def ioc_inject(spark, d):
    listed = t.table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("indicator"))
    values = ioc.driver_list(listed)

    def contains(*v):
        return {"type": "field", "field": "ScriptBlockText", "operator": "contains", "values": list(v)}

    rule = rule_from_dict({
        "title": "Indicator in script", "rule_file": "ioc.json", "level": "high", "sources": ["powershell_script_block"],
        "items": {"ioc_in_script": contains(), "verb": contains("THE")},
        "condition": {"type": "wildcard_ref", "pattern": "them", "mode": "all"}})
    plan = plan_scan(spark, [inject_values(rule, "IOC_in_script", values)])
    return detect(t.ev_script(spark, d), plan, AS_OF, 11_000).select("RecordId")


_TRIPLES = "SELECT DISTINCT host, indicator, capture AS source, line FROM captures JOIN {words} ON contains(lower(line), lower(indicator))"


@query("ioc_text_match", _TRIPLES.format(words=_WORDS), "captures")
def ioc_text_match(spark, d):
    return ioc.ioc_text_match(t.captures(spark, d), WORDS).orderBy("indicator", "source", "line")


@query("ioc_executables", _TRIPLES.format(words=_WORDS) + " WHERE capture IN ('ps', 'services', 'systemctl', 'cron', 'p1', 'p2', "
       "'p3', 'p4', 'p5', 'p6', 'p7', 'p8', 'p9')", "captures")
def ioc_executables(spark, d):
    return ioc.ioc_executables(t.captures(spark, d), WORDS)


@query("ioc_shell_commands", _TRIPLES.format(words=_WORDS) + " WHERE capture IN ('ps', 'cron', 'p1', 'p2', 'p3', 'p4', 'p5', 'p6', "
       "'p7', 'p8', 'p9', 'bashrc')", "captures")
def ioc_shell_commands(spark, d):
    return ioc.ioc_shell_commands(t.captures(spark, d), WORDS)


@query("user_config", _TRIPLES.format(words="(SELECT DISTINCT lower(unnest(string_split(p_name, ' '))) AS indicator FROM part)"), "captures")
def user_config(spark, d):
    names = F.split("p_name", " ")
    config = t.table(spark, d, "part").select(F.parse_json(F.to_json(F.struct(
        F.array_append(names, "").alias("suspicious_SH_commands")))).alias("config"))
    listed = config_values(config, "suspicious_SH_commands").select(F.lower("value").alias("indicator")).distinct()
    return ioc.ioc_text_match(t.captures(spark, d), listed)


@query("user_ioc", "SELECT page_id, i.indicator FROM history JOIN (SELECT indicator FROM iocs WHERE kind = 'domain' AND list = 'custom' "
       "UNION SELECT DISTINCT regexp_extract(url, '([a-z0-9-]+\\.example\\.org)', 1) FROM pages) i "
       "ON (host_name = i.indicator OR ends_with(host_name, concat('.', i.indicator))) WHERE i.indicator <> ''", "history iocs")
def user_ioc(spark, d):
    own = t.table(spark, d, "pages").select(F.upper(F.regexp_extract("url", r"([a-z0-9-]+\.example\.org)", 1)).alias("value")).filter("value <> ''")
    folder = scratch_dir(spark, "iocs")
    prefixed = F.explode(F.array(F.concat(F.lit("  "), "value"), F.concat(F.lit("# no-"), "value"))).alias("line")
    own.select(prefixed).write.text(folder)
    known = t.iocs(spark, d).filter("kind = 'domain' and list = 'custom'")
    merged = ioc.ioc_merge(scan_ioc_list(spark, folder), known)
    return ioc.ioc_parent_domain(t.history(spark, d), merged).select("page_id", "indicator")


@query("ransom_extensions", "SELECT host, path, extension FROM files JOIN (SELECT '.html' AS extension UNION ALL "
       "SELECT DISTINCT concat('.', string_split(url, '.')[-1]) FROM pages) "
       "ON ends_with(string_split(path, '/')[-1], extension)", "files")
def ransom_extensions(spark, d):
    pages = t.table(spark, d, "pages")
    listed = pages.select(F.concat(F.lit("."), F.element_at(F.split("url", r"\."), -1)).alias("extension")).distinct()
    always = pages.sparkSession.createDataFrame([(".html",)], "extension string")
    return ioc.ransom_extensions(t.files(spark, d), always.unionByName(listed)).select("host", "path", "extension")


_PLACES = ["\\AppData\\Local\\", "\\Temp\\", "\\Downloads\\", "\\Documents\\"]
_PATH = ("concat('C:\\Users\\u', p_partkey % 7, ['\\AppData\\Local\\', '\\Temp\\', '\\Downloads\\', '\\Documents\\'][1 + p_size % 4], "
         "p_name, ['.exe', '.txt', '.PS1'][1 + p_partkey % 3])")


@query("susp_exec_location", f"SELECT {_PATH} AS path FROM part WHERE p_size % 4 <> 3 AND p_partkey % 3 <> 1")
def susp_exec_location(spark, d):
    c = F.col
    folder = F.element_at(F.array(*[F.lit(p) for p in _PLACES]), c("p_size") % 4 + 1)
    ending = F.element_at(F.array(F.lit(".exe"), F.lit(".txt"), F.lit(".PS1")), (c("p_partkey") % 3 + 1).cast("int"))
    path = F.concat(F.lit("C:\\Users\\u"), (c("p_partkey") % 7).cast("string"), folder, c("p_name"), ending)
    return ioc.susp_exec_location(t.table(spark, d, "part").select(path.alias("path")))


@query("recent_files", "SELECT path FROM files WHERE mtime >= TIMESTAMP '2024-01-08 00:00:00'", "files")
def recent_files(spark, d):
    return ioc.recent_files(t.files(spark, d), "2024-01-10", 2).select("path")
