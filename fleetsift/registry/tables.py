"""The test tables recast as the inputs of the operators. ``views.py`` holds the same definitions as SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetsift.registry.views import CAPTURE_NAMES, LOG_NAMES
from fleetsift.schemas import POWERSHELL, SYSMON


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _minutes(key: str) -> Column:
    return F.expr(f"timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast({key} as int), 0)")


def _event_id() -> Column:
    kind = F.col("event_type")
    return (
        F.when(kind == "click", 4688).when(kind == "view", 4624).when(kind == "error", 4625)
        .when(kind == "signup", 4720).otherwise(4663)
    )


def _payload(**values: Column) -> Column:
    return F.create_map(*[x for name, value in values.items() for x in (F.lit(name), value)]).alias("event_data")


def _choice(names: list[str], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (number % len(names) + 1).cast("int"))


def ev_security(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    switch = F.when(c("event_id") % 3 == 0, " -k ").when(c("event_id") % 3 == 1, " /k ").otherwise(" ")
    command = _text(c("event_type"), switch, c("props"))
    user, image = _text("user", c("user_id")), _text("C:\\app\\", c("event_type"), ".exe")
    xml = _text(
        '<Event><System><Provider Name="Microsoft-Windows-Security-Auditing"/><EventID>', _event_id(),
        "</EventID><Channel>Security</Channel><EventRecordID>", c("event_id"), "</EventRecordID><Computer>host-",
        c("user_id") % 10, '</Computer></System><EventData><Data Name="SubjectUserName">', user,
        '</Data><Data Name="NewProcessName">', image, '</Data><Data>unnamed</Data><Data Name="CommandLine">first</Data>'
        '<Data Name="CommandLine">', command, "</Data></EventData></Event>")
    return table(spark, sf_dir, "events").select(
        _text("host-", c("user_id") % 10).alias("host"), F.lit("Security").alias("log_name"),
        F.lit("Microsoft-Windows-Security-Auditing").alias("provider"), _event_id().alias("event_id"),
        c("event_id").alias("record_id"), c("ts").alias("time_created"),
        _payload(subjectusername=user, newprocessname=image, commandline=command),
        c("props").alias("message"), xml.alias("raw_xml"))


def ev_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "documents").select(
        _text("host-", c("doc_id") % 10).alias("host"), F.lit(POWERSHELL).alias("log_name"),
        F.lit("Microsoft-Windows-PowerShell").alias("provider"), F.lit(4104).alias("event_id"),
        c("doc_id").alias("record_id"), _minutes("doc_id").alias("time_created"),
        _payload(scriptblocktext=c("text"), path=c("source")),
        F.lit(None).cast("string").alias("message"), F.lit(None).cast("string").alias("raw_xml"))


def ev_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    hashes = _text("MD5=", F.upper(F.md5("text")), ",SHA256=", F.upper(F.sha2("text", 256)))
    return table(spark, sf_dir, "conversations").select(
        _text("host-", c("conv_id") % 10).alias("host"), F.lit(SYSMON).alias("log_name"),
        F.lit("Microsoft-Windows-Sysmon").alias("provider"), F.lit(1).alias("event_id"),
        (c("conv_id") * 1000 + c("turn")).alias("record_id"), _minutes("conv_id").alias("time_created"),
        _payload(user=_text("user", c("conv_id") % 50), image=_text("C:\\bin\\", c("role"), ".exe"),
                 commandline=c("text"), hashes=hashes),
        F.lit(None).cast("string").alias("message"), F.lit(None).cast("string").alias("raw_xml"))


def _remote() -> Column:
    c = F.col
    return _text(c("l_partkey") % 256, ".", c("l_suppkey") % 256, ".", c("l_linenumber"), ".", c("l_quantity").cast("int"))


def ev_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    program = F.when(c("l_returnflag") == "A", "chrome").when(c("l_returnflag") == "N", "svchost").otherwise("powershell")
    return table(spark, sf_dir, "lineitem").select(
        _text("host-", c("l_orderkey") % 10).alias("host"), F.lit(SYSMON).alias("log_name"),
        F.lit("Microsoft-Windows-Sysmon").alias("provider"), F.lit(3).alias("event_id"),
        (c("l_orderkey") * 10 + c("l_linenumber")).alias("record_id"), c("l_shipdate").alias("time_created"),
        _payload(user=_text("user", c("l_orderkey") % 150), image=_text("C:\\net\\", program, ".exe"), destinationip=_remote(),
                 destinationhostname=_text("h", c("l_partkey") % 100, ".net", c("l_suppkey") % 50, ".example.org"),
                 initiated=F.when(c("l_linestatus") == "F", "true").otherwise("false")),
        F.lit(None).cast("string").alias("message"), F.lit(None).cast("string").alias("raw_xml"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [view(spark, sf_dir) for view in (ev_security, ev_script, ev_process, ev_network)]
    return reduce(DataFrame.unionByName, parts)


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        _text("host-", F.col("doc_id") % 10).alias("host"), _choice(CAPTURE_NAMES, F.col("doc_id")).alias("capture"),
        F.posexplode(F.split("text", "\n")).alias("_pos", "line"),
    ).select("host", "capture", (F.col("_pos") + 1).cast("long").alias("line_no"), "line")


def connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    state = F.when(flag == "A", "Established").when(flag == "N", "LISTEN").otherwise("time_wait")
    return table(spark, sf_dir, "lineitem").select(
        _text("host-", F.col("l_orderkey") % 10).alias("host"), _remote().alias("remote_addr"), state.alias("state"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, priority = F.col, F.col("o_orderpriority")
    level = (
        F.when(priority == "1-URGENT", "critical").when(priority == "2-HIGH", "High").when(priority == "3-MEDIUM", "medium")
        .when(priority == "4-NOT SPECIFIED", F.lit(None)).otherwise(F.when(c("o_orderstatus") == "P", "strange").otherwise("LOW"))
    )
    return table(spark, sf_dir, "orders").select(
        _text("Order ", priority).alias("RuleTitle"), level.alias("RuleLevel"),
        _text("attack.t1", c("o_custkey") % 1000).alias("RuleTags"),
        (4600 + c("o_orderkey") % 30).cast("int").alias("EventId"), _text("user", c("o_custkey")).alias("User"),
        c("o_orderstatus").alias("Process"),
        F.when(c("o_orderkey") % 4 != 0, _text("run ", c("o_orderkey"))).alias("CommandLine"),
        c("o_orderkey").alias("record_id"))


def hash_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.when(F.col("c_acctbal") < 0, "CRITICAL").otherwise("high").alias("RuleLevel"))


def ioc_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.when(F.col("s_acctbal") < 0, "critical").alias("RuleLevel"))


def events_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "events").select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Time"), _event_id().alias("EventId"),
        c("event_type").alias("Category"), _text("user", c("user_id")).alias("User"),
        _text("host-", c("user_id") % 10).alias("Computer"), c("props").alias("Message"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "events").select(
        "event_id", _choice(LOG_NAMES, c("user_id")).alias("file"), "ts",
        _text(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), " ", c("event_type"), " ", c("props")).alias("line"))


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", _text("host-", c("user_id") % 10).alias("host"),
        F.when(c("user_id") % 20 == 0, "Guest").otherwise(_text("user", c("user_id"))).alias("user"),
        F.when(c("event_type") == "view", "lo").otherwise("fw").alias("class"),
        _text(c("event_type"), " ", c("props")).alias("line"))


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.when(key % 100 == 0, "Shared").when(key % 100 == 1, "Guest").otherwise(_text("user", key)).alias("user"),
        _text("host-", F.col("c_nationkey")).alias("host"))


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, c = table(spark, sf_dir, "pages").count(), F.col
    profile = F.when(c("event_id") % 5 == 0, "System Profile").when(c("event_id") % 5 == 1, "Default").otherwise("Profile 2")
    return table(spark, sf_dir, "events").select(
        _text("host-", c("user_id") % 10).alias("host"), (c("event_id") % pages).alias("place_id"),
        F.unix_micros(c("ts").cast("timestamp")).alias("visit_date"), profile.alias("profile"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("id"), "url", _text("page ", F.col("page_id")).alias("title"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", _text("page ", F.col("page_id")).alias("title"))


def iocs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    # every page gives an entry; those of URLs without a campaign name an address that no page has
    listed = F.when(F.contains("url", F.lit("utm_source")), F.lower("url")).otherwise(_text(F.lower("url"), "?gone=1"))
    urls = table(spark, sf_dir, "pages").select(
        listed.alias("indicator"), F.lit("url").alias("kind"),
        F.when(c("page_id") % 2 == 0, "custom").otherwise("feed").alias("list"))
    domains = spark.createDataFrame([
        ("cheap-pills.example.com", "domain", "custom"), ("tionsh.example.net", "domain", "custom"),
        ("ththan.example.net", "domain", "feed"), ("www.cheap-pills.example.com", "domain", "custom"),
        ("net7.example.org", "domain", "custom"), ("net8.example.org", "domain", "feed"),
    ], urls.schema)
    addresses = table(spark, sf_dir, "lineitem").select(
        _text(c("l_partkey") % 256, ".", c("l_suppkey") % 256, ".1.50").alias("indicator"),
        F.lit("ip").alias("kind"), F.lit("custom").alias("list"))
    return reduce(DataFrame.unionByName, [urls, domains, addresses]).distinct()


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        _text("host-", F.col("page_id") % 10).alias("host"), F.col("url").alias("path"),
        F.length("html").cast("long").alias("size"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(page_id as int), 0, 0)").alias("mtime"))


def rule_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, size = F.col, F.col("p_size") % 6
    level = (
        F.when(size == 0, "critical").when(size == 1, "High").when(size == 2, "MEDIUM").when(size == 3, "low")
        .when(size == 4, "informational").otherwise("extreme")
    )
    return table(spark, sf_dir, "part").select(
        _text("r", c("p_partkey")).alias("rule_id"), c("p_name").alias("title"), level.alias("level"),
        F.when(c("p_partkey") % 7 == 0, False).when(c("p_partkey") % 7 == 1, F.lit(None)).otherwise(True).alias("enabled"),
        F.array(_text("src_", c("p_partkey") % 100), _text("SRC_", 200 + c("p_size"))).alias("sources"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "supplier").select(
        _text("src_", c("s_suppkey")).alias("id"), _text("log_", c("s_nationkey")).alias("log_name"),
        _text("cat_", c("s_suppkey") % 4).alias("category"))
