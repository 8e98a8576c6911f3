import json

import pytest
from pyspark.sql import functions as F

from fleetsift.schemas import SOURCES, source_catalog, sources_from_catalog
from fleetsift.session import scratch_dir
from fleetsift.sources import event_xml, files, lists, rule_files, sinks


def test_rule_folder(spark, tmp_path):
    one = {"title": "one", "rule_id": "1", "level": "high", "tags": ["a", "b"], "sources": ["s"], "items": {"x": {"type": "any"}},
           "condition": {"type": "item_ref", "name": "x"}}
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "sources.json").write_text("[]")
    (tmp_path / "a.json").write_text(json.dumps(one, indent=2))
    (tmp_path / "deep" / "b.JSON").write_bytes(b"\xef\xbb\xbf" + json.dumps([{**one, "title": "two"}, None, {
        **one, "title": "off", "enabled": False}, {**one, "title": "off too", "enabled": "FALSE"}], indent=1).encode())
    (tmp_path / "deep" / "er" / "bad.json").write_text("{oops")
    (tmp_path / "deep" / "null.json").write_text("null")
    (tmp_path / "deep" / "note.txt").write_text("no rule")
    rules = {r.title: r for r in rule_files.load_rules(spark, str(tmp_path))}
    assert {t: r.enabled for t, r in rules.items()} == {"one": True, "two": True, "off": False, "off too": False}
    assert rules["two"].tags == ("a", "b") and rules["one"].items == one["items"] and rules["one"].condition == one["condition"]
    broken = rule_files.broken_rule_files(rule_files.read_rule_files(spark, str(tmp_path))).collect()
    assert [r.path.rsplit("/", 1)[1] for r in broken] == ["bad.json"]


def test_source_catalog_round_trip(spark):
    assert sources_from_catalog(source_catalog(spark)) == SOURCES
    with pytest.raises(ValueError):
        sources_from_catalog(source_catalog(spark), limit=3)


def test_indicator_lists(spark, tmp_path):
    path = tmp_path / "list.txt"
    path.write_text("# note\n\n  D41D8CD98F00B204E9800998ECF8427E \n" + "A" * 64 + "\nshort\n")
    assert sorted(tuple(r) for r in lists.scan_hash_list(spark, str(path)).collect()) == [
        ("a" * 64, "sha256"), ("d41d8cd98f00b204e9800998ecf8427e", "md5")]
    path.write_text("#x\nEvil.example.com\r\n10.0.0.1\nhttps://A/b\nfe80::1\n")
    assert sorted(tuple(r) for r in lists.scan_ioc_list(spark, str(path)).collect()) == [
        ("10.0.0.1", "ip", "custom"), ("evil.example.com", "domain", "custom"), ("fe80::1", "ip", "custom"), ("https://a/b", "url", "custom")]


def test_config_lists(spark, tmp_path):
    path = tmp_path / "config.json"
    path.write_text(json.dumps({"a": ["x", "", "y"], "b": [], "c": ["z"], "d": 1}, indent=2))
    assert [r.value for r in lists.scan_config_list(spark, str(path), "a").orderBy("pos").collect()] == ["x", "y"]
    config = lists.read_config(spark, str(path))
    assert [r.value for r in lists.config_first_available(config, ["missing", "b", "d", "c", "a"]).collect()] == ["z"]


def test_event_xml(spark, tmp_path):
    event = ('<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System><Provider Name="P" Guid="{1}"/>'
             '<EventID Qualifiers="0">4688</EventID><EventRecordID>7</EventRecordID><Channel>Security</Channel><Computer>h</Computer>'
             '<TimeCreated SystemTime="2024-01-01T10:00:00.5Z"/></System><EventData><Data Name="CommandLine">  a &lt;b&gt; </Data>'
             '<Data>loose</Data><Data Name="Empty"/><Data Name="COMMANDLINE">last</Data></EventData>'
             '<RenderingInfo Culture="en-US"><Message>A process was made.</Message></RenderingInfo></Event>')
    bare = "<Event><System><EventID>1</EventID></System></Event>"
    (tmp_path / "e.xml").write_text(f"<?xml version='1.0'?>\n<Events>\n{event}\n{bare}</Events>\n")
    scanned = event_xml.scan_event_xml(spark, str(tmp_path / "e.xml"))
    rows = {r.event_id: r for r in scanned.collect()}
    assert rows[4688].message == "A process was made." and rows[1].message is None
    assert scanned._jdf.queryExecution().optimizedPlan().toString().count("from_xml") <= 1
    assert set(rows) == {4688, 1}
    assert rows[4688].event_data == {"commandline": "last", "empty": ""} and rows[1].event_data == {}
    assert (rows[4688].host, rows[4688].log_name, rows[4688].provider, rows[4688].record_id) == ("h", "Security", "P", 7)
    assert str(rows[4688].time_created).startswith("2024-01-01 10:00:00.5") and rows[4688].raw_xml == event
    folded = event_xml.fold_payload_keys(spark.createDataFrame([({"A": "1", "b": "2"},)], "event_data map<string,string>"))
    assert folded.first().event_data == {"a": "1", "b": "2"}


def test_text_readers(spark, tmp_path):
    for host, capture, body in (("h1", "ps", "a\nb\n"), ("h2", "hosts", "c")):
        folder = tmp_path / "captures" / f"host={host}" / f"capture={capture}"
        folder.mkdir(parents=True)
        (folder / "out.txt").write_text(body)
    assert sorted(tuple(r) for r in files.scan_captures(spark, str(tmp_path / "captures")).collect()) == [
        ("h1", "ps", 1, "a"), ("h1", "ps", 2, "b"), ("h2", "hosts", 1, "c")]
    (tmp_path / "web").mkdir()
    (tmp_path / "web" / "access.log").write_text("GET /\n")
    (tmp_path / "web" / "other.txt").write_text("no\n")
    assert [r.line for r in files.scan_weblogs(spark, str(tmp_path / "web")).collect()] == ["GET /"]
    assert files.scan_weblogs(spark, str(tmp_path / "web"), "2999-01-01", 1).count() == 0
    assert files.scan_shared_files(spark, str(tmp_path / "web")).count() == 2


def test_sinks(spark, tmp_path):
    hits = spark.createDataFrame([("i", "s", "b|c"), ("i", "s", "a"), ("i", "s", "a")], "indicator string, source string, line string")
    sinks.sink_hits_text(hits, str(tmp_path / "hits"))
    assert [r.value for r in spark.read.text(str(tmp_path / "hits")).orderBy("value").collect()] == ["i|s|a", "i|s|b|c"]
    sinks.sink_hits_text(hits.limit(0), str(tmp_path / "none"))
    assert [r.value for r in spark.read.text(str(tmp_path / "none")).collect()] == [sinks.NO_MATCHES]


def test_scratch_dir_follows_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    first, second = scratch_dir(spark, "x"), scratch_dir(spark, "x")
    assert first != second and (root is None or first.startswith(root))
    spark.range(3).write.parquet(first)
    assert spark.read.parquet(first).agg(F.count("*")).first()[0] == 3


def test_captures_of_several_splits_are_numbered_as_whole_files(spark, tmp_path):
    bodies = {("a", "ps"): "\n".join(f"line {i} " + "x" * (i % 37) for i in range(500)) + "\n", ("a", "cron"): "one\r\n\ntwo", ("b", "ps"): "\n", ("b", "w"): "",
              ("b", "ls"): "y" * 3_000 + "\nlast\n\n"}
    for (host, capture), body in bodies.items():
        folder = tmp_path / f"host={host}" / f"capture={capture}"
        folder.mkdir(parents=True)
        (folder / "out.txt").write_bytes(body.encode())
    saved = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "701")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        frame = files.scan_captures(spark, str(tmp_path))
        got = sorted(tuple(r) for r in frame.collect())
        assert frame.rdd.getNumPartitions() > 5
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)
    expected = [(h, c, i + 1, line) for (h, c), body in bodies.items() if body for i, line in enumerate(body.removesuffix("\n").split("\n"))]
    assert got == sorted(expected)
