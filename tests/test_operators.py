import random

import pytest
from pyspark.sql import functions as F

from fleetsift.functions import literals
from fleetsift.operators import history, ioc, joins, logs, report, snapshots


def _rows(frame):
    return sorted(tuple(r) for r in frame.collect())


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key."""
    return spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"))


@pytest.mark.parametrize("how", ["inner", "left_semi", "left_anti"])
def test_lookup_gives_the_same_rows_either_way(spark, skewed, how):
    side = spark.createDataFrame([("hot",), ("k7",), ("none",)], "k string")
    plain = _rows(skewed.join(side, "k", how))
    assert _rows(joins.lookup(skewed, side, ["k"], how, small=True)) == plain
    assert _rows(joins.lookup(skewed, side, ["k"], how, small=False)) == plain
    assert _rows(joins.lookup(skewed, side, ["k"], how)) == plain
    assert [r.k for r in joins.hot_keys(skewed, ["k"], 1.0, 500)] == ["hot"]
    salted = joins.salted_join(skewed, side, ["k"], how, rate=1.0, seen=30)
    assert _rows(salted) == plain and "_salt" in salted._jdf.queryExecution().optimizedPlan().toString()


def test_is_small(spark):
    assert joins.is_small(spark.range(10), rows=10) and not joins.is_small(spark.range(11), rows=10)
    assert not joins.is_small(spark.range(10).select(F.repeat(F.lit("x"), 100).alias("s")), size=3000)


def test_newest_n_of_a_hot_group(skewed):
    got = joins.newest_n(skewed, ["k"], [F.col("id").desc()], 5)
    hot = sorted(r.id for r in got.filter("k = 'hot'").collect())
    assert hot == [2985, 2988, 2991, 2994, 2997]
    assert got.groupBy("k").count().filter("count > 5").count() == 0


@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_carry_forward_over_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(history, "LINES_PER_CHUNK", chunk)
    rng = random.Random(2)
    rows = [(h, i, rng.choice([None, None, None, f"v{i}"])) for h in "ab" for i in range(60)]
    got = history.carry_forward(spark.createDataFrame(rows, "h string, i int, v string"), "v", ["h"], "i", "f")
    expected, last = {}, {}
    for h, i, v in rows:
        last[h] = v or last.get(h)
        expected[h, i] = last[h]
    assert {(r.h, r.i): r.f for r in got.collect()} == expected


def test_install_history(spark):
    lines = ['"displayName" = early;', '"date" = 2024-01-01;', "x", '"displayName" = one;', '"displayName" = "Big update";', '"displayName" = two;']
    frame = spark.createDataFrame([("h", i + 1, line) for i, line in enumerate(lines)], "host string, line_no long, line string")
    assert _rows(history.install_history(frame).select("line_no", "date", "name")) == [
        (1, "", "early"), (4, "2024-01-01", "one"), (6, '"Big', "two")]


@pytest.mark.parametrize("path", ["shipped", "index", "grams"])
def test_literal_matching_agrees_with_brute_force(spark, monkeypatch, path):
    rng = random.Random(4)
    alphabet = "abcé.-/ "
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))).upper() for _ in range(150)] + ["", None, "http://evil.example/x", "aaaaaaaaaa"]
    needles = {"".join(rng.choices(alphabet, k=rng.randint(1, 9))) for _ in range(120)} | {"http://evil.example/x", "http://evil.example/y", "AAAAA", "aaaaa", ""}
    if path == "shipped":
        monkeypatch.setattr(literals, "INDEX_FROM", 10**6)
    frame = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "i int, s string")
    listed = spark.createDataFrame([(n,) for n in sorted(needles)], "indicator string")
    got = ioc.match_literals(frame, "s", listed, max_shipped=10 if path == "grams" else 1000)
    expected = {(i, n) for i, s in enumerate(texts) for n in needles if n and n.lower() in (s or "").lower()}
    rows = [(r.i, r.indicator) for r in got.collect()]
    assert set(rows) == expected and len(rows) == len(expected)
    if path == "grams":
        monkeypatch.setattr(literals, "MAX_LITERALS", 10)
        own = ioc.match_literals(frame, "s", sorted(needles))
        assert sorted(rows) == sorted((r.i, r.indicator) for r in own.collect())
    twice = ioc.match_literals(frame.union(frame), "s", listed, max_shipped=10 if path == "grams" else 1000)
    assert twice.count() == 2 * len(expected)


def test_grams_are_tested_before_they_move(spark):
    pieces = spark.range(20_000).select("id", F.concat(F.lit("gram"), "id").alias("_gram"))
    anchors = spark.createDataFrame([("gram7", "x"), ("gram77", "y"), ("none", "z")], "_gram string, needle string")
    left = {r.id for r in ioc._maybe_filed(pieces, anchors).collect()}
    assert {7, 77} <= left and len(left) < 20
    assert ioc._maybe_filed(pieces, anchors.limit(0)).count() == 0


def test_hits_as_findings(spark):
    hits = spark.createDataFrame([("h", 3, "ab"), (None, None, "cd")], "host string, n long, hash string")
    found = ioc.hit_findings(hits, "Listed hash", "critical", "hash", "hash", host=F.col("host"), RecordId=F.col("n"))
    assert found.columns[:3] == ["host", "SourceId", "RecordId"] and len(found.columns) == 13
    assert _rows(found.select("RecordId", "RuleTitle", "RuleLevel", "User").filter("host = 'h'")) == [(3, "Listed hash: ab", "critical", "N/A")]
    kpis = report.overview_kpis(found.limit(0), found, found).first()
    assert (kpis.total, kpis.critical, kpis.hash_hits, kpis.ioc_hits) == (4, 2, 2, 2)


def test_hash_extract_and_match(spark):
    events = spark.createDataFrame([(1, "MD5=AB, SHA256=CD,broken"), (2, ""), (3, None), (4, "MD5=EF")], "i int, Hashes string")
    pairs = ioc.hash_extract(events)
    assert _rows(pairs) == [(1, "md5", "ab"), (1, "sha256", "cd"), (4, "md5", "ef")]
    bad = spark.createDataFrame([("EF",), ("ef",), ("cd",)], "hash string")
    assert sorted(r.i for r in ioc.hash_match(pairs, bad).collect()) == [1, 4]


def test_hosts_and_parents(spark):
    cases = {"https://User:pw@A.b.Example.com:8443/x?y=http://z": "a.b.example.com", "ftp://h": "h", "no url": "",
             "http://[2001:db8::1]:80/": "2001:db8::1"}
    rows = spark.createDataFrame([(u,) for u in cases], "u string").select("u", ioc.url_host(F.col("u")).alias("h")).collect()
    assert {r.u: r.h for r in rows} == cases
    assert spark.range(1).select(ioc.parent_domains(F.lit("a.b.c")).alias("p")).first().p == ["c", "b.c", "a.b.c"]


def test_ransom_extensions_keep_multiplicity(spark):
    files = spark.createDataFrame([("/d.locked/a.txt",), ("/x/a.tar.locked",), ("/x/b.LOCKED",), ("/x/noext",), ("C:\\y\\c.crypt",)], "path string")
    listed = spark.createDataFrame([(".locked",), (".locked",), (".tar.locked",), (".crypt",), ("txt",)], "extension string")
    assert _rows(ioc.ransom_extensions(files, listed).select("path", "extension")) == [
        ("/x/a.tar.locked", ".locked"), ("/x/a.tar.locked", ".locked"), ("/x/a.tar.locked", ".tar.locked"), ("C:\\y\\c.crypt", ".crypt")]


def test_log_difference_keeps_repeated_lines(spark):
    rows = [("2024-01-01 10:00:00", "h", "a"), ("2024-01-02 10:00:00", "h", "a"), ("2024-01-02 11:00:00", "h", "b"),
            ("2024-01-02 12:00:00", "h", "b"), ("2024-01-02 12:00:00", "i", "a"), ("2024-01-03 00:00:00", "h", "c")]
    frame = spark.createDataFrame(rows, "t string, host string, line string").withColumn("ts", F.to_timestamp("t"))
    got = logs.log_difference(frame, "2024-01-02").collect()
    assert sorted((r.host, r.line) for r in got) == [("h", "b"), ("h", "b"), ("i", "a")]


def test_user_activity_stays_on_its_host(spark):
    audit = spark.createDataFrame([("h", "u", "2024-01-02 10:00:00", "x")], "host string, user string, t string, line string")
    users = spark.createDataFrame([("h", "u"), ("i", "u")], "host string, user string")
    got = logs.user_activity(audit.withColumn("ts", F.to_timestamp("t")), users, "2024-01-02")
    assert sorted((r.host, r.line or "") for r in got.collect()) == [("h", "x"), ("i", "")]


def test_line_times(spark):
    cases = {"2024-01-05 06:00:00 a": "2024-01-05 06:00:00", "2024-01-05T06:00:00.25+05:00 a": "2024-01-05 01:00:00",
             "2024-01-05T06:00:00+0530": "2024-01-05 00:30:00", "2024-01-05T06:00:00Z x": "2024-01-05 06:00:00",
             "Jan  5 06:00:00 host sshd[1]: x": "2024-01-05 06:00:00", "Feb 29 23:59:59 y": "2024-02-29 23:59:59",
             "Foo  5 06:00:00 z": None, "2024-13-05 06:00:00": None, "no time": None, "": None}
    frame = spark.createDataFrame([(x,) for x in cases], "line string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    try:
        rows = frame.select("line", logs.line_time(F.col("line"), 2024).cast("string").alias("t")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert {r.line: r.t for r in rows} == cases
    files = frame.withColumn("file", F.lit("syslog"))
    kept = logs.timeline_range(files.filter("line like 'Jan%' or line like 'Feb%'"), "2023-12-31 00:00:00", "2024-01-31 00:00:00").collect()
    assert [r.line for r in kept] == ["Jan  5 06:00:00 host sshd[1]: x"]
    assert logs.untimed_lines(files).first().asDict() == {"file": "syslog", "lines": 10, "untimed": 4}


def test_script_indicators_are_custom_domains_and_addresses(spark):
    scripts = spark.createDataFrame([(1, "curl http://evil.example/x 10.1.2.3 feed.example")], "i int, ScriptBlockText string")
    listed = spark.createDataFrame([("evil.example", "domain", "custom"), ("feed.example", "domain", "feed"), ("10.1.2.3", "ip", "custom"),
                                    ("http://evil.example/x", "url", "custom")], "indicator string, kind string, list string")
    assert sorted(r.indicator for r in ioc.ioc_script(scripts, listed).collect()) == ["10.1.2.3", "evil.example"]


@pytest.mark.parametrize("number", [1, 3, 9, 12, 17, 25, 40])
def test_deep_pages_with_missing_and_odd_sort_keys(spark, number):
    """Pages found by narrowing are those of a plain sort, with NULL, NaN and repeated keys."""
    rng = random.Random(number)
    rows = [(rng.choice([None, 1.5, float("nan"), 2.5, -1.0]), rng.choice([None, "a", "b"]), i) for i in range(1000)]
    frame = spark.createDataFrame(rows, "a double, b string, i int").repartition(4)
    for order in (["a", "-b", "i"], ["-a", "b", "-i"]):
        deep, plain = (report.page(frame, order, number, 25, d).collect() for d in (20, 10**9))
        assert [r.i for r in deep] == [r.i for r in plain] and len(deep) == 25


@pytest.mark.parametrize("number, size", [(1, 25), (4, 25), (18, 25), (20, 25), (999, 25), (0, 25), (3, 100), (9, 33)])
@pytest.mark.parametrize("deep", [10**9, 20])
def test_pages(spark, number, size, deep):
    rng = random.Random(number)
    rows = [(rng.choice("abc"), i, rng.randint(0, 3)) for i in range(500)]
    frame = spark.createDataFrame(rows, "a string, i int, b int").repartition(4)
    order = sorted(rows, key=lambda r: (r[0], -r[2], r[1]))
    last = -(-len(rows) // size)
    start = (min(max(number, 1), last) - 1) * size
    assert [tuple(r) for r in report.page(frame, ["a", "-b", "i"], number, size, deep).collect()] == order[start:start + size]


def test_page_of_nothing(spark):
    assert report.page(spark.range(0), ["id"], 3).count() == 0
    assert report.page_info(spark.range(0)).first().asDict() == {"rows": 0, "pages": 1}


def test_reports_on_nothing(spark):
    empty = spark.createDataFrame([], "RuleLevel string")
    assert {r.level: r.findings for r in report.level_facets(empty).collect()} == dict.fromkeys(["all", *report.LEVELS], 0)
    assert report.overview_kpis(empty, empty, empty).first().asDict() == {
        "total": 0, "critical": 0, "rule_hits": 0, "hash_hits": 0, "ioc_hits": 0}


def test_event_categories_per_log(spark):
    rdp = report.CATEGORY_LOGS["Outgoing RDP"]
    log = spark.createDataFrame([("Security", 1102), (rdp, 1102), ("Security", 4624), ("Security", 1)], "log_name string, event_id int")
    assert _rows(report.event_categories(log, per_log=False)) == [("Logon Events", 1), ("Outgoing RDP", 2), ("RDP Logins", 1)]
    assert _rows(report.event_categories(log)) == [("Logon Events", 1), ("Outgoing RDP", 1), ("RDP Logins", 1)]


def test_network_cards_with_listening_table(spark):
    connections = spark.createDataFrame([("8.8.8.8", " Established "), ("10.0.0.1", "established"), (None, None)], "remote_addr string, state string")
    assert report.network_cards(connections, spark.range(4)).first().asDict() == {"established": 2, "listening": 4, "external": 1}


def test_short_and_odd_capture_lines(spark):
    lines = ["HEADER", "root  1 0.0", "", "u 2 0 0 1 2 ? S 10:00 0:01 /bin/sh -c  a b"]
    frame = spark.createDataFrame([("h", "ps", i + 1, line) for i, line in enumerate(lines)], "host string, capture string, line_no long, line string")
    rows = {r.line_no: r for r in snapshots.parse_capture(frame, "ps", "ps").collect()}
    assert sorted(rows) == [2, 3, 4]
    assert (rows[2].user, rows[2].pid, rows[2].command) == ("root", "1", "") and rows[3].user == ""
    assert rows[4].command == "/bin/sh -c  a b"
    hits = spark.createDataFrame([("a|b|c|d",), ("No matches found",)], "value string")
    assert _rows(snapshots.parse_ioc_hits(hits)) == [("None", "N/A", "No matches found"), ("a", "b", "c|d")]


def test_date_helpers(spark):
    cases = {"2024-02-29": True, "2023-02-29": False, "2024-01-01 10:00:00": True, "yesterday": False, "": False}
    rows = spark.createDataFrame([(v,) for v in cases], "v string").select("v", logs.valid_date(F.col("v")).alias("ok")).collect()
    assert {r.v: r.ok for r in rows} == cases


def test_carry_forward_keeps_rows_without_a_group(spark):
    rows = [(None, 1, "a"), (None, 2, None), ("h", 1, "b"), ("h", 2, None)]
    got = history.carry_forward(spark.createDataFrame(rows, "h string, i int, v string"), "v", ["h"], "i", "f")
    assert sorted(((r.h, r.i, r.f) for r in got.collect()), key=str) == sorted([(None, 1, "a"), (None, 2, "a"), ("h", 1, "b"), ("h", 2, "b")], key=str)
