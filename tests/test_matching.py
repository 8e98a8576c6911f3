import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetsift.functions.addresses import is_external
from fleetsift.functions.matching import Views, bad_patterns, glob_regex, java_regex, match, match_sql, quoted, windash_values
from fleetsift.plans.rules import Options, RuleError, compile_expression, compile_rule, rule_from_dict
from tests.reference import evaluate, matcher

VALUES = [None, "", "  ", "foo", "FOO", "a\nfoo\nb", "foo\n", "foo\r", "-enc", "/enc", "C:\\Windows\\a.exe", "a*b", "a?b", "é", "É",
          "a\\b", "it's", "${x}", "x$y", "afoob", "\t\n", "ab\nab", "\\Q.\\E", "axxb", "10.0.0.1"]
OPERANDS = ["foo", "FOO", "f?o", "a*b", "*", "-enc", "C:\\WINDOWS\\*.exe", "é", "a\\b", "it's", "${x}", "$", "\\Q.\\E", "", "o\n", "b*a"]


@pytest.fixture(scope="module")
def values(spark):
    return spark.createDataFrame([(i, v) for i, v in enumerate(VALUES)], "i int, v string").cache()


@pytest.mark.parametrize("operator", ["exact", "contains", "startswith", "endswith"])
@pytest.mark.parametrize("fold", [True, False])
def test_truth_table(values, operator, fold):
    columns = [match("v", operator, [o], ignore_case=fold).alias(f"c{k}") for k, o in enumerate(OPERANDS)]
    for row in values.select("v", *columns).collect():
        for k, operand in enumerate(OPERANDS):
            expected = matcher({"operator": operator, "values": [operand], "ignore_case": fold}, row.v or "")
            assert row[f"c{k}"] is expected, (row.v, operator, operand, fold)


def test_special_cases(values):
    rows = {r.v: r for r in values.select(
        "v", match("v", "is_null").alias("blank"), match("v", "contains", []).alias("none"),
        match("v", "contains", [], match="all").alias("all_none"), match("v", "contains").alias("absent"),
        match("v", "contains", ["-ENC"], windash=True).alias("dash"), match("v", "exact", ["foo", "é"]).alias("either"),
        match("v", "re", ["^foo$"]).alias("re"), match("v", "re", ["a.foo"]).alias("dot"),
        match("v", "contains", ["a\\*b"], honour_escapes=True).alias("escaped"),
        match("v", "contains", ["foo"], singleline=True).alias("singleline"),
        match("v", "cidr", ["10.0.0.0/8"]).alias("cidr"),
    ).collect()}
    blanks = {None, "", "  ", "\t\n"}
    for value, row in rows.items():
        assert row.blank is (value in blanks)
        assert (row.none, row.all_none, row.absent) == (False, True, False)
        assert row.dash is (value in ("-enc", "/enc"))
        assert row.either is (value in ("foo", "FOO", "é", "É"))
        assert row.re is (value in ("foo", "FOO", "foo\n"))
        assert row.dot is False
        assert row.escaped is (value == "a*b")
        assert row.cidr is (value == "10.0.0.1")
    assert rows["a\nfoo\nb"].singleline is False and rows["afoob"].singleline is True


def test_cidr_and_external(spark):
    cases = [("10.0.0.1", "10.0.0.0/8", True), ("11.0.0.1", "10.0.0.0/8", False), ("198.51.100.255", "198.51.100.0/24", True),
             ("1.2.3.4", "0.0.0.0/0", True), ("1.2.3.4", "fe80::/10", False), ("fe80::1", "fe80::/10", True), ("x", "10.0.0.0/8", False),
             ("10.0.0.0", "10.0.0.0", False), ("fe80::1", "0.0.0.0/0", False), ("2001:db8::1", "2001:db8::/33", True),
             ("2001:db8:8000::1", "2001:db8::/33", False), ("10.0.0.1", "10.0.0.1/32", True), ("10.0.0.300", "10.0.0.0/8", False),
             ("10.0.0.1", "10.0.0.0/x", False)]
    for address, block, expected in cases:
        assert spark.range(1).select(match(quoted(address), "cidr", [block]).alias("m")).first().m is expected, (address, block)
    external = ["8.8.8.8", "172.32.0.1", "172.15.0.1"]
    local = ["", "*", "::", "0.0.0.0", "::1", "127.0.0.1", "10.1.1.1", "192.168.1.1", "169.254.1.1", "172.16.0.1", "fe80::1", "fd00::1",
             "localhost", " LocalHost ", None]
    rows = spark.createDataFrame([(a,) for a in external + local], "a string").select("a", is_external(F.col("a")).alias("e")).collect()
    assert {r.a for r in rows if r.e} == set(external)


def test_helpers(spark):
    assert windash_values("-a/b", True) == ["-a/b", "/a/b", "-a-b"]
    assert windash_values("", True) == []
    assert glob_regex("a*b", "contains") == r"(?s)\A(?>.*?\Qa\E)(?>.*?\Qb\E)"
    assert bad_patterns(spark, [java_regex("(", True), java_regex("a+", False)]) == {java_regex("(", True)}


TEXTS = st.sampled_from(["foo", "FOO", "a-b", "a/b", "a*b", "", "b", "x.exe", "10.0.0.1", "fo\no"])
FIELD = st.fixed_dictionaries({
    "type": st.just("field"), "field": st.sampled_from(["F", "g", "missing"]),
    "operator": st.sampled_from(["exact", "contains", "startswith", "endswith", "is_null", "Contains"]),
    "values": st.lists(TEXTS, max_size=3), "match": st.sampled_from(["any", "all"]), "windash": st.booleans(),
    "ignore_case": st.booleans()})
LEAF = st.one_of(FIELD, st.just({"type": "item_ref", "name": "one"}), st.just({"type": "wildcard_ref", "pattern": "o*", "mode": "all"}),
                 st.just({"type": "wildcard_ref", "pattern": "t*"}), st.just({"type": "nonsense"}), st.just({"type": "all"}),
                 st.just({"type": "raw", "operator": "contains", "values": ["O"]}))
TREE = st.recursive(LEAF, lambda t: st.one_of(
    st.builds(lambda c: {"type": "all", "children": c}, st.lists(t, max_size=3)),
    st.builds(lambda c: {"type": "any", "children": c}, st.lists(t, max_size=3)),
    st.builds(lambda c: {"type": "not", "child": c}, t)), max_leaves=8)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(trees=st.lists(TREE, min_size=5, max_size=12), item=FIELD)
def test_trees_agree_with_interpreter(spark, trees, item):
    rng = random.Random(1)
    pool = ["foo", "FOO", "a-b", "a/b", "a*b", "", "xb", "c:\\x.exe", "fo\no", None]
    rows = [(i, rng.choice(pool), rng.choice(pool)) for i in range(20)]
    events = spark.createDataFrame(rows, "i int, f string, g string")
    items = {"one": item, "other": {"type": "field", "field": "g", "operator": "contains", "values": ["o"], "ignore_case": True}}

    def views_of(name):
        return Views(name.lower() if name.lower() in ("f", "g") else "''")

    columns = [F.expr(compile_expression(t, items, views_of, lambda: Views("concat(coalesce(f, ''), '|')"))).alias(f"t{k}")
               for k, t in enumerate(trees)]
    for row in events.select("f", "g", *columns).collect():
        for k, tree in enumerate(trees):
            assert row[f"t{k}"] is evaluate(tree, items, {"f": row.f, "g": row.g}, (row.f or "") + "|"), (tree, row)


def test_compile_errors():
    loop = rule_from_dict({"items": {"a": {"type": "item_ref", "name": "A"}}, "condition": {"type": "item_ref", "name": "a"}})
    odd = rule_from_dict({"condition": {"type": "field", "field": "f", "operator": "near", "values": ["a"]}})
    for rule in (loop, odd):
        with pytest.raises(RuleError):
            compile_rule(rule, Views, lambda: Views("''"))
    warnings = []
    assert compile_expression({"type": "not"}, {}, Views, lambda: Views("''"), Options(), warnings) == "(NOT false)"
    assert len(warnings) == 1


def test_collected_regexes_are_those_that_run():
    from fleetsift.functions.matching import java_regex, windash_values
    from fleetsift.plans.rules import regexes, rule_from_dict

    node = {"type": "field", "field": "f", "operator": "re", "values": ["[+/*]", "("], "ignore_case": None, "windash": True}
    rule = rule_from_dict({"title": "t", "rule_file": "t.json", "level": "low", "sources": ["x"], "items": {"a": node},
                           "condition": {"type": "item_ref", "name": "a"}})
    assert set(regexes([rule])) == {java_regex(v, True) for value in node["values"] for v in windash_values(value, True)}


def test_many_blocks_are_looked_up_by_the_length_of_their_prefix(spark):
    import ipaddress

    rng = random.Random(12)
    blocks = [f"{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.0/{rng.randint(12, 32)}" for _ in range(10_000)] + ["bad", "10.0.0.0", "fe80::/10"]
    texts = [f"{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 3)}" for _ in range(300)] + ["fe80::1", "", None, "x", "1.2.3"]
    nets = {}
    for b in blocks[:10_000]:
        net = ipaddress.ip_network(b, strict=False)
        nets.setdefault(net.prefixlen, set()).add(int(net.network_address) >> (32 - net.prefixlen))
    frame = spark.createDataFrame([(t,) for t in texts], "x string")
    test = match_sql(Views("x"), "cidr", blocks)
    assert test.count("shiftright") <= 33
    expected = {t: t == "fe80::1" or bool(t) and t.count(".") == 3 and any(int(ipaddress.ip_address(t)) >> (32 - p) in own for p, own in nets.items()) for t in texts}
    got = {r.x: r.hit for r in frame.select("x", F.expr(test).alias("hit")).collect()}
    assert got == expected and 20 < sum(got.values()) < len(texts)
    none = frame.select(F.expr(match_sql(Views("x"), "cidr", ["bad", ""])).alias("hit"))
    assert not any(r.hit for r in none.collect())
