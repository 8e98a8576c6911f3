"""Detection rules: the envelope, and the compiler from a rule's expression tree to one Boolean SQL expression."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from fnmatch import fnmatchcase

from pyspark.sql import DataFrame, SparkSession

from fleetsift.functions.matching import OPERATORS, UnknownOperator, Views, all_of, any_of, java_regex, match_sql, windash_values
from fleetsift.schemas import RULE_META

# Severity ranks.
SEVERITY = {"critical": 5, "high": 4, "medium": 3, "low": 2, "informational": 1}


class RuleError(ValueError):
    """The rule cannot be evaluated."""


@dataclass(frozen=True)
class Rule:
    title: str = ""
    rule_id: str = ""
    level: str = ""
    status: str = ""
    category: str = ""
    rule_file: str = ""
    enabled: bool = True
    tags: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    items: dict = field(default_factory=dict, hash=False)
    condition: dict | None = field(default=None, hash=False)

    @property
    def rank(self) -> int:
        return SEVERITY.get(self.level.lower(), 0)


@dataclass(frozen=True)
class Options:
    """Compile options.

    honour_escapes: a backslash before ``*`` or ``?`` makes it literal (off: the backslash is text, the wildcard stays).
    singleline: wildcards and ``contains`` do not cross line ends (off: "anywhere in the value").
    """

    honour_escapes: bool = False
    singleline: bool = False
    rejected: frozenset[str] = frozenset()


def _strings(value) -> tuple[str, ...]:
    if value is None:
        return ()
    return tuple(str(v) for v in value) if isinstance(value, (list, tuple)) else (str(value),)


def rule_from_dict(doc: dict) -> Rule:
    """A parsed JSON object as a rule. It is disabled only by an ``enabled`` that reads "false"."""
    def text(key: str) -> str:
        return "" if doc.get(key) is None else str(doc[key])

    return Rule(
        title=text("title"), rule_id=text("rule_id"), level=text("level"), status=text("status"),
        category=text("category"), rule_file=text("rule_file"),
        enabled=str(doc.get("enabled", True)).lower() != "false",
        tags=_strings(doc.get("tags")), sources=_strings(doc.get("sources")),
        items=doc.get("items") or {}, condition=doc.get("condition"),
    )


def rules_to_df(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    """Rule envelopes as a DataFrame, with the trees as JSON text."""
    rows = [
        (r.rule_id, r.title, r.level, r.status, r.category, r.rule_file, r.enabled, list(r.tags), list(r.sources),
         json.dumps(r.items), json.dumps(r.condition))
        for r in rules
    ]
    return spark.createDataFrame(rows, RULE_META)


def rules_from_df(meta: DataFrame, limit: int = 200_000) -> list[Rule]:
    """Bring a rule table to the driver to compile it; refuses one that is not a rule corpus."""
    rows = meta.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"rule table has more than {limit} rows")
    return [
        Rule(r.title or "", r.rule_id or "", r.level or "", r.status or "", r.category or "", r.rule_file or "",
             r.enabled is not False, tuple(r.tags or ()), tuple(r.sources or ()),
             json.loads(r.items_json or "{}") or {}, json.loads(r.condition_json or "null"))
        for r in rows
    ]


def kind_of(node) -> str:
    return str(node.get("type", "")).lower() if isinstance(node, dict) else ""


def child_nodes(node: dict) -> list:
    if "children" not in node:
        return [None]
    children = node["children"]
    return children if isinstance(children, list) else [children]


def matching_items(items: dict, pattern: str) -> list[str]:
    """Names of the items a wildcard reference stands for; ``them`` means all."""
    if pattern.lower() == "them":
        return list(items)
    return [name for name in items if fnmatchcase(name.lower(), pattern.lower())]


def field_nodes(rule: Rule) -> list[dict]:
    """All field and raw matchers of a rule, used or not."""
    found, stack = [], [rule.condition, *rule.items.values()]
    while stack:
        node = stack.pop()
        if isinstance(node, dict):
            if kind_of(node) in ("field", "raw"):
                found.append(node)
            stack += [node.get("child"), *child_nodes(node)]
    return found


def folds(node: dict) -> bool:
    """Whether a matcher ignores case; an absent or null flag means yes."""
    flag = node.get("ignore_case")
    return True if flag is None else bool(flag)


def regexes(rules: Iterable[Rule]) -> list[str]:
    """Distinct regexes of the rules, as handed to Spark."""
    out: dict[str, None] = {}
    for rule in rules:
        for node in field_nodes(rule):
            if str(node.get("operator", "")).lower() == "re":
                windash = bool(node.get("windash")) and kind_of(node) == "field"
                for value in _strings(node.get("values")):
                    for variant in windash_values(value, windash):
                        out[java_regex(variant, folds(node))] = None
    return list(out)


def compile_expression(
    node, items: dict, views_of: Callable[[str], Views], raw_views: Callable[[], Views], options: Options = Options(),
    warnings: list[str] | None = None, _open: tuple[str, ...] = (),
) -> str:
    """One expression node as a Boolean SQL expression that is never NULL.

    ``views_of`` gives the views of a field by name and ``raw_views`` those of the raw event text. Named items are
    inlined where they are referenced.
    """
    by_name = {str(name).lower(): tree for name, tree in items.items()}

    def go(child, opened=_open) -> str:
        return compile_expression(child, items, views_of, raw_views, options, warnings, opened)

    def item(name: str) -> str:
        key = name.lower()
        if key in _open:
            raise RuleError(f"item {name!r} refers to itself")
        return go(by_name[key], (*_open, key)) if key in by_name else "false"

    kind = kind_of(node)
    if kind == "all":
        return all_of(go(c) for c in child_nodes(node))
    if kind == "any":
        return any_of(go(c) for c in child_nodes(node))
    if kind == "not":
        if node.get("child") is None and warnings is not None:
            warnings.append("'not' without 'child' is always true")
        return f"(NOT {go(node.get('child'))})"
    if kind == "item_ref":
        return item(str(node.get("name", "")))
    if kind == "wildcard_ref":
        names = matching_items(items, str(node.get("pattern", "")))
        if not names:
            return "false"
        require_all = str(node.get("mode", "")).lower() == "all"
        return (all_of if require_all else any_of)(item(str(n)) for n in names)
    if kind in ("field", "raw"):
        is_raw = kind == "raw"
        operator = str(node.get("operator", "")).lower()
        if operator not in OPERATORS:
            raise RuleError(f"unknown operator {operator!r}")
        return match_sql(
            raw_views() if is_raw else views_of(str(node.get("field", ""))), operator,
            values=node.get("values"), match=node.get("match") or "any",
            windash=bool(node.get("windash")) and not is_raw,
            ignore_case=folds(node), keep_empty=is_raw,
            honour_escapes=options.honour_escapes, singleline=options.singleline, rejected=options.rejected,
        )
    return "false"


def compile_rule(
    rule: Rule, views_of: Callable[[str], Views], raw_views: Callable[[], Views], options: Options = Options(),
    warnings: list[str] | None = None,
) -> str:
    """The whole rule as one Boolean SQL expression."""
    try:
        return compile_expression(rule.condition, rule.items, views_of, raw_views, options, warnings)
    except UnknownOperator as failure:
        raise RuleError(f"unknown operator {failure}") from failure


def map_matchers(node, change: Callable[[dict], dict]):
    """A tree with each field and raw matcher changed."""
    if not isinstance(node, dict):
        return node
    if kind_of(node) in ("field", "raw"):
        return change(node)
    out = dict(node)
    if "children" in node:
        out["children"] = [map_matchers(c, change) for c in child_nodes(node)]
    if "child" in node:
        out["child"] = map_matchers(node["child"], change)
    return out


def inject_values(rule: Rule, item: str, values: Iterable[str], skip: set[str] = frozenset()) -> Rule:
    """Add indicator values to a named item of a rule (to the item itself or to the matchers inside it, except of fields to ``skip``)."""
    extra = list(values)

    def add(node: dict) -> dict:
        if node.get("field") in skip:
            return node
        return {**node, "values": list(dict.fromkeys([*(node.get("values") or []), *extra]))}

    return replace(rule, items={
        name: map_matchers(tree, add) if str(name).lower() == item.lower() else tree for name, tree in rule.items.items()
    })
