"""Anchors of a rule: literals of which at least one occurs in an event that the rule hits.

A rule with anchors needs to be looked at only for events that hold one of them, and one pass over a text finds the anchors of
all rules. What is taken is always necessary, never sufficient: the rule itself is evaluated wherever an anchor occurs.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from fleetsift.functions.matching import TEXT_OPERATORS, glob_tokens, windash_values
from fleetsift.plans.rules import Options, Rule, child_nodes, folds, kind_of, matching_items

#: (field name, None for the raw event text; view of it; literal)
Anchor = tuple[str | None, str, str]
#: None: the node may hold without any known literal. Empty: it never holds.
Anchors = frozenset[Anchor] | None

# A regex that ignores case takes the long s for an s and the dotless i for an i, while lower-casing keeps them apart.
_SAFE_RUN = re.compile(r"[ -hj-rt-~]+")
_REGEX_BREAKS = frozenset(".^$|()[]{}*+?\\")


def rule_anchors(rule: Rule, options: Options) -> Anchors:
    """The best anchors of a whole rule: those whose shortest literal is longest."""
    return _node(rule.condition, {str(name).lower(): tree for name, tree in rule.items.items()}, rule.items, options)


def _best(sets: list[Anchors]) -> Anchors:
    """Of conditions that must all hold, any one's anchors will do."""
    known = [s for s in sets if s is not None]
    return max(known, key=lambda s: (not s, min((len(a[2]) for a in s), default=0), -len(s)), default=None)


def _union(sets: list[Anchors]) -> Anchors:
    """Of conditions of which one must hold, all anchors are needed."""
    return None if any(s is None for s in sets) else frozenset().union(*sets)


def _node(node, by_name: dict, items: dict, options: Options) -> Anchors:
    def go(child) -> Anchors:
        return _node(child, by_name, items, options)

    def item(name) -> Anchors:
        return go(by_name[str(name).lower()]) if str(name).lower() in by_name else frozenset()

    kind = kind_of(node)
    if kind in ("all", "any"):
        return (_best if kind == "all" else _union)([go(c) for c in child_nodes(node)])
    if kind == "not":
        return None
    if kind == "item_ref":
        return item(node.get("name", ""))
    if kind == "wildcard_ref":
        names = matching_items(items, str(node.get("pattern", "")))
        require_all = bool(names) and str(node.get("mode", "")).lower() == "all"
        return (_best if require_all else _union)([item(n) for n in names])
    return _matcher(node, kind == "raw", options) if kind in ("field", "raw") else frozenset()


def _matcher(node: dict, is_raw: bool, options: Options) -> Anchors:
    operator, fold = str(node.get("operator", "")).lower(), folds(node)
    if operator not in (*TEXT_OPERATORS, "re"):
        return None
    values = node.get("values")
    values = values if isinstance(values, (list, tuple)) else [values]
    field = None if is_raw else str(node.get("field", ""))
    windash = bool(node.get("windash")) and not is_raw

    def operand(value) -> Anchors:
        value = "" if value is None else str(value)
        candidates = [value] if is_raw else windash_values(value, windash)
        return _union([_literal(field, operator, c, fold, options) for c in candidates])

    return (_best if str(node.get("match") or "any").lower() == "all" else _union)([operand(v) for v in values])


def _literal(field: str | None, operator: str, value: str, fold: bool, options: Options) -> Anchors:
    view = "lower" if fold else "raw"
    if operator == "re":
        runs, as_regex = regex_runs(value), True
    else:
        tokens = glob_tokens(value, options.honour_escapes)
        runs = [text for kind, text in tokens if kind == "text"]
        as_regex = options.singleline or len(tokens) != len(runs)
        if not as_regex:
            runs = ["".join(runs)]
    if fold:
        runs = [part.lower() for run in runs for part in (_SAFE_RUN.findall(run.lower()) if as_regex else [run])]
    longest = max(runs or [""], key=len)
    return frozenset({(field, view, longest)}) if longest else None


def regex_runs(pattern: str) -> list[str]:
    """Literal runs that every match of a regex holds; none where the pattern is not plain enough to tell.

    Only what stands outside of groups, classes and alternatives is read.
    """
    if "\\Q" in pattern or "&&" in pattern or re.search(r"\(\?[a-zA-Z-]*[iuxd]", pattern):
        return []
    runs, run, at = [], "", 0
    while at < len(pattern):
        ch, width, literal = pattern[at], 1, ""
        if ch == "\\":
            width = 2
            following = pattern[at + 1:at + 2]
            if following.isalnum():
                # classes, boundaries, back references and code points: some take more characters than two
                if following not in "wWdDsSbBAzZ":
                    return []
            else:
                literal = following
        elif ch == "(" or ch == "[":
            width = _skipped(pattern, at)
            if not width:
                return []
        elif ch in "|)]":
            return []
        elif ch in "{}":
            end = pattern.find("}", at)
            if ch == "}" or end < 0:
                return []
            width = end - at + 1
        elif ch not in _REGEX_BREAKS:
            literal = ch
        at += width
        if literal and pattern[at:at + 1] not in ("*", "?", "{", "+"):
            run += literal
            continue
        if literal and pattern[at:at + 1] == "+":
            run += literal
        runs.append(run)
        run = ""
    return [r for r in [*runs, run] if r]


def _skipped(pattern: str, at: int) -> int:
    """Width of the group or class that starts here; 0 if it is too involved."""
    depth, start, in_class = 0, at, False
    while at < len(pattern):
        ch = pattern[at]
        if ch == "\\":
            at += 2
            continue
        if in_class:
            if ch == "[":
                return 0
            if ch == "]" and pattern[at - 1] not in "[^":
                in_class = False
                if not depth:
                    return at - start + 1
        elif ch == "[":
            in_class = True
        elif ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
            if not depth:
                return at - start + 1
        at += 1
    return 0


def file_rules(
    pairs: list[tuple[int, Rule]], options: Options, alias_of: Callable[[str | None, str], str | None]
) -> tuple[dict[str, dict[str, list[int]]], list[int]]:
    """Rules by what they wait for: alias of a projected text, then literal, then ids; and the ids of rules that always run.

    ``alias_of`` names the projected view of a field, None if the source has no such field: then it never holds the literal.
    Ids that are in neither never hold.
    """
    filed: dict[str, dict[str, list[int]]] = {}
    always = []
    for i, rule in pairs:
        anchors = rule_anchors(rule, options)
        if anchors is None:
            always.append(i)
            continue
        for field, view, literal in anchors:
            alias = alias_of(field, view)
            if alias is not None:
                filed.setdefault(alias, {}).setdefault(literal, []).append(i)
    return filed, always
