"""A plain interpreter of rule trees: the yardstick for the compiled expressions."""

import fnmatch
import ipaddress
import re


def glob_to_regex(value):
    return "".join(".*" if ch == "*" else "." if ch == "?" else re.escape(ch) for ch in value)


def one(actual, operator, value, fold):
    if operator == "cidr":
        address, slash, prefix = value.partition("/")
        try:
            net = ipaddress.ip_network(f"{address}/{max(0, int(prefix))}", strict=False)
            return bool(slash) and ipaddress.ip_address(actual) in net
        except (ValueError, TypeError):
            return False
    if operator == "re":
        try:
            return re.search(value, actual, re.I if fold else 0) is not None
        except re.error:
            return False
    body = glob_to_regex(value)
    pattern = {"exact": body, "contains": f".*{body}.*", "startswith": f"{body}.*", "endswith": f".*{body}"}[operator]
    return re.fullmatch(pattern, actual, (re.I if fold else 0) | re.S) is not None


def matcher(node, actual, raw=False):
    operator, fold = node["operator"].lower(), node.get("ignore_case", True)
    if operator == "is_null":
        return not actual.strip()
    values = node["values"] if "values" in node else [None]
    results = []
    for value in values:
        value = "" if value is None else str(value)
        candidates = [value]
        if not raw:
            if node.get("windash"):
                candidates += [value.replace("-", "/"), value.replace("/", "-")]
            candidates = [c for c in candidates if c]
        results.append(any(one(actual, operator, c, fold) for c in candidates))
    return all(results) if node.get("match") == "all" else any(results)


def evaluate(node, items, fields, raw=""):
    if not isinstance(node, dict):
        return False
    kind = str(node.get("type", "")).lower()
    children = node.get("children", [None])
    if kind == "all":
        return all(evaluate(c, items, fields, raw) for c in children)
    if kind == "any":
        return any(evaluate(c, items, fields, raw) for c in children)
    if kind == "not":
        return not evaluate(node.get("child"), items, fields, raw)
    if kind == "field":
        return matcher(node, fields.get(node["field"].lower()) or "")
    if kind == "raw":
        return matcher(node, raw, raw=True)
    if kind == "item_ref":
        return evaluate(items.get(node["name"]), items, fields, raw)
    if kind == "wildcard_ref":
        names = list(items) if node["pattern"] == "them" else [n for n in items if fnmatch.fnmatchcase(n, node["pattern"])]
        results = [evaluate(items[n], items, fields, raw) for n in names]
        return bool(results) and (all(results) if node.get("mode") == "all" else any(results))
    return False
