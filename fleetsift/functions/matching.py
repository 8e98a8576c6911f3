"""Matchers: (value, operator, operands) as one Boolean SQL expression that is never NULL.

Expressions are built as Spark SQL text: a corpus of hundreds of rules holds thousands of operands, and handing Spark one
text per batch of rules takes a fraction of the time that building each comparison as a ``Column`` takes.

A matcher reads its value through ``Views``, so a scan can project the folded or parsed form of a field once and share it
between all the rules that look at the field.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from fleetsift.functions.addresses import in_any_cidr, in_cidr, v4_sql, v6_sql

TEXT_OPERATORS = ("exact", "contains", "startswith", "endswith")
OPERATORS = (*TEXT_OPERATORS, "re", "cidr", "is_null")
_ESCAPED = str.maketrans({"\\": "\\\\", "'": "\\'", "$": "\\u0024"})


class UnknownOperator(ValueError):
    """A rule names an operator that does not exist."""


def quoted(value: str) -> str:
    """A string as a SQL literal. The dollar sign is escaped too, as ``${...}`` would be replaced by a setting."""
    return "'" + value.translate(_ESCAPED) + "'"


def text(value: str) -> str:
    """Missing values compare as the empty string."""
    return f"coalesce(cast({value} AS string), '')"


VIEWS: dict[str, Callable[[str], str]] = {
    "raw": lambda value: value,
    "lower": lambda value: f"lower({value})",
    "v4": v4_sql,
    "v6": v6_sql,
}


class Views:
    """The forms of one value that matchers ask for, computed in place. The value is a SQL expression."""

    def __init__(self, value: str):
        self.value = text(value)

    def get(self, view: str) -> str:
        return VIEWS[view](self.value)

    def contains(self, operand: str, fold: bool) -> str:
        return f"contains({self.get('lower' if fold else 'raw')}, {quoted(operand.lower() if fold else operand)})"


def any_of(parts: Iterable[str]) -> str:
    parts = list(parts)
    return parts[0] if len(parts) == 1 else "(" + " OR ".join(parts) + ")" if parts else "false"


def all_of(parts: Iterable[str]) -> str:
    parts = list(parts)
    return parts[0] if len(parts) == 1 else "(" + " AND ".join(parts) + ")" if parts else "true"


def rlike(value: str, pattern: str) -> str:
    return f"rlike({value}, {quoted(pattern)})"


def windash_values(value: str, windash: bool) -> list[str]:
    """The value, with dashes as slashes, and with slashes as dashes; empty ones match nothing and are dropped."""
    candidates = [value]
    if windash:
        candidates += [value.replace("-", "/"), value.replace("/", "-")]
    return [v for v in dict.fromkeys(candidates) if v]


# What a blank value looks like, with the blanks of all scripts.
BLANK = r"(?U)\A\s*\z"


def quote(literal: str) -> str:
    """A literal as a Java regex."""
    return "\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E" if literal else ""


def glob_tokens(value: str, honour_escapes: bool) -> list[tuple[str, str]]:
    """Split a value into ("text", literal), ("any", "*") and ("one", "?") tokens."""
    tokens: list[tuple[str, str]] = []
    literal, i = "", 0
    while i < len(value):
        ch = value[i]
        if honour_escapes and ch == "\\" and value[i + 1:i + 2] in ("*", "?", "\\"):
            literal += value[i + 1]
            i += 2
            continue
        if ch in "*?":
            if literal:
                tokens.append(("text", literal))
            tokens.append(("any", ch) if ch == "*" else ("one", ch))
            literal = ""
        else:
            literal += ch
        i += 1
    if literal:
        tokens.append(("text", literal))
    return tokens


def glob_regex(value: str, mode: str, honour_escapes: bool = False) -> str:
    """A wildcard value as a Java regex over the whole text (dot matches line ends).

    Pieces between ``*`` have a fixed length, so taking the first occurrence of each in an atomic group is exact and
    keeps the search linear in the length of the text.
    """
    pieces, piece = [], ""
    for kind, tok in glob_tokens(value, honour_escapes):
        if kind == "any":
            pieces.append(piece)
            piece = ""
        else:
            piece += "." if kind == "one" else quote(tok)
    pieces.append(piece)
    if mode in ("contains", "endswith"):
        pieces.insert(0, "")
    if mode in ("contains", "startswith"):
        pieces.append("")
    head, tail = pieces[0], pieces[-1]
    if len(pieces) == 1:
        return rf"(?s)\A{head}\z"
    middle = "".join(f"(?>.*?{p})" for p in pieces[1:-1] if p)
    return rf"(?s)\A{head}{middle}" + (rf".*{tail}\z" if tail else "")


def _text_match(views: Views, operator: str, value: str, fold: bool, honour_escapes: bool, singleline: bool) -> str:
    tokens = glob_tokens(value, honour_escapes)
    if singleline:
        body = "".join(quote(tok) if kind == "text" else (".*" if kind == "any" else ".") for kind, tok in tokens)
        anchored = {"exact": f"^{body}$", "contains": f"^.*{body}.*$", "startswith": f"^{body}.*$",
                    "endswith": f"^.*{body}$"}[operator]
        return rlike(views.get("raw"), ("(?diu)" if fold else "(?d)") + anchored)
    if any(kind != "text" for kind, _ in tokens):
        return rlike(views.get("raw"), ("(?iu)" if fold else "") + glob_regex(value, operator, honour_escapes))
    literal = "".join(tok for _, tok in tokens)
    if operator == "contains":
        return views.contains(literal, fold)
    left, right = views.get("lower" if fold else "raw"), quoted(literal.lower() if fold else literal)
    return f"{left} = {right}" if operator == "exact" else f"{operator}({left}, {right})"


def java_regex(pattern: str, fold: bool) -> str:
    """Flags that give the documented regex dialect: only ``\\n`` ends a line, classes such as ``\\w`` know Unicode."""
    unicode_classes = any(f"\\{c}" in pattern for c in "wWdDsSbB")
    return f"(?d{'iu' if fold else ''}{'U' if unicode_classes else ''})" + pattern


def bad_patterns(spark: SparkSession, patterns: list[str]) -> set[str]:
    """Patterns Spark's regex engine rejects. They are tried together first, one by one only if that fails."""
    def compiles(batch: list[str]) -> bool:
        try:
            spark.range(1).select([F.expr(rlike("''", p)).alias(f"c{i}") for i, p in enumerate(batch)]).collect()
            return True
        except Exception as failure:
            if "PATTERN" in str(failure) or "Syntax" in str(failure):
                return False
            raise

    if not patterns or compiles(patterns):
        return set()
    return {p for p in patterns if not compiles([p])}


def match_one(
    views: Views, operator: str, value: str, fold: bool,
    honour_escapes: bool = False, singleline: bool = False, rejected: frozenset[str] = frozenset(),
) -> str:
    """One value against one operand."""
    if operator == "cidr":
        return in_cidr(lambda: views.get("v4"), lambda: views.get("v6"), value)
    if operator == "re":
        pattern = java_regex(value, fold)
        return "false" if pattern in rejected else rlike(views.get("raw"), pattern)
    if operator in TEXT_OPERATORS:
        return _text_match(views, operator, value, fold, honour_escapes, singleline)
    raise UnknownOperator(operator)


def match_sql(
    views: Views, operator: str, values: list | None = None, match: str = "any", windash: bool = False,
    ignore_case: bool = True, keep_empty: bool = False, honour_escapes: bool = False, singleline: bool = False,
    rejected: frozenset[str] = frozenset(),
) -> str:
    """One value against a list of operands, any of which (or all of which) must match.

    An absent list counts as one empty operand. Empty operands match nothing unless ``keep_empty`` is set, as it is for
    matchers over the raw event text.
    """
    operator = str(operator).lower()
    if operator == "is_null":
        value = views.get("raw")
        return f"({value} = '' OR {rlike(value, BLANK)})"
    if operator not in OPERATORS:
        raise UnknownOperator(operator)
    if values is None:
        values = [None]
    if not isinstance(values, (list, tuple)):
        values = [values]
    operands = ["" if v is None else str(v) for v in values]
    options = dict(honour_escapes=honour_escapes, singleline=singleline, rejected=rejected)

    def per_operand(operand: str) -> str:
        candidates = [operand] if keep_empty else windash_values(operand, windash)
        return any_of(match_one(views, operator, c, ignore_case, **options) for c in candidates)

    require_all = str(match).lower() == "all"
    if operator == "cidr" and not (require_all or windash):
        return in_any_cidr(lambda: views.get("v4"), lambda: views.get("v6"), operands)
    plain = operator == "exact" and not (singleline or windash or require_all or keep_empty)
    if plain and len(operands) > 1:
        split = [glob_tokens(v, honour_escapes) for v in operands if v]
        if all(kind == "text" for tokens in split for kind, _ in tokens):
            literals = ["".join(tok for _, tok in tokens) for tokens in split]
            if ignore_case:
                literals = [v.lower() for v in literals]
            listed = ", ".join(quoted(v) for v in literals)
            return f"{views.get('lower' if ignore_case else 'raw')} IN ({listed})" if listed else "false"
    return (all_of if require_all else any_of)(per_operand(v) for v in operands)


def match(value: str, operator: str, values: list | None = None, **options) -> Column:
    """``match_sql`` over a SQL expression, as a column."""
    return F.expr(match_sql(Views(value), operator, values, **options))
