"""Finding many literal strings in a text in one pass.

Testing n literals with ``contains`` costs n passes over the text. An Aho-Corasick automaton, run on Arrow batches,
reports all literals in one pass, so its cost does not grow with the list. Below ``INDEX_FROM`` literals the built-in
``contains`` is cheaper, because the text does not have to leave the JVM.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

INDEX_FROM = 64
MAX_LITERALS = 100_000
MAX_LITERAL_BYTES = 16 << 20


# Automata of this worker process by the digest of their literals; a task finds those that earlier tasks have built.
_BUILT: dict[str, ahocorasick.Automaton] = {}
_MOST_KEPT = 2 * MAX_LITERALS


def can_ship(literals: list[str]) -> bool:
    """Whether the list is small enough to travel with every task."""
    return len(literals) <= MAX_LITERALS and sum(len(x.encode("utf-8", "surrogatepass")) for x in literals) <= MAX_LITERAL_BYTES


def can_index(literals: list[str]) -> bool:
    """Whether the list is worth an automaton and small enough to ship with every task."""
    return len(literals) >= INDEX_FROM and can_ship(literals)


def _automaton(digest: str, literals: list[str]) -> ahocorasick.Automaton:
    if digest not in _BUILT:
        if sum(map(len, _BUILT.values())) + len(literals) > _MOST_KEPT:
            _BUILT.clear()
        automaton = ahocorasick.Automaton()
        for i, literal in enumerate(literals):
            automaton.add_word(literal, i)
        automaton.make_automaton()
        _BUILT[digest] = automaton
    return _BUILT[digest]


def _search(literals: list[str]):
    digest = hashlib.sha256("\0".join(literals).encode("utf-8", "surrogatepass")).hexdigest()

    @F.pandas_udf("array<int>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = _automaton(digest, literals)
        for texts in batches:
            yield texts.map(lambda t: list({i for _, i in automaton.iter(t)}) if t else [])

    return found


def literal_ids(value: Column, literals: list[str]) -> Column:
    """Positions of the (non-empty, distinct) literals that occur in the value, as an array."""
    if can_index(literals):
        return _search(literals)(value)
    flags = [F.when(F.contains(value, F.lit(x)), F.lit(i)) for i, x in enumerate(literals)]
    return F.array_compact(F.array(*flags)) if flags else F.array().cast("array<int>")
