"""Token counts that follow edits.

A document is kept as a segment tree over its pre-tokens: each leaf holds a run of pre-tokens with their characters and tokens, and each
inner node the sums below it. An edit finds its place by walking the tree, encodes anew from a little before the edit up to
where the new pre-tokens meet the old boundaries again, replaces the leaves in between and updates the sums on the way up.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that parts text into pre-tokens before this vocabulary's merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters beyond its end that the pattern can look at before it settles a pre-token.
CONTEXT = 3
#: Pre-tokens of a leaf.
LEAF = 64
_CACHED = 500_000


class Counter:
    """Tokens of pre-tokens. The cache is emptied when full; it never changes a count."""

    def __init__(self, ranks: bytes):
        merges = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line.strip())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            n = len(self.encoding.encode_ordinary(piece))
            if len(piece) <= 64:
                if len(self.known) > _CACHED:
                    self.known.clear()
                self.known[piece] = n
        return n

    def runs(self, text: str) -> list[tuple[int, int]]:
        """(characters, tokens) of all pre-tokens."""
        known, count = self.known, self.count
        return [(len(p), known[p] if p in known else count(p)) for p in self.pattern.findall(text)]

    def pieces(self, text: str, start: int = 0) -> Iterator[str]:
        for match in self.pattern.finditer(text, start):
            yield match.group()


class Node:
    """A leaf with its pre-tokens' (characters, tokens), or an inner node over two."""

    __slots__ = ("left", "right", "runs", "chars", "tokens")

    def __init__(self, runs: list[tuple[int, int]] | None, left: Node | None = None, right: Node | None = None):
        self.runs, self.left, self.right = runs, left, right
        self.sum()

    def sum(self) -> None:
        if self.runs is None:
            self.chars = self.left.chars + self.right.chars
            self.tokens = self.left.tokens + self.right.tokens
        else:
            self.chars = sum(c for c, _ in self.runs)
            self.tokens = sum(t for _, t in self.runs)


def build(runs: list[tuple[int, int]]) -> Node:
    """A balanced tree over the pre-tokens."""
    nodes = [Node(runs[i:i + LEAF]) for i in range(0, len(runs), LEAF)] or [Node([])]
    while len(nodes) > 1:
        nodes = [Node(None, *nodes[i:i + 2]) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
    return nodes[0]


class Document:
    """A text with its tree; ``encoded`` counts the characters that were encoded, at first and by edits."""

    def __init__(self, text: str | None, counter: Counter):
        self.text, self.counter = text or "", counter
        self.root = build(counter.runs(self.text))
        self.encoded = len(self.text)

    @property
    def tokens(self) -> int:
        return self.root.tokens

    def edit(self, start: int, length: int, new: str) -> None:
        """Replace ``length`` characters from ``start`` on; what lies beyond the text's end is cut."""
        start = min(max(start, 0), len(self.text))
        stop = min(start + max(length, 0), len(self.text))
        shift = len(new) - (stop - start)
        # the last boundary that no look beyond a pre-token's end can tie to the edit
        begin = self._boundary(max(start - CONTEXT, 0))
        text = self.text[:start] + new + self.text[stop:]
        old, at, runs = self._after(begin), begin, []
        mark = begin
        for piece in self.counter.pieces(text, begin):
            runs.append((len(piece), self.counter.count(piece)))
            at += len(piece)
            # old boundaries behind the edit, moved: the rest is as before from the first one that meets a new boundary
            while mark + shift < at or mark < stop:
                size = next(old, None)
                if size is None:
                    break
                mark += size
            if mark >= stop and mark + shift == at:
                break
        else:
            mark = len(self.text)
        self.encoded += at - begin
        self.text = text
        if mark > begin or runs:
            self.root = _replace(self.root, begin, mark, runs)

    def _boundary(self, at: int) -> int:
        """The last boundary of pre-tokens at or before ``at``."""
        node, base = self.root, 0
        while node.runs is None:
            if base + node.left.chars <= at and node.right.chars:
                base += node.left.chars
                node = node.right
            else:
                node = node.left
        for chars, _ in node.runs:
            if base + chars > at:
                break
            base += chars
        return base

    def _after(self, at: int) -> Iterator[int]:
        """Sizes of the pre-tokens from the boundary ``at`` on."""
        def walk(node: Node, base: int) -> Iterator[int]:
            if base + node.chars <= at:
                return
            if node.runs is None:
                yield from walk(node.left, base)
                yield from walk(node.right, base + node.left.chars)
            else:
                for chars, _ in node.runs:
                    if base >= at:
                        yield chars
                    base += chars

        return walk(self.root, 0)


def _replace(node: Node, begin: int, end: int, runs: list[tuple[int, int]]) -> Node:
    """The tree with the pre-tokens between the boundaries ``begin`` and ``end`` replaced; nodes outside stay as they are."""
    if node.runs is None:
        half = node.left.chars
        if end <= half and node.left.chars:
            node.left = _replace(node.left, begin, end, runs)
        elif begin >= half:
            node.right = _replace(node.right, begin - half, end - half, runs)
        else:
            node.left = _replace(node.left, begin, half, runs)
            node.right = _replace(node.right, 0, end - half, [])
        if not node.left.chars:
            return node.right
        if not node.right.chars:
            return node.left
        node.sum()
        return node
    at, before, after = 0, [], []
    for chars, tokens in node.runs:
        if at < begin:
            before.append((chars, tokens))
        elif at >= end:
            after.append((chars, tokens))
        at += chars
    return build(before + runs + after) if len(before) + len(runs) + len(after) > 2 * LEAF else Node(before + runs + after)


_WORKER: dict[int, Counter] = {}


def _counter(ranks: bytes) -> Counter:
    """One counter per worker process."""
    key = hash(ranks)
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Counter(ranks)
    return _WORKER[key]


def read_ranks(path: str = RANKS) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """doc_id, text and ``edits``: the edits (doc_id, at, start, length, new) of each document, in the order of ``at`` and then of their values.

    The edits of one document meet in an array, as each builds on the one before it. Edits with a null doc_id or start are left out;
    null length is 0, null new is empty.
    """
    own = edits.filter("doc_id IS NOT NULL AND start IS NOT NULL").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(
        "at", F.col("start").cast("int").alias("start"), F.coalesce(F.col("length"), F.lit(0)).cast("int").alias("length"),
        F.coalesce(F.col("new"), F.lit("")).alias("new")))).alias("edits"))
    own = own.select("doc_id", F.transform("edits", lambda e: F.struct(e["start"].alias("start"), e["length"].alias("length"), e["new"].alias("new"))).alias("edits"))
    return docs.select("doc_id", "text").join(own, "doc_id", "left")


def counts(edited: DataFrame, path: str = RANKS) -> DataFrame:
    """doc_id, n_tokens, n_edits, n_tokens_edited, n_chars_edited, reencoded for every row of (doc_id, text, edits).

    ``edits`` is an array of (start, length, new) in characters of the text as the edits before left it, or null. ``reencoded`` is
    the number of characters that the edits made necessary to encode. Null and empty texts have 0 tokens and can be edited.
    """
    ranks = read_ranks(path)

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        counter = _counter(ranks)
        for texts, edits in batches:
            rows = []
            for text, own in zip(texts, edits, strict=True):
                doc = Document(text, counter)
                first, read = doc.tokens, doc.encoded
                own = [] if own is None else [e for e in own if e is not None]
                for e in own:
                    doc.edit(e["start"] or 0, e["length"] or 0, e["new"] or "")
                rows.append((first, len(own), doc.tokens, len(doc.text), doc.encoded - read))
            yield pd.DataFrame(rows, columns=["n_tokens", "n_edits", "n_tokens_edited", "n_chars_edited", "reencoded"])

    kind = "n_tokens long, n_edits int, n_tokens_edited long, n_chars_edited long, reencoded long"
    told = F.pandas_udf(_typed(run), kind)
    return edited.select("doc_id", told(F.col("text"), F.col("edits")).alias("c")).select("doc_id", "c.*")


def _typed(run):
    def wrapped(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        yield from run(batches)

    return wrapped


def edits_of(text: Column) -> Column:
    """Three edits made from a text's own values: a passage copied to another place, one taken out, and one replaced."""
    n = F.greatest(F.length(text), F.lit(1))

    def spot(salt: int) -> Column:
        return F.pmod(F.xxhash64(text, F.lit(salt)), n).cast("int")

    def edit(start: Column, length: int, new: Column) -> Column:
        return F.struct(start.alias("start"), F.lit(length).alias("length"), F.coalesce(new, F.lit("")).alias("new"))

    return F.array(edit(spot(1), 0, F.substr(text, spot(2) + 1, F.lit(40))), edit(spot(3), 25, F.lit("")),
                   edit(spot(4), 12, F.upper(F.substr(text, spot(5) + 1, F.lit(20)))))
