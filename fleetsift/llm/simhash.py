"""SimHash near-duplicates, joined exactly by vantage-point trees.

A tree is laid over a bounded sample of the fingerprints. Every fingerprint is then routed: at each node it goes to the side that its
distance to the vantage point names, and, where the triangle inequality lets a partner lie beyond the boundary, it also visits the
other side. A leaf holds its residents and the visitors from boundary-overlapping leaves; all pairs within the radius are found in
exactly one leaf. The sample shapes the work, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetsift.llm.common import Forest, components, fresh, materialise, sides, split_groups

#: Differing bits up to which fingerprints link.
RADIUS = 4
SHINGLE = 4
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of a whole text as an unsigned number.

    A-Z become lower case, words are runs other than ASCII white space, shingles are joined by one blank and counted with repeats. Fewer words
    than a shingle has: the whole sequence; no words or null: 0. A bit is 1 if set in over half of the hashes.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    count = len(words) - shingle + 1
    if count < 2:
        return xxhash.xxh64_intdigest(line, 42)
    starts, at = [], 0
    for word in words:
        starts.append(at)
        at += len(word) + 1
    starts.append(at)
    digest = xxhash.xxh64_digest
    joined = b"".join([digest(line[i:j - 1], 42) for i, j in zip(starts, starts[shingle:], strict=False)])
    octets = np.frombuffer(joined, np.uint8).reshape(count, 8)[:, ::-1]
    value = 0
    for k in range(8):
        ones = np.bincount(octets[:, k], minlength=256) @ _BITS
        value |= int(np.packbits(2 * ones > count, bitorder="little")[0]) << (8 * k)
    return value


def fingerprints(docs: DataFrame, *keep: str, shingle: int = SHINGLE) -> DataFrame:
    """The named columns of ``docs`` and ``fp``, the fingerprint as a signed long."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(x, shingle) for x in texts], dtype=np.uint64).view(np.int64), dtype="int64")

    return docs.select(*keep, F.pandas_udf(run, "long")(F.col("text")).alias("fp"))


@dataclass(frozen=True)
class Node:
    point: np.uint64
    within: int
    near: Node | int
    far: Node | int


def plant(sample: np.ndarray, depth: int, seed: int = 3) -> Node | int:
    """A tree with 2**depth leaves over the sample; each node takes as its vantage point the candidate whose distances spread the most."""
    rng = np.random.default_rng(seed)
    leaves = iter(range(2**depth))
    everyone = sample if len(sample) else np.zeros(1, np.uint64)

    def grow(own: np.ndarray, left: int) -> Node | int:
        if not left:
            return next(leaves)
        own = own if len(own) >= 16 else everyone
        candidates = rng.choice(own, min(8, len(own)), replace=False)
        distances = [np.bitwise_count(own ^ c).astype(int) for c in candidates]
        best = max(range(len(candidates)), key=lambda i: distances[i].std())
        middle = int(np.median(distances[best]))
        near = distances[best] <= middle
        return Node(candidates[best], middle, grow(own[near], left - 1), grow(own[~near], left - 1))

    return grow(everyone, depth)


def route(tree: Node | int, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, leaf, visits): one row with ``visits`` false for each fingerprint, and one for each further leaf it has to visit."""
    found: list[tuple[np.ndarray, int, np.ndarray]] = []

    def walk(node: Node | int, at: np.ndarray, visits: np.ndarray) -> None:
        if not len(at):
            return
        if isinstance(node, int):
            found.append((at, node, visits))
            return
        d = np.bitwise_count(fps[at] ^ node.point).astype(int)
        # A resident beyond the boundary visits the near side; a pair across the boundary meets there and nowhere else.
        near = (d <= node.within) | (d - radius <= node.within)
        far = (d > node.within) | (visits & (d + radius > node.within))
        walk(node.near, at[near], visits[near] | (d[near] > node.within))
        walk(node.far, at[far], visits[far])

    walk(tree, np.arange(len(fps)), np.zeros(len(fps), bool))
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool)
    return (np.concatenate([a for a, _, _ in found]), np.concatenate([np.full(len(a), leaf) for a, leaf, _ in found]),
            np.concatenate([v for _, _, v in found]))


def meet(left: np.ndarray, right: np.ndarray, radius: int, itself: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of pairs within the radius, block by block; pairs with far distances to one more vantage point are not compared."""
    if not len(left):
        return
    point = left[0]
    dl, dr = (np.bitwise_count(x ^ point).astype(np.int16) for x in (left, right))
    ol, orr = np.argsort(dl, kind="stable"), np.argsort(dr, kind="stable")
    dl, dr = dl[ol], dr[orr]
    ls, rs = left[ol], right[orr]
    shells, starts = np.unique(dl, return_index=True)
    ends = np.append(starts[1:], len(dl))
    for shell, lo, hi in zip(shells, starts, ends, strict=True):
        a, b = np.searchsorted(dr, (shell - radius, shell + radius + 1))
        for at in range(lo, hi, 256):
            block = ls[at:min(at + 256, hi)]
            for start in range(a, b, 16_384):
                i, j = np.nonzero(np.bitwise_count(block[:, None] ^ rs[None, start:min(start + 16_384, b)]) <= radius)
                if len(i):
                    i, j = ol[i + at], orr[j + start]
                    if itself:
                        i, j = i[i != j], j[i != j]
                    yield i, j


def link(fps: DataFrame, *, radius: int = RADIUS, leaf: int = 32_768, cap: int = 65_536, sample: int = 16_384) -> DataFrame:
    """(fp, component_id) for all fingerprints of (doc_id, fp); component_id is the smallest doc_id reachable by links.

    Equal fingerprints are one node. The tree has leaves of about ``leaf`` nodes, as far as a sample of ``sample`` fingerprints, taken by
    hash, can shape them; a leaf with more than ``cap`` residents or visitors is dealt to several tasks. Rows with a null doc_id do not link.
    """
    nodes = materialise(fps.filter(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("node")), "fingerprints")
    n = nodes.count()
    depth = int(np.ceil(np.log2(max(n / leaf, 1))))
    drawn = [r.fp for r in nodes.orderBy(F.xxhash64("fp"), "fp").limit(sample).select("fp").collect()]
    depth = min(depth, max(0, int(np.log2(max(len(drawn), 1) / 16)))) if drawn else 0
    tree = plant(np.array(drawn, dtype=np.int64).view(np.uint64), depth)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("fp").to_numpy(zero_copy_only=False)
            at, leaves, visits = route(tree, values.view(np.uint64), radius)
            yield pa.RecordBatch.from_arrays([pa.array(leaves, pa.int32()), pa.array(visits), pa.array(values[at], pa.int64()),
                                              pa.array(batch.column("node").to_numpy(zero_copy_only=False)[at], pa.int64())],
                                             names=["leaf", "visits", "fp", "node"])

    placed = materialise(nodes.mapInArrow(routed, "leaf int, visits boolean, fp long, node long"), "routed")
    tasks = split_groups(placed, ["leaf"], "fp", "visits", cap)

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        first = group.iloc[0]
        left, right, itself = sides(first.task_i, first.task_j, first.whole, group.piece.to_numpy())
        values, node = group.fp.to_numpy(np.int64).view(np.uint64), group.node.to_numpy()
        forest = Forest(len(group))
        for side in ([left] if itself else []) + ([right] if len(right) else []):
            for i, j in meet(values[left], values[side], radius, side is left):
                forest.add(left[i], side[j])
        child, root = forest.edges()
        return pd.DataFrame({"a": node[child], "b": node[root]})

    edges = tasks.groupBy("leaf", "task_i", "task_j").applyInPandas(joined, "a long, b long")
    found = components(edges, "a", "b")
    return nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))


def simhash(docs: DataFrame, **options) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits) and component_id for every row; component_id is null where doc_id is."""
    fps = materialise(fingerprints(docs, "doc_id"), "simhash")
    linked = materialise(link(fps, **options), "linked")
    return fps.join(linked, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stand for their group, with their columns: one row, that of the smallest doc_id.

    Repeated rows of one doc_id are one document. Rows with a null doc_id all stay, as they link with nothing.
    """
    key, = fresh(docs, "key")
    fps = materialise(fingerprints(docs, "doc_id", F.xxhash64("text").alias("key")), "simhash")
    linked = materialise(link(fps, **options), "linked")
    kept = fps.join(linked, "fp").filter(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.min("key").alias("key"))
    kept = materialise(kept.select(F.col("doc_id").alias("k_id"), F.col("key").alias("k_key")), "kept")
    keyed = docs.withColumn(key, F.xxhash64("text"))
    stay = keyed.join(kept, (keyed["doc_id"] == kept["k_id"]) & (keyed[key] == kept["k_key"]), "left_semi").dropDuplicates(["doc_id", key])
    return stay.union(keyed.filter(F.col("doc_id").isNull())).select(*docs.columns)
