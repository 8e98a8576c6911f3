"""Embedding near-duplicates by a subspace pigeonhole join.

Two unit vectors with cosine >= t lie within squared distance 2 - 2t. A rotation, which keeps distances, spreads each vector's
energy evenly; the rotated vector is cut into low-dimensional blocks. If the whole squared distance is within the budget, then at least one
block's is within the budget's share of that block. So each block is range-joined under its share, and the union of what the
blocks find is verified with the full vectors.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetsift.llm.common import Forest, components, materialise, sides, split_groups

COSINE = 0.98
#: Dimensions of a block.
BLOCK = 8
_SLACK = 1e-9


def rotated(vectors: np.ndarray, seed: int = 9) -> np.ndarray:
    """Unit vectors, padded with zeros to a power of two (at least one block), turned by sign flips and Walsh-Hadamard transforms.

    Only sums and differences of whole columns: the result of a row does not depend on the rows beside it.
    """
    n, d = vectors.shape
    width = max(BLOCK, 1 << (max(d, 1) - 1).bit_length())
    x = np.zeros((n, width))
    x[:, :d] = vectors / np.sqrt(np.add.reduce(vectors * vectors, axis=1))[:, None]
    rng = np.random.default_rng(seed)
    for _ in range(2):
        x *= rng.choice((-1.0, 1.0), width)
        step = 1
        while step < width:
            y = x.reshape(n, width // (2 * step), 2, step)
            x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, width)
            step *= 2
        x /= np.sqrt(width)
    return x


def matrix(column) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in column], dtype=np.float64).reshape(len(column), -1)


def usable(embeddings: DataFrame) -> DataFrame:
    """Rows whose vector is not null or empty and holds finite numbers only."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return embeddings.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fine)


def near_pairs(block_at: int, left: np.ndarray, right: np.ndarray, lx: np.ndarray, rx: np.ndarray, cosine: float,
               itself: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that link and whose first block within its share is ``block_at``; ``left`` and ``right`` are vectors, ``lx`` and ``rx`` turned.

    The range join sorts both sides by the block's first coordinate and compares a run of rows with the window within the radius.
    """
    blocks = lx.shape[1] // BLOCK
    share = (2 - 2 * cosine) / blocks + _SLACK
    radius = np.sqrt(share)
    part = slice(block_at * BLOCK, (block_at + 1) * BLOCK)
    ol, orr = np.argsort(lx[:, part.start], kind="stable"), np.argsort(rx[:, part.start], kind="stable")
    a, b = lx[ol, part], rx[orr, part]
    norms = np.sqrt((left * left).sum(1)), np.sqrt((right * right).sum(1))
    for at in range(0, len(a), 128):
        rows = a[at:at + 128]
        lo, hi = np.searchsorted(b[:, 0], (rows[0, 0] - radius, rows[-1, 0] + radius), side="left")
        hi = max(hi, np.searchsorted(b[:, 0], rows[-1, 0] + radius, side="right"))
        for start in range(lo, hi, 8_192):
            window = b[start:min(start + 8_192, hi)]
            rough = (rows * rows).sum(1)[:, None] + (window * window).sum(1)[None] - 2 * rows @ window.T
            i, j = np.nonzero(rough <= share + 1e-7)
            i, j = ol[i + at], orr[j + start]
            if itself:
                i, j = i[i < j], j[i < j]
            for cut in range(0, len(i), 100_000):
                x, y = i[cut:cut + 100_000], j[cut:cut + 100_000]
                gaps = ((lx[x] - rx[y]) ** 2).reshape(len(x), blocks, BLOCK).sum(2) <= share
                own = gaps[:, block_at] & (np.argmax(gaps, axis=1) == block_at)
                x, y = x[own], y[own]
                linked = (left[x] * right[y]).sum(1) / (norms[0][x] * norms[1][y]) >= cosine
                if linked.any():
                    yield x[linked], y[linked]


def duplicates(embeddings: DataFrame, *, cosine: float = COSINE, cell: int = 4_096) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding, label).

    Vectors link when their labels are equal and not null and the cosine in double precision is at least ``cosine``. Null, empty,
    all-zero vectors and those with null or non-finite components, and rows with a null label, link with nothing: n_links 0, a
    component of their own. So does a null vec_id, with a null component_id and kept false. Vectors of different length do not
    link. Equal vectors of a label are compared once, with their number; rows that share a vec_id are one node of a component but
    links are counted by row.

    Each block's range join is dealt by cells of twice the radius along the block's first coordinates, as many as a label needs
    to have about ``cell`` vectors in a cell; a cell that is still larger is dealt to several tasks.
    """
    source = embeddings.select("vec_id", "label", "embedding")
    nonzero = F.exists("embedding", lambda x: x != 0)
    valid = usable(source).filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & nonzero)
    key = [F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), F.col("embedding")).alias("h2")]
    nodes = valid.groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"))
    nodes = materialise(nodes.select("*", *key, F.size("embedding").alias("width")), "vectors")
    # along one coordinate a cell of twice the radius holds less than half of the vectors
    deep = nodes.groupBy("label", "width").agg(F.least(F.lit(4), F.greatest(
        F.lit(1), F.ceil(F.log2(F.count(F.lit(1)) / cell)))).cast("int").alias("deep"))
    sized = nodes.join(materialise(deep, "labels"), ["label", "width"])
    label_type = dict(nodes.dtypes)["label"]
    kind = dict(nodes.dtypes)["embedding"]
    schema = f"label {label_type}, width int, block int, cell string, visits boolean, node long, copies long, embedding {kind}"

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas()
            for (width, deep), rows in frame.groupby(["width", "deep"]):
                yield from _cells(rows, int(width), int(deep), cosine, batch.schema.field("label").type, batch.schema.field("embedding").type)

    placed = materialise(sized.select("label", "width", "deep", "node", "copies", "embedding")
                         .mapInArrow(routed, schema), "cells")
    group = ["label", "width", "block", "cell"]
    tasks = split_groups(placed, group, "node", "visits", 2 * cell)

    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        left, right, itself = sides(first.task_i, first.task_j, first.whole, rows.piece.to_numpy())
        vectors = matrix(rows.embedding)
        turned = rotated(vectors)
        forest, links, copies = Forest(len(rows)), np.zeros(len(rows), np.int64), rows.copies.to_numpy()
        for side in ([left] if itself else []) + ([right] if len(right) else []):
            for i, j in near_pairs(int(first.block), vectors[left], vectors[side], turned[left], turned[side], cosine, side is left):
                i, j = left[i], side[j]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                forest.add(i, j)
        linked = np.flatnonzero(links)
        node = rows.node.to_numpy()
        return pd.DataFrame({"label": rows.label.to_numpy()[linked], "node": node[linked], "root": node[forest.label[linked]], "links": links[linked]})

    found = materialise(tasks.groupBy(*group, "task_i", "task_j").applyInPandas(joined, f"label {label_type}, node long, root long, links long"),
                        "links")
    member = components(found.select("node", "root").union(_shared(valid)), "node", "root")
    links = found.groupBy("label", "node").agg(F.sum("links").alias("links"))
    told = nodes.select("label", "h1", "h2", "node", "copies").join(links, ["label", "node"], "left").join(member, "node", "left").select(
        "label", "h1", "h2", F.coalesce("links", F.lit(0)).alias("links"), "copies", F.coalesce("component", "node").alias("component"))
    told = materialise(told, "told")
    good = valid.select("vec_id", "label", *key).join(told, ["label", "h1", "h2"]).select(
        "vec_id", (F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"), F.col("component").alias("component_id"))
    fine = F.coalesce(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & nonzero
        & F.col("vec_id").isNotNull() & F.col("label").isNotNull(), F.lit(False))
    alone = source.filter(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _shared(valid: DataFrame) -> DataFrame:
    """Links between the nodes of rows that share a vec_id."""
    by_row = valid.select("vec_id", F.xxhash64("label", "embedding").alias("h")).distinct()
    twice = by_row.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    rows = valid.groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.max("vec_id").alias("last")).filter("node <> last") \
        .select("label", "embedding", "node")
    both = valid.join(twice, "vec_id", "left_semi").join(rows, ["label", "embedding"])
    return both.select("vec_id", "node").filter("vec_id <> node")


def _cells(rows: pd.DataFrame, width: int, deep: int, cosine: float, label_type: pa.DataType,
           vector_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    vectors = matrix(rows.embedding)
    turned = rotated(vectors)
    blocks = turned.shape[1] // BLOCK
    radius = np.sqrt((2 - 2 * cosine) / blocks + _SLACK)
    deep = min(deep, BLOCK)
    offsets = [o for o in itertools.product((-1, 0, 1), repeat=deep) if o >= (0,) * deep]
    for block in range(blocks):
        x = turned[:, block * BLOCK:block * BLOCK + deep] / (2 * radius)
        home = np.floor(x).astype(int)
        for offset in offsets:
            # a vector visits the later cells that come as near to it as the radius
            step = np.array(offset)
            gap = np.where(step > 0, home + 1 - x, np.where(step < 0, x - home, 0.0))
            at = np.flatnonzero((gap <= 0.5 + 1e-6).all(1)) if step.any() else np.arange(len(x))
            names = ["_".join(map(str, c)) for c in (home[at] + step).tolist()]
            for start in range(0, len(at), 4_096):
                some = at[start:start + 4_096]
                n = len(some)
                yield pa.RecordBatch.from_arrays([
                    pa.array(rows.label.to_numpy()[some], label_type), pa.array(np.full(n, width), pa.int32()), pa.array(np.full(n, block), pa.int32()),
                    pa.array(names[start:start + 4_096], pa.string()), pa.array(np.full(n, bool(step.any()))), pa.array(rows.node.to_numpy()[some], pa.int64()),
                    pa.array(rows.copies.to_numpy()[some], pa.int64()), pa.array(rows.embedding.iloc[some].tolist(), vector_type)],
                    names=["label", "width", "block", "cell", "visits", "node", "copies", "embedding"])
