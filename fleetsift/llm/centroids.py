"""Centroid clustering by a progressive search over Walsh-Hadamard coefficients.

The transform of integer vectors is exact, and the squared distance of two transforms is ``DIMENSIONS`` times that of the vectors. So a
sum over some coefficients never exceeds the whole: a centroid whose sum so far is beyond the whole of another one is strictly worse and
is dropped. Coefficients are taken from coarse to fine; the centroids that stay get all of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetsift.llm.common import materialise

DIMENSIONS = 64
#: Coefficients added between two eliminations.
STEP = 8
#: Integer components below this size keep all sums of squares within 64 bits.
LARGEST = 2**21


def coarse_to_fine(width: int = DIMENSIONS) -> np.ndarray:
    """Positions of the Walsh-Hadamard coefficients by the number of sign changes of their rows."""
    rows = np.ones((1, 1), np.int64)
    while len(rows) < width:
        rows = np.block([[rows, rows], [rows, -rows]])
    return np.argsort((np.diff(rows, axis=1) != 0).sum(1), kind="stable")


_ORDER = coarse_to_fine()


def transformed(vectors: np.ndarray) -> np.ndarray:
    """Exact coefficients of the rows, coarse ones first. Twice the transform is ``DIMENSIONS`` times the vector."""
    return _hadamard(vectors)[:, _ORDER]


def restored(coefficients: np.ndarray) -> np.ndarray:
    """The integer rows whose coefficients these are."""
    x = np.empty_like(coefficients)
    x[:, _ORDER] = coefficients
    return _hadamard(x) // DIMENSIONS


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, width = x.shape
    step = 1
    while step < width:
        y = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, width)
        step *= 2
    return x


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of coefficients the nearest centroid, the smaller number of equally near ones, and the squared distance of the vectors."""
    n, k = len(x), len(centroids)
    chosen, distance = np.zeros(n, np.int64), np.zeros(n, np.int64)
    run = max(1, 2**18 // k)
    for at in range(0, n, run):
        rows = x[at:at + run]
        first = ((rows[:, None, :STEP] - centroids[None, :, :STEP]) ** 2).sum(2)
        bound = ((rows - centroids[first.argmin(1)]) ** 2).sum(1)
        i, j = np.nonzero(first <= bound[:, None])
        part = first[i, j]
        for lo in range(STEP, x.shape[1], STEP):
            part = part + ((rows[i, lo:lo + STEP] - centroids[j, lo:lo + STEP]) ** 2).sum(1)
            stays = part <= bound[i]
            i, j, part = i[stays], j[stays], part[stays]
        # pairs are in order of row, then centroid: the first one of a row's least sums is the smaller number
        starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        least = np.minimum.reduceat(part, starts)
        won = np.flatnonzero(part == least[i])
        won = won[np.r_[True, i[won][1:] != i[won][:-1]]]
        chosen[at:at + run], distance[at:at + run] = j[won], part[won] // x.shape[1]
    return chosen, distance


def quantised(embedding: Column) -> Column:
    """floor(1024 * x) of each component as long; null unless there are ``DIMENSIONS`` components, none null or non-finite."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform(embedding, lambda x: F.floor(F.lit(1024.0) * x.cast("double")))
    large = F.exists(embedding, lambda x: F.abs(F.lit(1024.0) * x.cast("double")) >= LARGEST - 1)
    kept = (F.size(embedding) == DIMENSIONS) & fine
    return F.when(kept & large, F.raise_error(F.lit(f"components from {LARGEST // 1024} on have no exact 64-bit distance"))) \
        .when(kept, whole)


def cluster(embeddings: DataFrame, *, k: int = 8, rounds: int = 10, seed: int = 3) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every kept row of (vec_id, embedding).

    Left out are rows whose vector is null, has another number of components than ``DIMENSIONS``, or holds null or non-finite ones. The
    first centroids are the kept vectors with the ``k`` smallest sha256 of ``<seed>:<vec_id>``, in that order; rows that share a vec_id
    are ordered by their components, and null ids come last. With fewer than ``k`` vectors there
    are fewer centroids. Repeated rows count and stay. An empty table gives no rows. Components of 2,048 and more are refused by
    an error, as their squared distances do not fit in 64 bits. Further columns of ``embeddings`` are not read.

    Vectors are transformed once and written; a round reads them, sums coefficients by centroid within each task and adds the tasks'
    sums up in Spark. Only ``k`` rows of sums reach the driver, however large the table is.
    """
    source = embeddings.select("vec_id", quantised(F.col("embedding")).alias("q")).filter(F.col("q").isNotNull())
    kind = dict(source.dtypes)["vec_id"]

    def coefficients(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = transformed(_matrix(batch.column(1))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(x, pa.int32())], names=["vec_id", "x"])

    vectors = materialise(source.mapInArrow(coefficients, f"vec_id {kind}, x array<int>"), "coefficients")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    started = source.orderBy(digest.asc_nulls_last(), "q").select("q").limit(k).collect()
    if not started:
        return vectors.select("vec_id", F.lit(0).alias("cluster"), *(F.lit(0).cast("long").alias(c) for c in (
            "distance", "cluster_inertia", "inertia")), F.lit("").alias("centroid_sha256"))
    now = np.array([r.q for r in started], np.int64)
    for _ in range(rounds):
        before, now = now, _moved(vectors, now)
        if np.array_equal(before, now):  # further rounds would give the same
            break
    names = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in now.tolist()]
    final = transformed(now)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen, distance = nearest(_matrix(batch.column(1)), final)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chosen, pa.int32()), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    told = materialise(vectors.mapInArrow(assigned, f"vec_id {kind}, cluster int, distance long"), "clusters")
    sums = {r.cluster: r.s for r in told.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    about = told.sparkSession.createDataFrame(
        [(c, s, sum(sums.values()), names[c]) for c, s in sorted(sums.items())],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return told.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floored means of the vectors nearest to each centroid; a centroid without any stays."""
    k, sent = len(centroids), transformed(centroids)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, DIMENSIONS), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x = _matrix(batch.column(0))
            chosen, _ = nearest(x, sent)
            order = np.argsort(chosen, kind="stable")
            present, starts = np.unique(chosen[order], return_index=True)
            if len(present):
                sums[present] += np.add.reduceat(x[order], starts, axis=0)
            counts += np.bincount(chosen, minlength=k)
        own = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(counts[own]), _lists(sums[own], pa.int64())], names=["cluster", "n", "s"])

    parts = vectors.select("x").mapInArrow(summed, "cluster int, n long, s array<long>")
    total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(DIMENSIONS)))
    moved = centroids.copy()
    for row in total.collect():
        whole = np.array([row[2:]], np.int64)
        moved[row.cluster] = restored(whole)[0] // row.n
    return moved


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), DIMENSIONS)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, rows.size + 1, DIMENSIONS, dtype=np.int32), pa.array(rows.ravel(), kind))
