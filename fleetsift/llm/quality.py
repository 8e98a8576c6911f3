"""Quality: random-indexing word vectors, pooled per document, under a two-layer network.

Each word has a fixed sparse random vector. A word's own vector is the sum of those of its neighbours, over every occurrence in every
document, so words used alike are alike. A document is the mean and the spread of its words' vectors; a small network learns
the label from that, and a temperature fitted on rows it did not learn from makes its probabilities honest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words and runs of other signs, in the case they are written.
_TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Tokens of a text that are in work at a time.
RUN = 200_000
_CACHED = 500_000
_WINDOW = 2


@dataclass(frozen=True)
class Words:
    """Vectors of unit length by hash bucket; the last row, for what stands between documents, is zero."""

    vectors: np.ndarray

    @property
    def buckets(self) -> int:
        return len(self.vectors) - 1


@dataclass(frozen=True)
class Network:
    """Standardised inputs, one hidden layer, one output, divided by ``temperature``. Without weights the score is ``bias`` alone."""

    mean: np.ndarray
    scale: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    bias: float
    temperature: float

    def margins(self, pooled: np.ndarray) -> np.ndarray:
        if not len(self.out):
            return np.full(len(pooled), self.bias)
        # row by row: a product of whole matrices rounds by the number of rows
        rows = (pooled - self.mean) / self.scale
        return np.array([np.maximum(row @ self.hidden + self.hidden_bias, 0) @ self.out for row in rows]).reshape(-1) + self.bias

    def probabilities(self, pooled: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(pooled) / self.temperature, -30, 30)))


def index_vectors(buckets: int, dims: int, ones: int, seed: int) -> np.ndarray:
    """Per bucket ``ones`` entries of 1 or -1 at random places; a last row of zeros."""
    rng = np.random.default_rng(seed)
    out = np.zeros((buckets + 1, dims), np.int16)
    for row in out[:-1]:
        row[rng.permutation(dims)[:ones]] = rng.choice((-1, 1), ones)
    return out


class Tokens:
    """Texts to buckets, with the words seen so far at hand."""

    def __init__(self, buckets: int):
        self.buckets, self.known = buckets, {}

    def runs(self, text: str | None) -> Iterator[np.ndarray]:
        """The buckets of the whole text's tokens in order, in runs of at most ``RUN``."""
        found: list[int] = []
        known = self.known
        for match in _TOKEN.finditer(text or ""):
            token = match.group()
            bucket = known.get(token)
            if bucket is None:
                if len(known) >= _CACHED:
                    known.clear()
                bucket = known[token] = crc32(token.encode("utf-8", "surrogatepass")) % self.buckets
            found.append(bucket)
            if len(found) == RUN:
                yield np.array(found, np.int64)
                found = []
        if found:
            yield np.array(found, np.int64)


def learned_words(docs: DataFrame, *, buckets: int = 8_192, dims: int = 32, ones: int = 4, seed: int = 12) -> Words:
    """Word vectors from all rows of ``docs``; no label and no column but ``text`` is read.

    A task adds up at most ``buckets`` rows of ``dims`` whole numbers, Spark adds up the tasks' rows, and ``buckets`` rows reach the driver.
    """
    index = index_vectors(buckets, dims, ones, seed)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(buckets)
        sums, counts, parts, held = np.zeros((buckets + 1, dims), np.int64), np.zeros(buckets + 1, np.int64), [], 0
        gap = np.full(_WINDOW, buckets)

        def add() -> None:
            ids = np.concatenate(parts)
            own, context = index[ids], np.zeros((len(ids), dims), np.int16)
            for step in range(1, _WINDOW + 1):
                context[step:] += own[:-step]
                context[:-step] += own[step:]
            counts[:] += np.bincount(ids, minlength=buckets + 1)
            for d in range(dims):
                sums[:, d] += np.bincount(ids, context[:, d], buckets + 1).astype(np.int64)

        for batch in batches:
            for text in batch.column(0):
                for run in tokens.runs(text.as_py()):
                    parts += [run, gap]
                    held += len(run)
                    if held >= RUN:
                        add()
                        parts, held = [], 0
        if parts:
            add()
        used = np.flatnonzero(counts[:-1])
        flat = pa.array(sums[used].ravel())
        lists = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, dims, dtype=np.int32), flat)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used]), lists], names=["bucket", "n", "s"])

    found = docs.select("text").mapInArrow(summed, "bucket int, n long, s array<long>")
    vectors, often = np.zeros((buckets + 1, dims)), np.zeros(buckets + 1)
    for row in found.groupBy("bucket").agg(F.sum("n").alias("n"), *(F.sum(F.col("s")[d]).alias(f"s{d}") for d in range(dims))).collect():
        often[row.bucket], vectors[row.bucket] = row.n, row[2:]
    vectors = _units(vectors)
    # what all words share, the neighbourhood of the most frequent ones, tells nothing apart
    vectors[:-1] -= often @ vectors / max(often.sum(), 1)
    vectors[often == 0] = 0
    return Words(_units(vectors).astype(np.float32))


def _units(rows: np.ndarray) -> np.ndarray:
    norm = np.sqrt((rows * rows).sum(1))
    return rows / np.where(norm > 0, norm, 1)[:, None]


def pooled_width(words: Words) -> int:
    return 2 * words.vectors.shape[1] + 3


def pooled(text: str | None, words: Words, tokens: Tokens) -> np.ndarray:
    """Mean and standard deviation of the vectors of all tokens of the whole text, the length of the mean, how alike neighbours are, and the log
    of the number of tokens."""
    n, total, squares, alike, last = 0, 0.0, 0.0, 0.0, None
    for run in tokens.runs(text):
        v = words.vectors[run].astype(np.float64)
        n += len(v)
        total = total + v.sum(0)
        squares = squares + (v * v).sum(0)
        alike += float((v[1:] * v[:-1]).sum()) + (float(last @ v[0]) if last is not None else 0.0)
        last = v[-1]
    if not n:
        return np.zeros(pooled_width(words))
    mean = total / n
    return np.concatenate([mean, np.sqrt(np.maximum(squares / n - mean * mean, 0)), [np.sqrt(mean @ mean), alike / max(n - 1, 1), np.log1p(n)]])


def held_out(doc_id: Column) -> Column:
    """Whether the row is kept from learning; a null doc_id is not held out, and as no label can name it, not learned from either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(doc_id, text, quality) of the rows of at most ``max_rows`` labelled documents that are not held out, chosen by the hash of doc_id.

    A document labelled more than once is good only if every label says so. The chosen keys are at most ``max_rows`` rows of two
    numbers, so they may be broadcast.
    """
    keys = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))) \
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
    keys = keys.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    return docs.select("doc_id", "text").join(F.broadcast(keys), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, words: Words, *, max_rows: int = 12_000, units: int = 32, epochs: int = 40, seed: int = 4) -> Network:
    """Learn from a bounded sample of labelled rows (``max_rows`` documents).

    What reaches the driver is one pooled vector per sampled document, made by the executors from its whole text; a doc_id on several
    rows counts once. A fifth of the sample is not learned from: it gives the temperature. Without both classes the score is one
    constant: the smoothed share of good rows, 0.5 without rows.
    """
    width = pooled_width(words)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(words.buckets)
        for batch in batches:
            x = np.array([pooled(t.as_py(), words, tokens) for t in batch.column(2)]).reshape(-1, width)
            lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, width, dtype=np.int32), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["doc_id", "quality", "x"])

    sample = labelled_sample(docs, labels, max_rows).select("doc_id", F.col("quality").cast("int").alias("quality"), "text")
    kind = dict(sample.dtypes)["doc_id"]
    rows = sample.mapInArrow(vectors, f"doc_id {kind}, quality int, x array<double>") \
        .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("x").alias("x")).collect()
    rows.sort(key=lambda r: (crc32(f"{seed}:{r.doc_id}".encode()), r.doc_id))
    y = np.array([float(r.quality > 0) for r in rows])
    none = np.zeros(0)
    if not 0 < y.sum() < len(y):
        share = (y.sum() + 0.5) / (len(y) + 1)
        return Network(none, none, none, none, none, float(np.log(share / (1 - share))), 1.0)
    x = np.array([r.x for r in rows])
    apart = len(y) // 5
    untuned = _train(x[apart:], y[apart:], units, epochs, seed)
    if not apart:
        return untuned
    right = np.where(y[:apart] > 0, 1, -1) * untuned.margins(x[:apart])
    temperature = min(np.geomspace(0.25, 8, 61), key=lambda t: float(np.logaddexp(0, -right / t).sum()))
    return replace(untuned, temperature=float(temperature))


def _train(x: np.ndarray, y: np.ndarray, units: int, epochs: int, seed: int, rate: float = 0.01, decay: float = 1e-4, batch: int = 64) -> Network:
    """Adam on the log loss."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    x = (x - mean) / scale
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    weights = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], units)), np.zeros(units), rng.normal(0, np.sqrt(1 / units), units),
               np.array(np.log(share / (1 - share)))]
    first, second = ([np.zeros_like(w) for w in weights] for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        pace = rate * (1 - epoch / epochs)
        for at in range(0, len(order), batch):
            rows = order[at:at + batch]
            a = x[rows] @ weights[0] + weights[1]
            h = np.maximum(a, 0)
            slope = (1 / (1 + np.exp(-np.clip(h @ weights[2] + weights[3], -30, 30))) - y[rows]) / len(rows)
            back = np.outer(slope, weights[2]) * (a > 0)
            grads = [x[rows].T @ back + decay * weights[0], back.sum(0), h.T @ slope + decay * weights[2], slope.sum()]
            step += 1
            for w, g, m, v in zip(weights, grads, first, second, strict=True):
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                w -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Network(mean, scale, weights[0], weights[1], weights[2], float(weights[3]), 1.0)


def score(text: Column, words: Words, network: Network) -> Column:
    """The probability that the whole text is good. A null text is scored like an empty one."""

    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = Tokens(words.buckets)
        for texts in batches:
            x = np.array([pooled(t.as_py(), words, tokens) for t in texts]).reshape(-1, pooled_width(words))
            yield pa.array(network.probabilities(x))

    return F.arrow_udf(scored, "double")(text)


def quality(docs: DataFrame, words: Words, network: Network) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``; repeated rows stay, null ids too. Other columns are not read."""
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), words, network).alias("score")) \
        .withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
