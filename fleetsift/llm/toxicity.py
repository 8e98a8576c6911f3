"""Toxicity: a factorization machine over hashed terms.

``score = sigmoid(w0 + sum w_i + sum_{i<j} <v_i, v_j>)`` over the distinct hashed terms of a whole text. The pairwise part learns what
additive weights cannot, such as an insult that is harmful only beside the mention of a group.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TERM = re.compile(r"\w+")
_CACHED = 500_000
#: Lengths of the beginnings of words that are terms of their own.
BEGINNINGS = (4, 5, 6)


@dataclass(frozen=True)
class Machine:
    """A fitted machine. ``slots`` maps hash buckets to rows of ``linear`` and ``factors``; -1 marks buckets that were not selected."""

    bits: int
    bias: float
    slots: np.ndarray
    linear: np.ndarray
    factors: np.ndarray

    def probability(self, active: np.ndarray) -> float:
        """For the slots of a text's terms."""
        margin = self.bias
        if len(active):
            v = self.factors[active]
            total = v.sum(0)
            margin += self.linear[active].sum() + 0.5 * float(total @ total - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(margin, -30, 30))))


def bucket(term: str, bits: int) -> int:
    return xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass"), 17) >> (64 - bits)


def words(text: str | None) -> set[str]:
    """The distinct words of the whole text, in lower case."""
    return set(_TERM.findall(text.lower())) if text else set()


def buckets_of(word: str, bits: int) -> list[int]:
    """The hash buckets of a word and of its beginnings, which inflected and compound forms share."""
    forms = [word, *(f"{word[:n]}-" for n in BEGINNINGS if len(word) >= n)]
    return [bucket(form, bits) for form in forms]


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(doc_id, text, toxic) of the rows of at most ``max_rows`` labelled documents, chosen by the hash of doc_id.

    Documents whose crc32(doc_id as text) mod 5 is 0 are held out. A document labelled more than once is toxic if any label says so.
    The chosen keys are at most ``max_rows`` rows of two numbers, so they may be broadcast.
    """
    keys = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))) \
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    keys = keys.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    return docs.select("doc_id", "text").join(F.broadcast(keys), "doc_id")


def held_out(doc_id: Column) -> Column:
    """Whether the row is kept from learning; a null doc_id is not held out, and as no label can name it, not learned from either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, max_rows: int = 12_000, bits: int = 18, min_rows: int = 3, max_terms: int = 4_096, contrast: float = 5.0,
        rank: int = 4, epochs: int = 15, seed: int = 5) -> Machine:
    """Learn from a bounded sample of labelled rows.

    ``max_rows`` bounds the sample, ``2**bits`` the hash buckets of a text and ``max_terms`` the buckets with weights, all in at
    least ``min_rows`` sampled rows: first those whose share differs between the classes by more than ``contrast`` standard errors, then those
    of pairs that are toxic more or less often than their terms alone let expect (``_paired``, which counts pairs among ``max_terms`` of them). What reaches the driver
    is per sampled document the set of its text's buckets, found by the executors over the whole text; of a doc_id on several rows, the least set. Without both classes in the sample the
    score is one constant: the smoothed share of toxic rows, 0 with no row at all.
    """

    def buckets(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: np.array(sorted({b for w in words(x) for b in buckets_of(w, bits)}), dtype=np.int32).tobytes())

    sample = labelled_sample(docs, labels, max_rows)
    rows = sample.select("doc_id", "toxic", F.pandas_udf(buckets, "binary")("text").alias("b")) \
        .filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("b").alias("b")).toArrow()
    ids = [np.frombuffer(b.as_buffer(), np.int32) for b in rows.column("b")]  # views of the rows: no second copy
    names = rows.column("doc_id").to_pylist()
    order = sorted(range(len(names)), key=lambda i: (xxhash.xxh64_intdigest(str(names[i]), seed), names[i], ids[i].tobytes()))
    y = np.array([float(rows.column("toxic")[i].as_py() > 0) for i in order])
    empty = np.full(2**bits, -1, np.int32)
    if not 0 < y.sum() < len(y):
        share = 0.0 if not len(y) else (y.sum() + 0.5) / (len(y) + 1)
        bias = float(np.log(share / (1 - share))) if share else -np.inf
        return Machine(bits, bias, empty, np.zeros(0), np.zeros((0, rank)))
    ids = [ids[i] for i in order]
    slots = _select(ids, y, 2**bits, min_rows, max_terms, contrast)
    active = [a[a >= 0] for a in (slots[i] for i in ids)]
    del ids, rows
    bias, linear, factors = _train(active, y, int(slots.max()) + 1, rank, epochs, seed)
    return Machine(bits, bias, slots, linear, factors)


def _counted(ids: list[np.ndarray], n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for own in ids:  # the buckets of a row are distinct
        out[own] += 1
    return out


def _select(ids: list[np.ndarray], y: np.ndarray, n: int, min_rows: int, max_terms: int, least: float) -> np.ndarray:
    seen, hits = _counted(ids, n), _counted([i for i, t in zip(ids, y, strict=True) if t], n)
    pos, neg = y.sum(), len(y) - y.sum()
    pooled = seen / len(y)
    error = np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / pos + 1 / neg))
    z = (hits / pos - (seen - hits) / neg) / error
    z[(seen < min_rows) | (seen == len(y))] = 0
    best = np.argsort(-np.abs(z), kind="stable")[:max_terms]
    best = best[np.abs(z[best]) > least]
    best = np.sort(np.concatenate([best, _paired(ids, y, seen, hits, z, best, min_rows, max_terms)[:max_terms - len(best)]]))
    slots = np.full(n, -1, np.int32)
    slots[best] = np.arange(len(best))
    return slots


def _paired(ids: list[np.ndarray], y: np.ndarray, seen: np.ndarray, hits: np.ndarray, z: np.ndarray, chosen: np.ndarray, min_rows: int,
            most: int) -> np.ndarray:
    """Buckets beside ``chosen`` whose signal is a pair, the clearest first.

    All pairs of ``most`` buckets are counted: half of them the most frequent ones, the others those that toxic rows hold too often by the
    most standard errors, however rare. A pair is told from chance if the bound n * KL on the likelihood of its
    toxic rows, at the share that its terms let expect, is below one in the number of pairs tested. The rows of a term are kept as bits,
    toxic rows first, so a pair is counted by ANDing two runs of words.
    """
    able = (seen >= min_rows) & (seen < len(y))
    frequent = np.argsort(-seen * able, kind="stable")[:most // 2]
    telling = np.argsort(-z * able, kind="stable")
    telling = telling[~np.isin(telling, frequent)][:most - len(frequent)]
    some = np.concatenate([frequent, telling])
    some = some[able[some]]
    toxic_bits, clean_bits = (_rows_as_bits([i for i, t in zip(ids, y, strict=True) if t == label], some, len(seen)) for label in (1, 0))
    share, base, tiny = (hits[some] + 0.5) / (seen[some] + 1), y.mean(), 1e-3
    told, tested = np.zeros(len(some)), 0
    for a in range(len(some) - 1):
        later = slice(a + 1, len(some))
        toxic = np.bitwise_count(toxic_bits[a] & toxic_bits[later]).sum(1, dtype=np.int64)
        n = toxic + np.bitwise_count(clean_bits[a] & clean_bits[later]).sum(1, dtype=np.int64)
        met = np.flatnonzero(n >= min_rows)
        tested += len(met)
        n, toxic, other = n[met].astype(float), toxic[met], share[later][met]
        mine = np.full(len(met), share[a])
        s = toxic / n
        high = np.clip(np.maximum(np.maximum(mine, other), mine + other - base), tiny, 1 - tiny)
        low = np.clip(np.minimum(mine, other), tiny, 1 - tiny)
        wanted = np.where(s > high, high, np.where(s < low, low, np.clip(s, tiny, 1 - tiny)))
        c = np.clip(s, 1e-12, 1 - 1e-12)
        unlike = n * (c * np.log(c / wanted) + (1 - c) * np.log((1 - c) / (1 - wanted)))
        unlike[wanted == s] = 0
        told[a] = max(told[a], unlike.max(initial=0))
        told[a + 1 + met] = np.maximum(told[a + 1 + met], unlike)
    told[np.isin(some, chosen)] = 0
    best = np.argsort(-told, kind="stable")
    return some[best[told[best] > np.log(max(1, tested))]]


def _rows_as_bits(rows: list[np.ndarray], terms: np.ndarray, n: int, block: int = 512) -> np.ndarray:
    """For each term a bit per row that holds it, in words of 64."""
    at = np.full(n, -1, np.int32)
    at[terms] = np.arange(len(terms))
    out = np.zeros((len(terms), -(-len(rows) // block) * block // 8), np.uint8)
    for first in range(0, len(rows), block):
        held = np.zeros((len(terms), block), bool)
        for k, own in enumerate(rows[first:first + block]):
            own = at[own]
            held[own[own >= 0], k] = True
        out[:, first // 8:(first + block) // 8] = np.packbits(held, axis=1)
    return out.view(np.uint64)


def _train(active: list[np.ndarray], y: np.ndarray, n: int, rank: int, epochs: int, seed: int, rate: float = 0.15, decay: float = 2e-4,
           batch: int = 64) -> tuple[float, np.ndarray, np.ndarray]:
    """Adaptive gradient steps on the log loss; both classes weigh as they are."""
    rng = np.random.default_rng(seed)
    bias, linear, factors = float(np.log(y.mean() / (1 - y.mean()))), np.zeros(n), rng.normal(0, 0.05, (n, rank))
    g_bias, g_linear, g_factors = 1e-6, np.full(n, 1e-6), np.full((n, rank), 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            rows = order[at:at + batch]
            flat = np.concatenate([active[r] for r in rows])
            owner = np.repeat(np.arange(len(rows)), [len(active[r]) for r in rows])
            v = factors[flat]
            total = np.zeros((len(rows), rank))
            np.add.at(total, owner, v)
            squares = np.bincount(owner, (v * v).sum(1), len(rows))
            margin = bias + np.bincount(owner, linear[flat], len(rows)) + 0.5 * ((total * total).sum(1) - squares)
            slope = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[rows]
            touched, where = np.unique(flat, return_inverse=True)
            step = np.bincount(where, slope[owner], len(touched)) + decay * len(rows) * linear[touched]
            pair = slope[owner][:, None] * (total[owner] - v)
            step_v = np.zeros((len(touched), rank))
            np.add.at(step_v, where, pair)
            step_v += decay * len(rows) * factors[touched]
            g_linear[touched] += step * step
            g_factors[touched] += step_v * step_v
            linear[touched] -= rate * step / np.sqrt(g_linear[touched])
            factors[touched] -= 0.3 * rate * step_v / np.sqrt(g_factors[touched])
            g_bias += slope.sum() ** 2
            bias -= rate * slope.sum() / np.sqrt(g_bias)
    return bias, linear, factors


def score(text: Column, machine: Machine) -> Column:
    """The probability that the whole text is toxic; null and empty texts get the machine's base rate."""

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, tuple[int, ...]] = {}
        for texts in batches:
            if len(known) > _CACHED:
                known.clear()
            yield texts.map(lambda x: machine.probability(_active(x, machine, known))).astype("float64")

    return F.pandas_udf(scored, "double")(text)


def _active(text: str | None, machine: Machine, known: dict[str, tuple[int, ...]]) -> np.ndarray:
    found: set[int] = set()
    for word in words(text):
        own = known.get(word)
        if own is None:
            slots = machine.slots[buckets_of(word, machine.bits)]
            own = known[word] = tuple(slots[slots >= 0].tolist())
        if own:
            found.update(own)
    return np.fromiter(sorted(found), np.int64, len(found))


def toxicity(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``; repeated rows stay, null ids too."""
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), machine).alias("score")) \
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def clean(docs: DataFrame, machine: Machine) -> DataFrame:
    """The rows of ``docs``, with their columns, that the machine does not call toxic.

    Repeated rows and null ids stay or go by their text; null and empty texts get the base rate, so they stay unless most of the sample is toxic.
    """
    return docs.filter(score(F.col("text"), machine) < 0.5)
