"""Importance resampling towards a target distribution of hashed n-grams.

A 256-byte table lower-cases the ASCII letters of a text's UTF-8 bytes and blanks what separates words; ``bytes.split`` gives the words. The
crc32 of an n-gram is the crc32 of its last word seeded with that of the n-gram before it, so no n-gram is ever built. Counters of
buckets add up within a task, then across tasks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetsift.llm.common import materialise

#: Lower case for A-Z; a blank for all other bytes that are neither digits, lower-case letters nor part of a character beyond ASCII.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
#: Bytes of a text that are in work at a time; a longer run of one word is not cut.
RUN = 1 << 20


def hashes(text: bytes | None, longest: int, run: int = RUN) -> Iterator[list[int]]:
    """The crc32 of all n-grams of 1 to ``longest`` words of the whole text, in runs."""
    data = (text or b"").translate(TABLE)
    before: list[list[int]] = [[] for _ in range(longest)]  # by length, the hash of the n-gram that ends at the last word so far
    at = 0
    while at < len(data):
        end = data.find(b" ", at + run)
        end = len(data) if end < 0 else end
        words = data[at:end].split()
        at = end
        if not words:
            continue
        level = list(map(crc32, words))
        yield level
        joined = [b" " + w for w in words] if longest > 1 else []
        for n in range(1, longest):
            seeds = before[n - 1] + level[:-1]
            before[n - 1] = level[-1:]
            level = list(map(crc32, joined[len(joined) - len(seeds):], seeds))
            yield level


def counts(texts: DataFrame, *, longest: int, buckets: int) -> np.ndarray:
    """How many n-grams of all rows' ``text`` fall in each bucket. A null text has none."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[int] = Counter()
        for batch in batches:
            for text in batch.column(0):
                for part in hashes(text.as_py(), longest):
                    total.update([h % buckets for h in part])
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], names=["bucket", "n"])

    found = texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(counted, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for row in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains(docs: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket, a thousand times the log of how much more frequent it is in the target, smoothed by one, rounded down."""
    buckets = len(docs)
    all_docs, all_target = int(docs.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_docs + float(buckets)) / ((s + 1.0) * (all_target + float(buckets)))))
                     for s, t in zip(docs.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: Column, seed: int) -> Column:
    """A Gumbel number, a thousandfold and rounded down, from the sha256 of ``<seed>:<doc_id>``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, *, longest: int = 2, buckets: int = 10_000, percent: int = 25, least_words: int = 20,
             seed: int = 7) -> DataFrame:
    """doc_id, n_features, weight, score, rank for every row of ``docs``; the drawn ones have a rank, 1 being the highest score.

    ``target`` gives the wanted distribution by its column ``text``. A null or empty text has no features and weight 0; like all with
    fewer than ``least_words`` words it is never drawn. A null doc_id takes the noise of an empty id and comes after equal scores
    with an id. Repeated rows are documents of their own; those alike in all that is returned share their ranks out in any order.
    With an empty ``docs`` or ``target`` the smoothed counts stand alone. Further columns are not read.

    The counts of both sides reach the driver: ``buckets`` numbers each. Scores are whole numbers between fixed bounds, so their
    histogram is bounded too: it gives the score that the last drawn document has. Documents from that score on are dealt by ranges of
    (score, doc_id, row), so no tie and no repeated document meets in one task.
    """
    gain = gains(counts(docs, longest=longest, buckets=buckets), counts(target, longest=longest, buckets=buckets))
    kind = dict(docs.dtypes)["doc_id"]

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, words, weight = ([] for _ in range(3))
            for text in batch.column(1):
                found, total, own = 0, 0, 0
                for level, part in enumerate(hashes(text.as_py(), longest)):
                    found += len(part)
                    own += len(part) if level % longest == 0 else 0
                    total += int(gain[np.fromiter(part, np.int64, len(part)) % buckets].sum())
                n.append(found)
                words.append(own)
                weight.append(total // found if found else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, pa.int64()) for v in (n, words, weight))],
                                             names=["doc_id", "n_features", "n_words", "weight"])

    told = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        weighed, f"doc_id {kind}, n_features long, n_words long, weight long")
    told = materialise(told.withColumns({"score": F.col("weight") + noise(F.col("doc_id"), seed), "row": F.monotonically_increasing_id()}), "weights")
    histogram = sorted(told.filter(F.col("n_words") >= least_words).groupBy("score").count().collect(), reverse=True)
    drawn = percent * sum(r[1] for r in histogram) // 100
    seen, least = 0, None
    for score, n in histogram:
        if seen >= drawn:
            break
        seen, least = seen + n, score
    columns = ["doc_id", "n_features", "weight", "score"]
    if least is None:
        return told.select(*columns, F.lit(None).cast("long").alias("rank"))
    high = (F.col("n_words") >= least_words) & (F.col("score") >= least)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    ranges = int(told.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = told.filter(high).repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    # a row's id after the sort is the number of its range and its place there
    placed = materialise(sorted_.select(*columns, F.monotonically_increasing_id().alias("place")), "sorted")
    part, within = F.shiftright("place", 33), F.col("place").bitwiseAND(2**33 - 1)
    before, starts = 0, []
    for range_, n in sorted(placed.groupBy(part.alias("part")).count().collect()):
        starts.append((range_, before))
        before += n
    start = told.sparkSession.createDataFrame(starts, "part long, start long")
    rank = F.col("start") + within + 1
    ranked = placed.withColumn("part", part).join(F.broadcast(start), "part").select(*columns, F.when(rank <= drawn, rank).alias("rank"))
    return told.filter(~high).select(*columns, F.lit(None).cast("long").alias("rank")).union(ranked)
