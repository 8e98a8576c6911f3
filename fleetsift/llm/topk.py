"""Exact top-k by inner product with Fagin's threshold algorithm.

Candidates are dealt to shards. A shard sorts its candidates once per dimension. A query walks down the lists of its non-zero
dimensions in step, from the top where its weight is positive and from the bottom where it is negative, scores each candidate it meets in full, and
stops when the best score that an unseen candidate could have lies below its k-th best. The top k of all shards' top k is exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetsift.llm.common import materialise
from fleetsift.llm.vectors import matrix, usable

SCALE = 256


def quantised(embeddings: DataFrame) -> DataFrame:
    """(vec_id, q): the components x as floor(256 * x), x as double. Null ids and vectors that are null, empty or hold null or non-finite numbers go."""
    return usable(embeddings).filter(F.col("vec_id").isNotNull()).select(
        "vec_id", F.transform(F.col("embedding"), lambda x: F.floor(x.cast("double") * SCALE).cast("double")).alias("q"))


class Lists:
    """Candidates of a shard, sorted by id, with one sorted list per dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.order = np.ascontiguousarray(np.argsort(self.vectors, axis=0, kind="stable").T)
        self.values = np.take_along_axis(self.vectors, self.order.T, axis=0).T

    def best(self, query_id: int, query: np.ndarray, k: int, step: int = 32) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best candidates other than ``query_id``: higher scores first, then smaller ids. Scores are exact below 2**53."""
        n = len(self.ids)
        used = np.flatnonzero(query)
        weights, up = query[used], query[used] > 0
        rows = np.arange(len(used))
        ordered, values = self.order[used], self.values[used]
        seen = np.zeros(n, bool)
        kept, scores = np.zeros(0, int), np.zeros(0)
        depth = 0
        while depth < n and len(used):
            end = min(n, max(depth + step, depth * 3 // 2))
            heads = np.concatenate([ordered[up, n - end:n - depth].ravel(), ordered[~up, depth:end].ravel()])
            depth = end
            found = np.zeros(n, bool)
            found[heads] = True
            new = np.flatnonzero(found & ~seen)
            seen |= found
            kept, scores = self._merge(kept, scores, new, query, query_id, k)
            if len(kept) == k:
                at = np.where(up, n - depth, depth - 1)
                if float(weights @ values[rows, at]) < scores[-1]:
                    return self.ids[kept], scores
        return self._rest(kept, scores, np.flatnonzero(~seen), query, query_id, k)

    def _rest(self, kept, scores, left, query, query_id, k):
        kept, scores = self._merge(kept, scores, left, query, query_id, k)
        return self.ids[kept], scores

    def _merge(self, kept, scores, new, query, query_id, k):
        new = new[self.ids[new] != query_id]
        kept, scores = np.concatenate([kept, new]), np.concatenate([scores, self.vectors[new] @ query])
        best = np.lexsort((kept, -scores))[:k]
        return kept[best], scores[best]


def top_k(queries: DataFrame, candidates: DataFrame, *, k: int = 5, shard: int = 8_192, block: int = 1_024) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` candidates with the highest inner product for each of (vec_id, q).

    A candidate with the query's own id takes no part, however often that id occurs; equal scores go to the smaller vec_id; only
    vectors of the same length are compared. Fewer candidates than k: all of them. Every shard of about ``shard`` candidates meets
    every block of about ``block`` queries in a task of its own. Repeated rows of a query id: the smallest vector is the query.
    """
    candidates = materialise(candidates.withColumn("width", F.size("q")), "candidates")
    queries = materialise(queries.withColumn("width", F.size("q")).groupBy("vec_id").agg(F.min_by(F.struct("width", "q"), "q").alias("m"))
                          .select("vec_id", "m.width", "m.q"), "queries")
    shards, blocks = (max(1, -(-df.count() // size)) for df, size in ((candidates, shard), (queries, block)))

    def dealt(df, own, n_own, other, n_other):
        return df.withColumn(own, F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_own)).cast("int")) \
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))

    left = dealt(candidates, "s", shards, "b", blocks).groupBy("width", "s", "b")
    right = dealt(queries, "b", blocks, "s", shards).groupBy("width", "s", "b")

    def search(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(asked):
            lists = Lists(own.vec_id.to_numpy(), matrix(own.q))
            for query_id, query in zip(asked.vec_id, matrix(asked.q), strict=True):
                ids, scores = lists.best(query_id, query, k)
                out.append(pd.DataFrame({"query_id": query_id, "vec_id": ids, "score": scores.astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    found = left.cogroup(right).applyInPandas(search, "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
