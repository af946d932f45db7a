"""Exact top-k search by inner product with no-random-access aggregation.

Candidates and queries are dealt into blocks of bounded size; a task joins one block of each. There
every dimension is a list of the block's candidates, sorted once. A query reads the list of a
dimension from the top where its own component is positive and from the bottom where it is negative,
so that contributions to its score fall as it reads. All lists are read in step. What a list has not
shown of a candidate counts with the list's least contribution in the candidate's lower bound, and
with the contribution last read in its upper bound. Reading stops when so few candidates have an
upper bound that reaches the k-th best lower bound that they can be resolved to their final scores;
whoever is outside cannot qualify. The best k of each block meet in a ranking by query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugewise.llm._common import col

CANDIDATE_BLOCK, QUERY_BLOCK = 8192, 2048
#: Shares of the lists that are read before the bounds are looked at: the next is twice as deep.
FIRST_SHARE = 1 / 8


def quantized(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component as long; null if the vector or a component is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


class SortedLists:
    """The candidates of a block (rows of integers) as one sorted list per dimension."""

    def __init__(self, vectors: np.ndarray, largest_query: int):
        bound = float(np.abs(vectors).max(initial=0)) * float(largest_query) * vectors.shape[1]
        self.kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64  # sums are exact
        self.vectors = vectors.astype(self.kind)
        self.lists = np.sort(self.vectors, axis=0)

    def bounds(self, queries: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds (queries x candidates) after ``depth`` entries of every list; equal entries are read together."""
        up, down = np.maximum(queries, 0).astype(self.kind), np.minimum(queries, 0).astype(self.kind)
        top, bottom = self.lists[-depth], self.lists[depth - 1]  # the entries read last
        v = self.vectors
        upper = up @ np.maximum(v, top).T
        upper += down @ np.minimum(v, bottom).T
        if (top <= self.lists[0]).all() and (bottom >= self.lists[-1]).all():
            return upper, upper  # all is read
        lower = up @ np.where(v >= top, v, self.lists[0]).T
        lower += down @ np.where(v <= bottom, v, self.lists[-1]).T
        return lower, upper


def block_top_k(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, first_share: float = FIRST_SHARE) -> Iterator[tuple]:
    """(query id, ids, scores, depth read) of the k best of a block for each query; ties to smaller ids.

    Candidates of the query's own id do not count.
    """
    n = len(ids)
    lists = SortedLists(vectors, int(np.abs(queries).max(initial=0)))
    chunk = max(1, 2**21 // max(1, n))
    ordered = np.sort(ids)
    own = np.searchsorted(ordered, query_ids, "right") - np.searchsorted(ordered, query_ids, "left")
    for at in range(0, len(queries), chunk):
        alive, depth = np.arange(at, min(at + chunk, len(queries))), 0
        while len(alive):
            depth = min(n, max(1, math.ceil(n * first_share)) if not depth else 2 * depth)
            lower, upper = lists.bounds(queries[alive], depth)
            reads_on = np.zeros(len(alive), dtype=bool)
            for i, (query, low, high) in enumerate(zip(alive, lower, upper, strict=True)):
                most = k + own[query]  # candidates of the query's own id may be among the best
                kth = np.partition(low, n - most)[n - most] if most < n else low.min()
                able = np.flatnonzero(high >= kth)
                if depth < n and len(able) > max(8 * most, n // 32):
                    reads_on[i] = True  # too many can still qualify
                    continue
                able = able[ids[able] != query_ids[query]]
                scores = high[able] if low is high else vectors[able] @ queries[query]
                best = np.lexsort((ids[able], -scores))[:k]
                yield query_ids[query], ids[able][best], scores[best].astype(np.int64), depth
            alive = alive[reads_on]


def _cell(k: int):
    def run(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if candidates.empty or queries.empty:
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_id", "vec_id", "score")})
        width = max(candidates.vector.map(len).max(), queries.vector.map(len).max(), 1)

        def matrix(vectors: pd.Series) -> np.ndarray:
            out = np.zeros((len(vectors), width), dtype=np.int64)
            for i, x in enumerate(vectors):
                out[i, : len(x)] = x
            return out

        q, ids, scores = [], [], []
        for query, best, values, _ in block_top_k(queries.id.to_numpy(), matrix(queries.vector), candidates.id.to_numpy(), matrix(candidates.vector), k):
            q.append(np.full(len(best), query))
            ids.append(best)
            scores.append(values)
        return pd.DataFrame({"query_id": np.concatenate(q), "vec_id": np.concatenate(ids), "score": np.concatenate(scores)})

    return run


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: int = 64,
    candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """For each query row the k candidates of highest score: query_id, rank (from 1), vec_id, score.

    Candidates: all rows but those of the query's id. Ties go to the smaller id; fewer than k
    candidates give fewer rows. Rows with a null id, a null vector or a null or non-finite component
    take no part; an empty vector has score 0 with any. Components that a shorter vector lacks count
    as 0. Repeated rows are separate candidates; query rows of one id are one query, with the least of
    their vectors. Other columns play no part.
    """
    rows = vectors.select(col(key).cast("long").alias("id"), quantized(col(vector), scale).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    rows = rows.where(F.col("vector").isNotNull() & F.col("id").isNotNull())
    n, n_queries = rows.agg(F.count(F.lit(1)), F.count_if("is_query")).first()
    blocks, query_blocks = max(1, math.ceil(n / candidate_block)), max(1, math.ceil(n_queries / query_block))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    # a block takes by the hash of the whole row, so that rows of one id, too, are dealt over blocks
    candidates = rows.select("id", "vector", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int").alias("block"), every(query_blocks).alias("query_block"))
    queries = (
        rows.where("is_query").groupBy("id").agg(F.min("vector").alias("vector")).select("id", "vector", every(blocks).alias("block"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(query_blocks)).cast("int").alias("query_block"))
    )
    cells = ["block", "query_block"]
    found = candidates.groupBy(*cells).cogroup(queries.groupBy(*cells)).applyInPandas(_cell(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
