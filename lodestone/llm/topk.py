"""Operator 2: exact top-k by inner product with Fagin's threshold algorithm.

Candidates are dealt into blocks of a bounded number of rows, queries likewise. A block has one sorted list per
dimension. For a query, the lists are read from the end that its component favours, further in each round; ids met are
scored in full; the sum of what the lists can still offer bounds every id not met. A query stops in a block when its
k-th score is above that bound (strictly, as an equal score may have a smaller id). Blocks' answers are ranked again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.plans.session import table

BLOCK_ROWS, QUERY_ROWS = 4096, 1024
FIRST_DEPTH = 8


def quantise(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and vec (array of floor(scale * x)) of every row. Null ids, null vectors and vectors with null or non-finite components
    take no part; rows that share an id each do."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False)))
    vec = F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("double"))
    return vectors.where(good).select(F.col("vec_id").cast("bigint").alias("vec_id"), vec.alias("vec"))


def search_block(ids: np.ndarray, block: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(place of the query, vec_id, score) of each query's k best rows of the block whose id is not its own."""
    order = np.lexsort((ids,))
    ids, block = ids[order], block[order]  # places now rank ids, for ties
    n, dims = block.shape
    small = np.abs(block).max(initial=0) * np.abs(queries).max(initial=0) * max(dims, 1) < 2**53
    block, queries = (block, queries) if small else (block.astype(object), queries.astype(object))
    lists = np.argsort(block, axis=0, kind="stable") if small else np.argsort(block.astype(float), axis=0, kind="stable")
    column = np.arange(dims)
    found: list[tuple[int, int, int]] = []
    for place, (qid, q) in enumerate(zip(query_ids.tolist(), queries)):
        seen = np.zeros(n, dtype=bool)
        seen[np.searchsorted(ids, qid) : np.searchsorted(ids, qid, side="right")] = True
        up = (q > 0).astype(bool)
        best = np.empty(0, dtype=np.int64)
        scores = np.empty(0, dtype=block.dtype)
        depth, end = 0, min(FIRST_DEPTH, n)
        while depth < n:
            high, low = lists[n - end : n - depth][:, up], lists[depth:end][:, (q < 0).astype(bool)]
            met = np.zeros(n, dtype=bool)
            met[high.ravel()] = True
            met[low.ravel()] = True
            new = np.flatnonzero(met & ~seen)
            seen[new] = True
            best, scores = np.concatenate([best, new]), np.concatenate([scores, block[new] @ q])
            top = np.lexsort((best, -scores if small else [-s for s in scores]))[:k]
            best, scores = best[top], scores[top]
            edge = block[np.where(up, lists[n - end], lists[end - 1]), column]
            depth, end = end, min(2 * end, n)
            if len(best) == k and scores[-1] > edge @ q:
                break
        if len(best) < k and not seen.all():  # a query without a nonzero component favours no list
            new = np.flatnonzero(~seen)
            best, scores = np.concatenate([best, new]), np.concatenate([scores, block[new] @ q])
            top = np.lexsort((best, -scores if small else [-s for s in scores]))[:k]
            best, scores = best[top], scores[top]
        found += [(place, int(ids[b]), int(s)) for b, s in zip(best, scores)]
    return found


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best rows of ``vectors`` (vec_id, vec), ties to the smaller id.

    A query meets rows of its own length whose id is not its own. Rows of ``queries`` that share an id ask each for itself, and give
    rows of ranks from 1 each. Fewer than k candidates give fewer rows, none give none.
    """
    queries = queries.withColumn("asked", F.monotonically_increasing_id())
    candidate_blocks = max(1, -(-vectors.count() // BLOCK_ROWS))
    query_blocks = max(1, -(-queries.count() // QUERY_ROWS))
    deal = lambda blocks: F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = vectors.select(F.size("vec").alias("dims"), deal(candidate_blocks).alias("c"), every(query_blocks).alias("q"), "vec_id", "vec")
    right = queries.select(F.size("vec").alias("dims"), every(candidate_blocks).alias("c"), deal(query_blocks).alias("q"), "asked", F.col("vec_id").alias("query_id"), F.col("vec").alias("query"))

    def search(block: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(block) and len(asked):
            stack = lambda x: np.stack(x.to_list()).astype(float).reshape(len(x), -1)
            found = search_block(block.vec_id.to_numpy(), stack(block.vec), asked.query_id.to_numpy(), stack(asked["query"]), k)
            rows = [(asked.asked.iloc[p], asked.query_id.iloc[p], v, s) for p, v, s in found]
        return pd.DataFrame(rows, columns=["asked", "query_id", "vec_id", "score"]).astype("int64")

    keys = ["dims", "c", "q"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "asked bigint, query_id bigint, vec_id bigint, score bigint")
    by_score = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantise(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


SQL = """
WITH e AS (SELECT row_number() OVER () AS asked, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = len(embedding)),
s AS (SELECT q.asked, q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(range(1, len(c.v) + 1), lambda i: c.v[i] * q.v[i])), 0) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY asked ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
