"""Cosine similarity: as an expression for pairs, and by blocks of matrix products for top-k search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors that one pass over the pool compares; more queries take more passes.
QUERY_BLOCK = 8192
#: Queries and pool rows whose scores a task holds at a time.
SCORED_QUERIES = 256
SCORED_ROWS = 4096


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(v: Column) -> Column:
    """The vector at length 1; null, empty and zero vectors are errors."""
    length = norm(v)
    checked = F.when((F.size(v) > 0) & (length > 0), length).otherwise(F.raise_error(F.lit("embedding must be a non-zero vector")).cast("double"))
    return F.transform(v, lambda x: x.cast("double") / checked)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Of two double vectors, rounded to 6 places; different sizes are an error."""
    same = F.when(F.size(a) == F.size(b), dot(a, b)).otherwise(F.raise_error(F.lit("embedding sizes differ")).cast("double"))
    return F.round(same / (norm(a) * norm(b)), 6)


def semantic_topk(queries: DataFrame, pool: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, pool_idx, score, rank): the ``k`` most similar pool rows of each query, ties by pool order.

    ``queries`` has query_id and embedding, ``pool`` pool_idx and embedding. Each pass sends one block of queries to all
    pool partitions; a partition keeps its own best ``k`` of each query, and a window merges these.
    """
    total = queries.count()
    passes = max(1, -(-total // block))
    kind = queries.schema["query_id"].dataType.simpleString()
    found = None
    for n in range(passes):
        part = queries if passes == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == n)
        rows = part.select("query_id", normalized(F.col("embedding")).alias("v")).collect()
        if not rows:
            continue
        keys, matrix = [r.query_id for r in rows], np.array([r.v for r in rows])
        shared = pool.sparkSession.sparkContext.broadcast((keys, matrix))
        one = pool.select("pool_idx", normalized(F.col("embedding")).alias("v")).mapInArrow(_local_best(shared, k), f"query_id {kind}, pool_idx long, score double")
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = pool.sparkSession.createDataFrame([], f"query_id {kind}, pool_idx long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "pool_idx")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _local_best(shared, k: int):
    """The best ``k`` of a partition for each query, by blocks: a task's scratch memory is bounded by a block's scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, q = shared.value
        blocks = [(start, _Best(q[start : start + SCORED_QUERIES], k)) for start in range(0, len(keys), SCORED_QUERIES)]
        for batch in batches:
            for start in range(0, batch.num_rows, SCORED_ROWS):
                part = batch.slice(start, SCORED_ROWS)
                flat = part.column(1).flatten().to_numpy()
                if len(flat) != part.num_rows * q.shape[1]:
                    raise ValueError("embedding sizes differ")
                rows, index = flat.reshape(-1, q.shape[1]).T, part.column(0).to_numpy()
                for _, best in blocks:
                    best.add(rows, index)
        for start, best in blocks:
            yield pa.RecordBatch.from_pydict({"query_id": [keys[start + i] for i in best.query], "pool_idx": best.index, "score": np.where(np.isinf(best.score), np.nan, best.score)})

    return run


class _Best:
    """The best ``k`` rows so far of a block of queries, as three columns sorted by query, score and row."""

    def __init__(self, q: np.ndarray, k: int):
        self.q, self.k = q, k
        self.query, self.index, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.least = np.full(len(q), -np.inf)

    def add(self, rows: np.ndarray, index: np.ndarray) -> None:
        score = self.q @ rows
        if np.isnan(rows).any() or np.isnan(self.q).any():
            score[np.isnan(score)] = np.inf  # the largest, as in the window that merges partitions
        # a row under the k-th best of those before, or of these rows, is not among the best; what is left is rounded
        floor = self.least
        if score.shape[1] > self.k and np.isinf(floor).any():
            floor = np.maximum(floor, np.partition(score, -self.k, axis=1)[:, -self.k])
        at, row = np.nonzero(score >= (floor - 2e-6)[:, None])
        if not len(at):
            return
        query, index, score = np.concatenate([self.query, at]), np.concatenate([self.index, index[row]]), np.concatenate([self.score, np.round(score[at, row], 6)])
        order = np.lexsort((index, -score, query))
        query = query[order]
        first = np.searchsorted(query, np.arange(len(self.q)))
        kept = order[np.arange(len(query)) - first[query] < self.k]
        self.query, self.index, self.score = np.concatenate([self.query, at])[kept], index[kept], score[kept]
        held = np.bincount(self.query, minlength=len(self.q))
        last = np.cumsum(held) - 1
        full = held == self.k
        self.least[full] = self.score[last[full]]
