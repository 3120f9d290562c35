"""Exact vector search."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries are sent to the executors in blocks of so many bytes of doubles; more take more passes over the corpus.
BLOCK_BYTES = 64 << 20
#: Products of a block of queries with so many corpus vectors are held at once.
ROWS_AT_ONCE = 4096
_QUERY_ROWS = 512
#: Products in blocks differ from exact distances by less than this.
_SLACK = 1e-9


def distance(a: Column | str, b: Column | str, metric: str = "cosine") -> Column:
    """cosine, l2 (squared) or ip distance, in double precision."""
    a, b = F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b
    total = lambda x, y, f: F.aggregate(F.zip_with(x, y, f), F.lit(0.0), lambda s, v: s + v)
    times = lambda x, y: x.cast("double") * y.cast("double")
    if metric == "l2":
        return total(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    if metric == "ip":
        return 1.0 - total(a, b, times)
    if metric == "cosine":
        return 1.0 - F.try_divide(total(a, b, times), F.sqrt(total(a, a, times)) * F.sqrt(total(b, b, times)))
    raise ValueError(f"unknown metric: {metric}")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _prepared(x: np.ndarray, metric: str) -> np.ndarray:
    if metric != "cosine":
        return x
    with np.errstate(invalid="ignore", divide="ignore"):
        return x / np.linalg.norm(x, axis=1, keepdims=True)


def _in_blocks(q: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    product = q @ c.T
    if metric != "l2":
        return 1.0 - product
    return np.maximum((q * q).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * product, 0.0)


def _exact(q: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    """Distances of rows of equal number, each summed alike, so that equal vectors are equally far."""
    return ((q - c) * (q - c)).sum(axis=1) if metric == "l2" else 1.0 - (q * c).sum(axis=1)


class _Best:
    """The best k corpus vectors so far of every query of a block."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, metric: str, others_only: bool):
        self.ids, self.q, self.k, self.metric, self.others_only = ids, q, k, metric, others_only
        self.distance, self.found = np.full((len(q), k), np.inf), np.full((len(q), k), np.iinfo(np.int64).max)

    def add(self, ids: np.ndarray, c: np.ndarray) -> None:
        for lo in range(0, len(self.q), _QUERY_ROWS):
            part = slice(lo, min(lo + _QUERY_ROWS, len(self.q)))
            d = _in_blocks(self.q[part], c, self.metric)
            slack = _SLACK * (1.0 + np.abs(d)) if self.metric == "l2" else _SLACK
            near = d - slack <= self.distance[part][:, -1:]
            if d.shape[1] > self.k:  # beyond the k best of this block nothing can stay
                near &= d - slack <= np.partition(np.where(np.isnan(d), np.inf, d), self.k, axis=1)[:, self.k : self.k + 1] + slack
            for row in np.flatnonzero(near.any(axis=1)):
                which = np.flatnonzero(near[row])
                if self.others_only:
                    which = which[ids[which] != self.ids[lo + row]]
                own = _exact(np.broadcast_to(self.q[lo + row], (len(which), self.q.shape[1])), c[which], self.metric)
                all_d, all_i = np.concatenate((self.distance[lo + row], own)), np.concatenate((self.found[lo + row], ids[which]))
                order = np.lexsort((all_i, all_d))[: self.k]
                self.distance[lo + row], self.found[lo + row] = all_d[order], all_i[order]

    def batch(self) -> pa.RecordBatch:
        row, at = np.nonzero(np.isfinite(self.distance))
        return pa.RecordBatch.from_arrays([pa.array(self.ids[row]), pa.array(self.found[row, at]), pa.array(self.distance[row, at])], ["query_id", "neighbour_id", "distance"])


def top_k(queries: DataFrame, corpus: DataFrame, k: int = 3, metric: str = "cosine", key: str = "vec_id", vector: str = "embedding", others_only: bool = False) -> DataFrame:
    """The k nearest corpus vectors of each query, ties by id: query_id, neighbour_id, rank, distance.

    Queries are a set of stated size. A block of them, BLOCK_BYTES at most, goes to every
    executor, where products of matrices pick what can be among the best of a task's rows; those are compared exactly. What is
    shuffled is k rows per query and task. All vectors have one length; null vectors, and zero ones under cosine, are near nothing.
    """
    if metric not in ("cosine", "l2", "ip"):
        raise ValueError(f"unknown metric: {metric}")
    queries = queries.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).alias("vector"))
    size = queries.agg(F.count("*"), F.max(F.size("vector"))).first()
    blocks = max(1, -(-size[0] * (size[1] or 0) * 8 // BLOCK_BYTES))
    rows = corpus.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).alias("vector"))
    parts = []
    for b in range(blocks):
        block = (queries.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b) if blocks > 1 else queries).toArrow().combine_chunks()
        if not block.num_rows:
            continue
        q = _prepared(_matrix(block.column("vector").combine_chunks()), metric)
        shared = corpus.sparkSession.sparkContext.broadcast((block.column("key").to_numpy(), q))

        def search(batches, shared=shared):
            best = _Best(*shared.value, k, metric, others_only)
            for batch in batches:
                for lo in range(0, batch.num_rows, ROWS_AT_ONCE):
                    part = batch.slice(lo, ROWS_AT_ONCE)
                    best.add(part.column("key").to_numpy(), _prepared(_matrix(part.column("vector")), metric))
            yield best.batch()

        parts.append(rows.mapInArrow(search, "query_id long, neighbour_id long, distance double"))
    if not parts:
        return corpus.sparkSession.createDataFrame([], "query_id long, neighbour_id long, rank int, distance double")
    w = Window.partitionBy("query_id").orderBy("distance", "neighbour_id")
    return reduce(DataFrame.union, parts).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "neighbour_id", "rank", "distance")
