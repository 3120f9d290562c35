"""Approximate vector search by an index of inverted lists that is stored as tables.

Every vector lies in the list of its nearest centroid, as a code of what the centroid
leaves. A search joins each query with a few lists, picks candidates by their codes, and compares
those exactly. Centroids and code books are fitted on a bounded sample; all vectors are indexed.
"""

from __future__ import annotations

import json
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .retrieval import _exact, _matrix, _prepared, top_k

#: Vectors that centroids and code books are fitted on, those of least hash, at most.
SAMPLE = 65_536
#: Lists at most: their centroids are held on the driver and the executors.
MOST_LISTS = 16_384
#: Entries of a code book, one byte.
ENTRIES = 256
#: A list with more vectors, or more queries, than this is compared in several tasks.
CELL_ROWS, CELL_QUERIES = 8192, 512
_ROWS_AT_ONCE = 4096
#: Distances of a block of vectors to centroids or codes, and rows with a vector that are handed back, held at once.
_CELLS, _PAIRS = 1 << 20, 1 << 13
_FIT_ROUNDS = 12


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T), 0.0)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    rows = max(1, _CELLS // max(1, len(centroids)))
    for lo in range(0, len(x), rows):
        out[lo : lo + rows] = _squared(x[lo : lo + rows], centroids).argmin(axis=1)
    return out


def _averages(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k centroids of the rows, or as many as there are rows, by repeated averaging; one that nothing is nearest to stays."""
    start = np.random.Generator(np.random.PCG64(seed)).permutation(len(x))[:k]
    centroids = x[np.sort(start)].copy()
    for _ in range(_FIT_ROUNDS):
        which = _nearest(x, centroids)
        count = np.bincount(which, minlength=len(centroids))
        order = np.argsort(which, kind="stable")
        used = np.flatnonzero(count)
        centroids[used] = np.add.reduceat(x[order], (np.cumsum(count) - count)[used], axis=0) / count[used, None]
    return centroids


def _least(counts: list[tuple[int, int]], wanted: float) -> int | None:
    """The least place up to which ``wanted`` of the counts (place, n) lie, in order of places; None if fewer do."""
    seen = 0
    for place, n in counts:
        seen += n
        if seen >= wanted:
            return place
    return None


class Meta(NamedTuple):
    metric: str
    dim: int
    longest: float  # the greatest length of an indexed vector, for inner products
    cuts: list[int]  # where each part of a code begins, and the end

    def placed(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Vectors as the index compares them, by squared distance: of length one for cosine; for inner products with one more component, by
        which all indexed vectors are equally long."""
        if self.metric == "cosine":
            return _prepared(x, "cosine")
        if self.metric == "ip":
            rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.longest**2 - (x * x).sum(axis=1), 0.0))
            return np.column_stack([x, rest])
        return x


def _usable(vector: str, metric: str) -> Column:
    e = F.col(vector)
    sound = e.isNotNull() & (F.size(e) > 0) & ~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return sound & F.exists(e, lambda v: v != 0) if metric == "cosine" else sound


def _keyed(df: DataFrame, key: str, vector: str, metric: str) -> DataFrame:
    return df.where(F.col(key).isNotNull() & _usable(vector, metric)).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector"))


def build_index(corpus: DataFrame, path: str, metric: str = "cosine", key: str = "vec_id", vector: str = "embedding", lists: int | None = None, parts: int | None = None, sample: int = SAMPLE, seed: int = 0) -> None:
    """Index vectors under ``path``: entries (key, list, code), lists (list, centroid, rows), books (part, entry, vector) and meta.

    Centroids and code books are fitted on ``sample`` vectors at most; every usable vector has an entry. By default
    there are twice the square root of the vectors' number of ``lists``, MOST_LISTS at most, and a code byte for every four components. Null and empty vectors, those with null or
    non-finite components or without a key and, under cosine, zero ones are not indexed. Repeated rows have an entry each. All vectors have one length, else an error.
    ``metric`` is cosine, l2 or ip. An empty table gives an index in which nothing is found.
    """
    if metric not in ("cosine", "l2", "ip"):
        raise ValueError(f"unknown metric: {metric}")
    spark = corpus.sparkSession
    rows = _keyed(corpus, key, vector, metric)
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, v: s + v * v))
    size = rows.agg(F.count("*").alias("n"), F.min(F.size("vector")).alias("least"), F.max(F.size("vector")).alias("dim"), F.max(length).alias("longest")).first()
    if size["least"] != size["dim"]:
        raise ValueError("vectors of one index have one length")
    if lists is None:
        lists = round(2 * size["n"] ** 0.5)
    lists = max(1, min(lists, MOST_LISTS))
    picked = rows.orderBy(F.xxhash64("vector"), "key").limit(sample).select("vector").toArrow().combine_chunks()
    dim = (size["dim"] or 0) + (metric == "ip")
    count = max(1, min(parts or -(-dim // 4), dim or 1))
    meta = Meta(metric, size["dim"] or 0, size["longest"] or 0.0, [k * dim // count for k in range(count + 1)])
    x = meta.placed(_matrix(picked.column("vector").combine_chunks()), False) if picked.num_rows else np.zeros((0, dim))
    centroids = _averages(x, lists, seed)
    rest = x - centroids[_nearest(x, centroids)] if len(x) else x
    books = [_averages(rest[:, a:b], ENTRIES, seed) for a, b in zip(meta.cuts[:-1], meta.cuts[1:], strict=True)]
    shared = spark.sparkContext.broadcast((centroids, books))

    def enter(batches):
        centroids, books = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, _ROWS_AT_ONCE):
                part = batch.slice(lo, _ROWS_AT_ONCE)
                own = meta.placed(_matrix(part.column("vector")), False)
                which = _nearest(own, centroids)
                left = own - centroids[which]
                code = np.stack([_nearest(left[:, a:b], book) for (a, b), book in zip(zip(meta.cuts[:-1], meta.cuts[1:], strict=True), books, strict=True)], axis=1).astype(np.uint8)
                flat = pa.Array.from_buffers(pa.binary(code.shape[1]), len(code), [None, pa.py_buffer(code.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(which.astype(np.int32)), flat], ["key", "list", "code"])

    entries = rows.mapInArrow(enter, "key long, list int, code binary")
    # a range of lists lies in few files, so that a search of few lists skips the others
    entries.repartitionByRange("list", F.xxhash64("key")).sortWithinPartitions("list").write.mode("overwrite").parquet(f"{path}/entries")
    rows_of = {r["list"]: r["count"] for r in spark.read.parquet(f"{path}/entries").groupBy("list").count().collect()}
    spark.createDataFrame([(k, c.tolist(), rows_of.get(k, 0)) for k, c in enumerate(centroids)], "list int, centroid array<double>, rows long").coalesce(1).write.mode("overwrite").parquet(f"{path}/lists")
    spark.createDataFrame([(p, e, v.tolist()) for p, book in enumerate(books) for e, v in enumerate(book)], "part int, entry int, vector array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/books")
    spark.createDataFrame([(json.dumps(meta._asdict()),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


class VectorIndex:
    """A stored index. Centroids and books, MOST_LISTS and ENTRIES for each part at most, are held; entries are read by searches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.meta = Meta(**json.loads(spark.read.text(f"{path}/meta").first()["value"]))
        self.entries = spark.read.parquet(f"{path}/entries")
        lists = spark.read.parquet(f"{path}/lists").orderBy("list").toArrow().combine_chunks()
        wide = self.meta.cuts[-1]
        self.rows = lists.column("rows").to_numpy()
        self.centroids = _matrix(lists.column("centroid").combine_chunks()) if len(self.rows) else np.zeros((0, wide))
        books = spark.read.parquet(f"{path}/books").orderBy("part", "entry").collect()
        self.books = [np.array([r["vector"] for r in books if r["part"] == p], float) for p in range(len(self.meta.cuts) - 1)]

    def _queries(self, queries: DataFrame, key: str, vector: str) -> DataFrame:
        rows = _keyed(queries, key, vector, self.meta.metric)
        wrong = F.raise_error(F.lit("a query's length is not the index's")).cast("array<double>")
        return rows.select("key", F.when(F.size("vector") == self.meta.dim, F.col("vector")).otherwise(wrong).alias("vector"))

    def _probed(self, queries: DataFrame, probes: int) -> DataFrame:
        """(key, vector, list, nth): the ``probes`` lists whose centroids are nearest to each query, ties by number."""
        shared, meta = self.spark.sparkContext.broadcast((self.centroids, self.rows)), self.meta

        def probe(batches):
            centroids, rows = shared.value
            filled = np.flatnonzero(rows)
            for batch in batches:
                step = max(1, _CELLS // max(1, len(filled)))
                for lo in range(0, batch.num_rows, step):
                    part = batch.slice(lo, step)
                    near = np.argsort(_squared(meta.placed(_matrix(part.column("vector")), True), centroids[filled]), axis=1, kind="stable")[:, :probes]
                    row = np.repeat(np.arange(part.num_rows), near.shape[1])
                    nth = np.tile(np.arange(near.shape[1], dtype=np.int32), part.num_rows)
                    which = filled[near].ravel().astype(np.int32)
                    for a in range(0, len(row), _PAIRS):
                        own = pa.array(row[a : a + _PAIRS])
                        yield pa.RecordBatch.from_arrays([part.column("key").take(own), part.column("vector").take(own), pa.array(which[a : a + _PAIRS]), pa.array(nth[a : a + _PAIRS])], ["key", "vector", "list", "nth"])

        return queries.mapInArrow(probe, "key long, vector array<double>, list int, nth int")

    def probes_for(self, corpus: DataFrame, queries: DataFrame, recall: float = 0.98, k: int = 3, others_only: bool = False, key: str = "vec_id", vector: str = "embedding") -> int:
        """The least number of lists to probe that hold a share ``recall`` of the true neighbours of some queries, a few hundred say.

        Their neighbours come from an exact search, one pass over the corpus.
        """
        exact = top_k(queries, corpus.where(_usable(vector, self.meta.metric)), k, self.meta.metric, key, vector, others_only)
        where = self.entries.select(F.col("key").alias("neighbour_id"), "list")
        ranked = self._probed(self._queries(queries, key, vector), len(self.rows)).select(F.col("key").alias("query_id"), "list", "nth")
        nth = exact.join(where, "neighbour_id").join(ranked, ["query_id", "list"]).groupBy("query_id", "neighbour_id").agg(F.min("nth").alias("nth"))
        # a row for each list at most
        counts = sorted((place + 1, n) for place, n in nth.groupBy("nth").count().collect())
        return _least(counts, recall * sum(n for _, n in counts)) or max(1, len(self.rows))

    def refine_for(self, corpus: DataFrame, queries: DataFrame, probes: int, recall: float = 0.98, k: int = 3, others_only: bool = False, key: str = "vec_id", vector: str = "embedding") -> int:
        """The least number of candidates to compare exactly that hold a share ``recall`` of those true neighbours of some queries which lie in the probed lists.

        The denser the vectors lie, the more of them are as near by their codes as the true neighbours. One pass over the corpus for the exact search, and
        one over the codes for each eightfold number of candidates that is tried.
        """
        exact = top_k(queries, corpus.where(_usable(vector, self.meta.metric)), k, self.meta.metric, key, vector, others_only).select("query_id", F.col("neighbour_id").alias("key")).persist()
        asked, most, rows = self._queries(queries, key, vector), max(256, 8 * k), int(self.rows.sum())
        try:
            probed = self._probed(asked, probes).select(F.col("key").alias("query_id"), "list")
            wanted = exact.join(self.entries.select("key", "list").distinct(), "key").join(probed, ["query_id", "list"]).count() * recall
            while True:
                # a row for each place at most
                counts = sorted(map(tuple, self._ranked(asked, probes, most).join(exact, ["query_id", "key"]).groupBy("n").count().collect()))
                if (found := _least(counts, wanted)) or most >= rows:
                    return found or max(1, rows)
                most *= 8
        finally:
            exact.unpersist()

    def candidates(self, queries: DataFrame, probes: int, most: int) -> DataFrame:
        """(query_id, key): of each query the ``most`` vectors nearest by their codes in the probed lists. ``queries`` has key and vector."""
        return self._ranked(queries, probes, most).select("query_id", "key").distinct()

    def _ranked(self, queries: DataFrame, probes: int, most: int) -> DataFrame:
        """(query_id, key, far, n): the candidates, with their place n from 1."""
        probed = self._probed(queries, probes)
        # a row for each list, MOST_LISTS at most, comes to the driver and goes to the executors
        asked = [(int(k), -(-int(self.rows[k]) // CELL_ROWS), -(-int(n) // CELL_QUERIES)) for k, n in probed.groupBy("list").count().collect()]
        cells = F.broadcast(self.spark.createDataFrame(asked, "list int, across int, down int"))
        left = probed.join(cells, "list").select("list", "key", "vector", F.pmod(F.xxhash64("key"), F.col("down")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("j"))
        right = self.entries.join(cells, "list").select("list", "key", "code", F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("i"), F.pmod(F.xxhash64("key", "code"), F.col("across")).cast("int").alias("j"))
        shared, meta = self.spark.sparkContext.broadcast((self.centroids, self.books)), self.meta

        def compare(asked: pa.Table, held: pa.Table) -> pa.Table:
            if not asked.num_rows or not held.num_rows:
                return pa.table({"query_id": pa.array([], pa.int64()), "key": pa.array([], pa.int64()), "far": pa.array([], pa.float64())})
            centroids, books = shared.value
            asked, held = asked.combine_chunks(), held.combine_chunks()
            code = np.frombuffer(b"".join(held.column("code").to_pylist()), np.uint8).reshape(held.num_rows, -1)
            near = np.hstack([book[code[:, p]] for p, book in enumerate(books)]) + centroids[held.column("list")[0].as_py()]
            own = meta.placed(_matrix(asked.column("vector").combine_chunks()), True)
            take = min(most, len(near))
            found, step = [], max(1, _CELLS // len(near))
            for lo in range(0, len(own), step):
                far = _squared(own[lo : lo + step], near)
                best = np.argpartition(far, take - 1, axis=1)[:, :take]
                found.append((best, np.take_along_axis(far, best, axis=1)))
            best, far = (np.concatenate(x) for x in zip(*found, strict=True))
            return pa.table({"query_id": np.repeat(asked.column("key").to_numpy(), take), "key": held.column("key").to_numpy()[best.ravel()], "far": far.ravel()})

        found = left.groupBy("list", "i", "j").cogroup(right.groupBy("list", "i", "j")).applyInArrow(compare, "query_id long, key long, far double")
        w = Window.partitionBy("query_id").orderBy("far", "key")
        return found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)

    def search(self, queries: DataFrame, corpus: DataFrame, k: int = 3, probes: int = 8, refine: int | None = None, key: str = "vec_id", vector: str = "embedding", others_only: bool = False) -> DataFrame:
        """The k nearest vectors of each query among those found: query_id, neighbour_id, rank, distance (exact, as ``top_k`` gives it).

        ``corpus`` is what was indexed; it is read once, to compare the ``refine`` (32 or 8 k, the greater) candidates of each query exactly,
        however many queries there are. Queries that couldn't be indexed find nothing, like those of an empty index. Of neighbours equally far the least id
        comes first. Keys of queries are unique.
        """
        asked = self._queries(queries, key, vector)
        if not self.rows.any():
            return self.spark.createDataFrame([], "query_id long, neighbour_id long, rank int, distance double")
        pairs = self.candidates(asked, max(1, probes), (refine or max(32, 8 * k)) + others_only)
        if others_only:
            pairs = pairs.where("query_id <> key")
        both = pairs.join(_keyed(corpus, key, vector, self.meta.metric), "key").join(asked.select(F.col("key").alias("query_id"), F.col("vector").alias("query")), "query_id")
        metric = self.meta.metric

        def exact(batches):
            for batch in batches:
                if batch.num_rows:
                    q, c = (_prepared(_matrix(batch.column(n)), metric) for n in ("query", "vector"))
                    yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("key"), pa.array(_exact(q, c, metric))], ["query_id", "neighbour_id", "distance"])

        far = both.select("query_id", "key", "query", "vector").mapInArrow(exact, "query_id long, neighbour_id long, distance double")
        w = Window.partitionBy("query_id").orderBy("distance", "neighbour_id")
        return far.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "neighbour_id", "rank", "distance")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: queries, neighbours there are, neighbours found, recall. A neighbour as near as the last true one counts."""
    last = exact.groupBy("query_id").agg(F.max("distance").alias("last"), F.count("*").alias("there"))
    own = found.join(last, "query_id").where(F.col("distance") <= F.col("last") + 1e-9).groupBy("query_id").agg(F.count("*").alias("found"))
    both = last.join(own, "query_id", "left").select("query_id", "there", F.least("there", F.coalesce("found", F.lit(0))).alias("found"))
    return both.agg(F.count("*").alias("queries"), F.sum("there").alias("there"), F.sum("found").alias("found")).withColumn("recall", F.try_divide("found", "there"))
