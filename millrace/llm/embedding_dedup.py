"""Near-duplicate embeddings by spherical-cap filters (operator 8).

Filter directions are a product code: the dimensions fall into two blocks, each
with its own random unit directions, and every pair of them is a filter. A vector
belongs to each filter whose direction it exceeds a threshold with; these are
listed by merging the two sorted lists of block products, without trying all
filters. Vectors that share a filter are compared exactly, in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._skew import hot_keys, salted_join
from ._store import Scratch

#: Vectors are held in filters of about this many on average.
FILTER_ROWS = 256
#: Filters that a vector is in on average to begin with, and at least; they are doubled up to so many until the wanted share of links is found.
FILTERS, FILTERS_LEAST, FILTERS_MOST = 32, 8, 512
#: Pairs just at the threshold on which that share is measured.
TRIALS = 400
#: Vectors on which the threshold is fitted, those of least hash.
SAMPLE = 4096
#: Larger filters are compared block by block.
BLOCK = 512
#: Oversize filters are broadcast when they are no more than this; else they are joined.
BROADCAST_FILTERS = 100_000


def directions(dim: int, codes: int, seed: int) -> list[np.ndarray]:
    """For each of the two blocks, its random unit directions in rows."""
    rng = np.random.Generator(np.random.PCG64([seed, dim]))
    out = []
    for size in (dim - dim // 2, dim // 2):
        x = rng.standard_normal((codes, size))
        out.append(x / np.linalg.norm(x, axis=1, keepdims=True) if size else np.zeros((1, 0)))
    return out


def _block_products(unit: np.ndarray, blocks: list[np.ndarray]) -> list[np.ndarray]:
    """Products with the directions of either block, each summed alike whatever other rows are there: a vector's filters are the same wherever they are listed."""
    cut = blocks[0].shape[1]
    return [np.einsum("ij,kj->ik", np.ascontiguousarray(x), b) for x, b in ((unit[:, :cut], blocks[0]), (unit[:, cut:], blocks[1]))]


def filters_of(unit: np.ndarray, blocks: list[np.ndarray], threshold: float) -> list[np.ndarray]:
    """The filters that each unit vector is in, ascending."""
    return [list_decode(x, y, threshold, FILTERS_LEAST) for x, y in zip(*_block_products(unit, blocks), strict=True)]


def list_decode(first: np.ndarray, second: np.ndarray, threshold: float, least: int) -> np.ndarray:
    """Filters (i * len(second) + j, ascending) with first[i] + second[j] >= threshold; the ``least`` best if those are fewer."""
    order = np.argsort(-second, kind="stable")
    falling = -second[order]
    rows = np.flatnonzero(first >= threshold + falling[0])
    counts = np.searchsorted(falling, first[rows] - threshold, "right")
    if counts.sum() < least:
        top = np.argsort(-first, kind="stable")[:least]
        best = first[top][:, None] + second[order[:least]][None, :]
        pick = np.argsort(-best, axis=None, kind="stable")[:least]
        return np.sort(top[pick // best.shape[1]] * len(second) + order[pick % best.shape[1]])
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.sort(np.repeat(rows, counts) * len(second) + order[at])


def fit_threshold(sample: np.ndarray, blocks: list[np.ndarray], filters: int) -> float:
    """The threshold that a sample of unit vectors exceeds with ``filters`` filters on average."""
    a, b = _block_products(sample, blocks)
    lo, hi = -2.0, 2.0
    a, b = np.sort(a, axis=1), np.sort(b, axis=1)
    for _ in range(30):
        mid = (lo + hi) / 2
        n = sum(int((b.shape[1] - np.searchsorted(y, mid - x)).sum()) for x, y in zip(a, b, strict=True))
        lo, hi = (mid, hi) if n > filters * len(sample) else (lo, mid)
    return hi


def share_found(unit: np.ndarray, blocks: list[np.ndarray], threshold: float, least: float, seed: int) -> float:
    """Of pairs of vectors whose cosine is ``least`` just so, the share that have a filter in common: vectors of the data, each with one made at that angle."""
    rng = np.random.Generator(np.random.PCG64([seed, 1]))
    x = unit[rng.integers(0, len(unit), TRIALS)]
    away = rng.standard_normal(x.shape)
    away -= (away * x).sum(axis=1, keepdims=True) * x
    size = np.linalg.norm(away, axis=1, keepdims=True)
    y = least * x + np.sqrt(1 - least * least) * away / np.where(size > 0, size, 1)
    return float(np.mean([len(np.intersect1d(a, b, assume_unique=True)) > 0 for a, b in zip(filters_of(x, blocks, threshold), filters_of(y, blocks, threshold), strict=True)]))


def fitted(sample: np.ndarray, count: int, least: float, recall: float, seed: int) -> tuple[list[np.ndarray], float, float]:
    """Directions and threshold for ``count`` vectors of which these are some: as many filters as find a share ``recall`` of links at the threshold; and that share."""
    filters = FILTERS
    while True:
        codes = max(2, int(np.ceil(np.sqrt(filters * count / FILTER_ROWS))))
        blocks = directions(sample.shape[1], codes, seed)
        threshold = fit_threshold(sample, blocks, filters)
        share = share_found(sample, blocks, threshold, least, seed)
        if share >= recall or filters >= FILTERS_MOST:
            return blocks, threshold, share
        filters *= 2


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _compare(keys: np.ndarray, copies: np.ndarray, unit: np.ndarray, lists, block: np.ndarray, own: int, apart: bool, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each vector that no smaller common filter counts, weighed by copies; and the least key of those it hangs together with.

    ``lists`` gives the filters of vectors; it is asked for those that have links only.
    """
    near = unit @ unit.T >= least
    np.fill_diagonal(near, False)
    if apart:
        near &= block[:, None] != block[None, :]
    root = keys.copy()
    who = np.flatnonzero(near.any(axis=1))
    if not len(who):
        return np.zeros(len(keys), np.int64), root
    while True:
        least_of = np.minimum(root[who], np.where(near[who], root, np.iinfo(np.int64).max).min(axis=1))
        if (least_of == root[who]).all():
            break
        root[who] = least_of
    smaller = [x[x < own] for x in lists(unit[who])]
    ids, column, seen = np.unique(np.concatenate(smaller), return_inverse=True, return_counts=True)
    several = seen > 1
    place = np.cumsum(several) - 1
    member = np.zeros((len(who), int(several.sum())), np.float32)
    rows = np.repeat(np.arange(len(who)), [len(s) for s in smaller])
    member[rows[several[column]], place[column[several[column]]]] = 1
    new = near[np.ix_(who, who)] & ~(member @ member.T > 0)
    links = np.zeros(len(keys), np.int64)
    links[who] = new @ copies[who]
    return links, root


def embedding_near_duplicates(vectors: DataFrame, least: float = 0.95, seed: int = 1, recall: float = 0.97) -> DataFrame:
    """Links between vectors of cosine ``least`` or more, and the components they make.

    ``vectors`` needs a long ``vec_id`` and an ``embedding`` array of floats or doubles;
    other columns are ignored. Returns a row per input row: vec_id, n_links (other
    rows linked directly), component_id (the smallest vec_id reachable by links),
    kept (vec_id = component_id).

    Null, empty and zero vectors and those with null or non-finite components link
    with nothing. Vectors of different length don't link. Equal vectors are compared
    once and each counts. Repeated rows are rows of their own; null ids link but name no
    component. An empty table gives an empty result. Links found are exact; a link
    is missed only if its vectors share no filter; the number of filters is chosen so that a share ``recall`` of
    pairs just at the threshold, made from SAMPLE of the vectors, share one (closer ones do so more often), FILTERS_MOST at most.
    """
    spark = vectors.sparkSession
    store = Scratch(spark, "embedding_dedup")
    kind = dict(vectors.dtypes)["embedding"]
    e = F.col("embedding")
    sound = e.isNotNull() & (F.size(e) > 0) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.coalesce(sound, F.lit(False)), e).alias("embedding"))
    rows = rows.withColumn("key", F.when(F.col("embedding").isNotNull(), F.xxhash64("embedding")))
    classes = rows.where("key IS NOT NULL").groupBy("key").agg(F.first("embedding").alias("embedding"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    classes = store.keep(classes.withColumn("dim", F.size("embedding")), "classes")

    parts = []
    for row in classes.groupBy("dim").count().orderBy("dim").collect():
        own = classes.where(F.col("dim") == row["dim"])
        sample = own.orderBy(F.xxhash64("key")).limit(SAMPLE).select("embedding").toArrow()
        blocks, threshold, _ = fitted(_unit(_matrix(sample.column("embedding").combine_chunks())), row["count"], least, recall, seed)
        parts.append(_links(own, blocks, threshold, kind, least, store, str(row["dim"])))
    edges = None
    for p in parts:
        edges = p if edges is None else edges.union(p)
    if edges is None:
        edges = spark.createDataFrame([], "key long, links long, root long")
    edges = store.keep(edges, "edges")
    store.release()

    links = edges.groupBy("key").agg(F.sum("links").alias("links"))
    found = components(edges.select(F.col("key").alias("u"), F.col("root").alias("v")), store, "cc")
    named = classes.select("key", "copies", "least").join(links, "key", "left").join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    # a component, or the copies of one vector, may be a large part of the rows: dealt over tasks; vectors that aren't compared are not joined
    named = store.keep(named, "named")
    roots = store.keep(named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"), F.sum("copies").alias("rows")), "roots")
    total = roots.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()
    named = salted_join(named, roots.select("root", "component_id"), "root", F.xxhash64("key"), hot_keys(roots, "root", total["n"]))
    named = named.select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    hot = hot_keys(classes.select("key", F.col("copies").alias("n")), "key", total["rows"])
    out = salted_join(rows.where("key IS NOT NULL").select("vec_id", "key"), named, "key", F.xxhash64("vec_id"), hot).select("vec_id", "n_links", "component_id")
    out = out.union(rows.where("key IS NULL").select("vec_id", F.lit(0), "vec_id"))
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _links(classes: DataFrame, blocks: list[np.ndarray], threshold: float, kind: str, least: float, store: Scratch, name: str) -> DataFrame:
    """(key, links, root) from each group of vectors that is compared."""
    shared = classes.sparkSession.sparkContext.broadcast(blocks)

    def decode(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                lists = filters_of(_unit(_matrix(part.column("embedding"))), shared.value, threshold)
                at = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("copies"), part.column("embedding"), pa.ListArray.from_arrays(at, pa.array(np.concatenate(lists)))], ["key", "copies", "embedding", "filters"])

    decoded = store.keep(classes.select("key", "copies", "embedding").mapInArrow(decode, f"key long, copies long, embedding {kind}, filters array<long>"), f"decoded{name}")
    sizes = decoded.select(F.explode("filters").alias("filter")).groupBy("filter").count().where("count > 1")
    sizes = store.keep(sizes, f"sizes{name}")
    large = sizes.where(F.col("count") > 2 * BLOCK).select("filter", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    if large.count() <= BROADCAST_FILTERS:
        large = F.broadcast(large)
    each = decoded.select("*", F.explode("filters").alias("filter")).join(large, "filter", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    each = each.withColumn("block", F.pmod(F.xxhash64("key", "filter"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    each = each.select("filter", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "key", "copies", "embedding")

    def compare(table: pa.Table) -> pa.Table:
        keys = table.column("key").to_numpy()
        if len(keys) < 2:
            return pa.Table.from_pydict({"key": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        lists = lambda unit: filters_of(unit, shared.value, threshold)
        links, root = _compare(keys, table.column("copies").to_numpy(), _unit(_matrix(table.column("embedding").combine_chunks())), lists, table.column("block").to_numpy(), table.column("filter")[0].as_py(), table.column("i")[0].as_py() != table.column("j")[0].as_py(), least)
        use = (links > 0) | (root != keys)
        return pa.Table.from_pydict({"key": pa.array(keys[use]), "links": pa.array(links[use]), "root": pa.array(root[use])})

    return each.groupBy("filter", "i", "j").applyInArrow(compare, "key long, links long, root long")
