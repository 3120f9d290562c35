"""Compression of vectors to codes by partial-distance search (operator 12).

Vectors of integers are cut into equal parts, each with a codebook of its own that a few rounds of
averaging fit. The nearest entry is looked for dimension by dimension, those in which
the entries vary most first; an entry leaves as soon as its distance so far exceeds
the least whole distance that is known.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._skew import hot_keys, salted_join
from ._store import Scratch

#: Vectors that are searched for together.
BLOCK = 2048
#: Entries whose distances are begun together; the least whole distance is renewed behind each lot.
LOT = 16
#: Integers are held to this range, so that squares and their sums stay whole: components beyond 2**20 count as 2**20.
LARGEST = 1 << 28


def cuts(dim: int, parts: int) -> list[int]:
    """Where each part begins, and the end: equal ones, or the first ones longer by one."""
    return [k * (dim // parts) + min(k, dim % parts) for k in range(parts + 1)]


def dimension_order(book: np.ndarray) -> np.ndarray:
    """Dimensions by falling variance over the entries, in whole numbers; of equal ones the first first."""
    x = book.astype(object)
    return np.array(sorted(range(book.shape[1]), key=lambda d: (sum(x[:, d]) ** 2 - len(x) * sum(x[:, d] ** 2), d)), np.int64)


def nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the entry of least squared distance, of equal ones the first, and that distance. ``book`` has an entry at least.

    The first whole distance is that of the entry nearest in the first dimension searched.
    """
    n = len(rows)
    order = dimension_order(book)
    if not len(order):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    lead = np.argsort(book[:, order[0]], kind="stable")
    sorted_lead, x = book[lead, order[0]], rows[:, order[0]]
    hi = np.minimum(np.searchsorted(sorted_lead, x), len(book) - 1)
    lo = np.maximum(hi - 1, 0)
    which = lead[np.where(np.abs(x - sorted_lead[lo]) <= np.abs(sorted_lead[hi] - x), lo, hi)]
    best = ((rows - book[which]) ** 2).sum(axis=1)
    for begin in range(0, len(book), LOT):
        lot = book[begin : begin + LOT]
        far = (x[:, None] - lot[None, :, order[0]]) ** 2
        row, entry = np.nonzero(far <= best[:, None])
        far = far[row, entry]
        for d in order[1:]:
            far = far + (rows[row, d] - lot[entry, d]) ** 2
            stays = far <= best[row]
            row, entry, far = row[stays], entry[stays], far[stays]
        # rows ascend, and entries in each: of a row's least distances the first entry counts
        by = np.lexsort((entry, far, row))
        first = by[np.concatenate(([True], row[by][1:] != row[by][:-1]))] if len(by) else by
        row, entry, far = row[first], entry[first] + begin, far[first]
        better = (far < best[row]) | ((far == best[row]) & (entry < which[row]))
        which[row[better]], best[row[better]] = entry[better], far[better]
    return which, best


def assign(rows: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each row the entry of each part, and the squared distances summed over the parts."""
    at = np.concatenate(([0], np.cumsum([b.shape[1] for b in books])))
    code, error = np.zeros((len(rows), len(books)), np.int64), np.zeros(len(rows), np.int64)
    for k, book in enumerate(books):
        code[:, k], far = nearest(rows[:, at[k] : at[k + 1]], book)
        error += far
    return code, error


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(flat * 256), -LARGEST, LARGEST).astype(np.int64).reshape(len(column), dim)


def _blocks(batches, dim: int):
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK):
            part = batch.slice(lo, BLOCK)
            yield part, _matrix(part.column("embedding"), dim)


def _renewed(own: DataFrame, books: list[np.ndarray], dim: int) -> list[np.ndarray]:
    """Codebooks whose entries are the floored averages of the parts nearest to them; an entry that none is nearest to stays.

    Every task sums for itself; one row for each entry comes to the driver.
    """
    shared = own.sparkSession.sparkContext.broadcast(books)

    def sums(batches):
        books = shared.value
        total = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]
        for _, rows in _blocks(batches, dim):
            code, _ = assign(rows, books)
            at = 0
            for k, b in enumerate(books):
                part = np.hstack([np.ones((len(rows), 1), np.int64), rows[:, at : at + b.shape[1]]])
                np.add.at(total[k], code[:, k], part)
                at += b.shape[1]
        flat = [(k, e, d, int(t[e, d])) for k, t in enumerate(total) for e in np.flatnonzero(t[:, 0]).tolist() for d in range(t.shape[1])]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in flat], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["part", "entry", "place", "total"])

    added = own.select("embedding").mapInArrow(sums, "part int, entry int, place int, total long")
    out = [b.copy() for b in books]
    count: dict[tuple[int, int], int] = {}
    # place 0 holds the counts; sums of more than 2**35 extreme components need more than 64 bits
    for part, entry, place, total in sorted(map(tuple, added.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)"))).collect())):
        if place == 0:
            count[part, entry] = int(total)
        else:
            out[part][entry, place - 1] = int(total) // count[part, entry]
    return out


def books_sha256(books: list[np.ndarray]) -> str:
    """Of all entries' integers in decimal, by part, entry and place, with commas between."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def fit_codebooks(vectors: DataFrame, dim: int, parts: int = 16, entries: int = 64, rounds: int = 2) -> list[np.ndarray]:
    """Codebooks of vectors (vec_id, embedding) of ``dim`` components: they begin as the parts of the ``entries`` smallest ids' vectors.

    Null ids count as the largest. Of vectors of one id, the one of smallest components is taken.
    """
    by_id = vectors.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    first = by_id.orderBy(F.col("vec_id").asc_nulls_last()).limit(entries).toArrow().to_pylist()
    first.sort(key=lambda r: (r["vec_id"] is None, r["vec_id"] or 0))
    rows = _matrix(pa.array([r["embedding"] for r in first], pa.list_(pa.float64())), dim)
    at = cuts(dim, parts)
    books = [rows[:, a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    for _ in range(rounds):
        books = _renewed(vectors, books, dim)
    return books


def _coded(own: DataFrame, books: list[np.ndarray], dim: int) -> DataFrame:
    shared, sha = own.sparkSession.sparkContext.broadcast(books), books_sha256(books)

    def code(batches):
        for part, rows in _blocks(batches, dim):
            codes, error = assign(rows, shared.value)
            pairs = np.array([f"{e:02x}" for e in range(max(len(b) for b in shared.value))])
            text = ["".join(r) for r in pairs[codes].tolist()]
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), pa.array(text, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    kind = dict(own.dtypes)["label"]
    return own.select("vec_id", "label", "embedding").mapInArrow(code, f"vec_id long, label {kind}, code string, error long").withColumn("codebooks_sha256", F.lit(sha))


def compress_vectors(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """Codes of vectors: the nearest entry of each part's codebook, fitted on all of them.

    ``vectors`` needs a long ``vec_id``, an ``embedding`` array of floats or doubles and a ``label``; other
    columns are ignored. Components are multiplied by 256 and rounded down. Returns a row for each vector that is
    not null and has no null or non-finite component: vec_id, label, code (two hex digits for each part, in order; ``entries`` is 256 at
    most), error (squared distances summed over the parts), label_error (error summed over the vectors of an equal label, nulls
    together), codebooks_sha256.

    Vectors of different length have codebooks of their own; where the length is no multiple of ``parts``, the first
    parts are longer by one. Repeated rows are rows of their own, and each counts in averages and sums; the first entries are of different
    ids, null ids last. Of equally near entries the first is taken, so entries may be equal. Components beyond 2**20
    count as 2**20. An empty table, or one without a usable vector, gives no rows.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be 1 to 256, for two hex digits")
    store = Scratch(vectors.sparkSession, "vector_codes")
    e = F.col("embedding")
    sound = e.isNotNull() & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label").where(sound)
    out = None
    # one codebook for each length; lengths are few
    for (dim,) in sorted(map(tuple, rows.select(F.size("embedding")).distinct().collect())):
        own = rows.where(F.size("embedding") == dim)
        part = _coded(own, fit_codebooks(own, dim, parts, entries, rounds), dim)
        out = part if out is None else out.union(part)
    if out is None:
        return rows.selectExpr("vec_id", "label", "'' AS code", "0L AS error", "0L AS label_error", "'' AS codebooks_sha256").limit(0)
    # a label may hold a large part of the rows: summed before the shuffle, dealt over tasks in the join
    out = store.keep(out.withColumn("__mr_label", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))), "coded")
    sums = store.keep(out.groupBy("__mr_label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "sums")
    hot = hot_keys(sums, "__mr_label", sums.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    joined = salted_join(out, sums.drop("n"), "__mr_label", F.xxhash64("vec_id", "code"), hot)
    return joined.select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256")
