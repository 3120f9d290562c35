"""Benchmark decontamination (operator 3).

Rare word pairs seed the search. Of an item's pairs of words that stand next to each other, or with one word
between, those that the fewest documents hold are seeds: so many that any alignment of the wanted score must
hold some of them. Documents and items are joined on seeds; where enough seeds of an item stand close together, Smith-Waterman over words
tells edited and paraphrased copies from chance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._bitmap import bitmap_words, held_in
from ._skew import count_by, hot_keys, salted_join
from ._store import Scratch
from ._words import NOT_ALNUM, RUN, U64, Words, mix, slices, words_of

#: Seeds of an item that must stand close together in a document before the two are aligned; fewer where an alignment need not have so many.
SHARED = 4
#: Items that a text is aligned with in one row; further ones are in further rows.
ITEMS_AT_ONCE = 256
#: Texts that are found are broadcast up to this number, else joined.
BROADCAST_TEXTS = 500_000
#: Bits of the bitmap of seeds for each seed, and at most (64 MB): the fuller, the more pairs are moved that are no seed.
SPARE_BITS, MOST_BITS = 10, 29
MATCH, MISMATCH, GAP = 2, -1, 1


def _words(texts: pa.Array) -> Words:
    return words_of(pc.utf8_lower(texts), NOT_ALNUM)


def _pairs(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all pairs of words of a row that are next to each other or have one between, and each pair's first word."""
    out, at = [], []
    for gap in (1, 2):
        own = np.flatnonzero(w.row[gap:] == w.row[:-gap])
        with np.errstate(over="ignore"):
            out.append(mix(w.hash[own] * RUN[1] + w.hash[own + gap] * RUN[2]))
        at.append(own)
    return np.concatenate(out), np.concatenate(at)


def _whole(words: np.ndarray) -> int:
    """A hash of a sequence of words."""
    with np.errstate(over="ignore"):
        place = np.arange(len(words), dtype=U64) * U64(2) + RUN[3]
        return int(mix(np.add.reduce(mix(words + place * RUN[4]), keepdims=True))[0])


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def bounds(size: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """For items of so many words: the fewest seeds in an alignment that reaches ``least``, and the most words of a passage it spans.

    m matches and x other steps score 2 m - x >= T. Between matches that follow each other stands a
    cost of two or more x / 2 times at most; the others, m - 1 - x / 2 >= T / 2 - 1, are seeds. The
    passage has m + x <= 3 m - T words, and m is the item's size at most.
    """
    target = least * MATCH * size
    return np.maximum(1, np.ceil(target / 2 - 1 - 1e-9)).astype(np.int64), np.floor(3 * size - target + 1e-9).astype(np.int64)


def alignment(item: np.ndarray, passage: np.ndarray) -> tuple[float, int]:
    """Smith-Waterman score as a share of the item's score with itself, and the passage word at which the best alignment ends."""
    slope = GAP * np.arange(len(passage) + 1)
    row, best, end = np.zeros(len(passage) + 1), 0.0, 0
    for word in item:
        now = np.maximum(row - GAP, 0)
        now[1:] = np.maximum(now[1:], row[:-1] + np.where(passage == word, MATCH, MISMATCH))
        row = np.maximum.accumulate(now + slope) - slope
        if (top := row.max()) > best:
            best, end = float(top), int(row.argmax())
    return best / (MATCH * len(item)), end


def _items(benchmark: DataFrame, n: int, least: float) -> DataFrame:
    """(item_id, item_key, words, seeds, fewest, most): an item's words; its pairs, or the hash of all words of one with fewer than n, as seeds; and its bounds.

    ``item_key`` is equal for items of the same words. Items without words go.
    """

    def read(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                w = _words(part.column("text"))
                pairs, at = _pairs(w)
                order = np.argsort(at, kind="stable")
                pairs, row = pairs[order], w.row[at[order]]
                rows = []
                for i in np.flatnonzero(np.diff(w.first)).tolist():
                    own = w.hash[w.first[i] : w.first[i + 1]]
                    fewest, most = (int(x[0]) for x in bounds(np.array([len(own)]), least))
                    key = _whole(own)
                    short = len(own) < n
                    seeds = np.array([key], U64) if short else pairs[np.searchsorted(row, i) : np.searchsorted(row, i, "right")]
                    rows.append((i, np.array([key], U64), own, seeds, 1 if short else fewest, most))
                at = pa.array([r[0] for r in rows], pa.int64())
                lists = [pa.array([_signed(r[k]) for r in rows], pa.list_(pa.int64())) for k in (2, 3)]
                keys = pa.array([int(_signed(r[1])[0]) for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("item_id").take(at), keys, *lists, *[pa.array([r[k] for r in rows], pa.int64()) for k in (4, 5)]], ["item_id", "item_key", "words", "seeds", "fewest", "most"])

    return benchmark.select("item_id", "text").mapInArrow(read, "item_id long, item_key long, words array<long>, seeds array<long>, fewest long, most long")


def _seeds_of(w: Words, held: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(seed, word) of all pairs that may be in the bitmap, and of whole rows of fewer than n words."""
    pairs, at = _pairs(w)
    own = held_in(held, pairs) if len(pairs) else np.zeros(0, bool)
    short = np.flatnonzero((np.diff(w.first) > 0) & (np.diff(w.first) < n))
    whole = np.array([_whole(w.hash[w.first[i] : w.first[i + 1]]) for i in short.tolist()], U64)
    near = held_in(held, whole) if len(whole) else np.zeros(0, bool)
    return np.concatenate((pairs[own], whole[near])), np.concatenate((at[own], w.first[short[near]]))


def _documents_with(docs: DataFrame, held: np.ndarray, n: int) -> DataFrame:
    """(seed, docs): in how many documents each pair of the bitmap stands; summed in each task first."""
    shared = docs.sparkSession.sparkContext.broadcast(held)

    def count(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                w = _words(part.column("text"))
                seed, at = _seeds_of(w, shared.value, n)
                row = w.row[at]
                order = np.lexsort((row, seed))
                seed, row = seed[order], row[order]
                new = np.ones(len(seed), bool)
                new[1:] = (seed[1:] != seed[:-1]) | (row[1:] != row[:-1])
                keys, times = np.unique(seed[new], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(_signed(keys)), pa.array(times)], ["seed", "docs"])

    return docs.select("text").mapInArrow(count, "seed long, docs long").groupBy("seed").agg(F.sum("docs").alias("docs"))


def _places(docs: DataFrame, held: np.ndarray, n: int) -> DataFrame:
    """(text_key, seed, at): where in each text its seeds stand."""
    shared = docs.sparkSession.sparkContext.broadcast(held)

    def find(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                w = _words(part.column("text"))
                seed, at = _seeds_of(w, shared.value, n)
                row = w.row[at]
                yield pa.RecordBatch.from_arrays([part.column("text_key").take(pa.array(row)), pa.array(_signed(seed)), pa.array(at - w.first[row])], ["text_key", "seed", "at"])

    return docs.select("text_key", "text").mapInArrow(find, "text_key long, seed long, at long")


def passages(pairs: np.ndarray, at: np.ndarray, size: int, item: np.ndarray, fewest: int, most: int) -> list[tuple[int, int]]:
    """(begin, end) of all stretches of a text's ``size`` words that hold enough pairs of an item close together; those that overlap are one.

    ``pairs`` ascend, ``at`` is each one's first word; ``item`` holds the item's pairs.
    """
    item = np.unique(item)
    lo, hi = np.searchsorted(pairs, item), np.searchsorted(pairs, item, "right")
    word = np.unique(np.concatenate([at[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True) if a < b] or [at[:0]]))
    if len(word) < fewest:
        return []
    first, last = word[: len(word) - fewest + 1], word[fewest - 1 :]
    close = last - first <= most
    out: list[tuple[int, int]] = []
    for a, b in zip(np.maximum(last[close] + 1 - most, 0).tolist(), np.minimum(first[close] + most, size).tolist(), strict=True):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _best(w: np.ndarray, pairs: np.ndarray, at: np.ndarray, words: np.ndarray, fewest: int, most: int, n: int, least: float) -> tuple[float, int] | None:
    """The best score of an item in a text and the word where that alignment ends, the first of equal ones; None below ``least``."""
    if len(words) < n:
        return (1.0, len(w)) if len(w) == len(words) and (w == words).all() else None
    with np.errstate(over="ignore"):
        own = [mix(words[:-gap] * RUN[1] + words[gap:] * RUN[2]) for gap in (1, 2)]
    best = None
    for a, b in passages(pairs, at, len(w), np.concatenate(own), fewest, most):
        score, end = alignment(words, w[a:b])
        if score >= least and (best is None or score > best[0]):
            best = (score, a + end)
    return best


def _aligned(texts: DataFrame, n: int, least: float) -> DataFrame:
    """(text_key, item_key, score, end_word) of texts with the items they may hold."""

    def align(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                w = _words(part.column("text"))
                out = []
                for r, (key, items) in enumerate(zip(part.column("text_key").to_pylist(), part.column("items").to_pylist(), strict=True)):
                    own = Words(w.data, w.offsets, *(x[w.first[r] : w.first[r + 1]] for x in (w.start, w.end, w.row, w.hash)), w.first)
                    pairs, at = _pairs(own) if len(own.hash) else (own.hash, own.row)
                    order = np.argsort(pairs, kind="stable")
                    for item in items:
                        if hit := _best(own.hash, pairs[order], at[order], np.array(item["words"], np.int64).view(U64), item["fewest"], item["most"], n, least):
                            out.append((key, item["item_key"], *hit))
                columns = list(zip(*out, strict=True)) if out else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], ["text_key", "item_key", "score", "end_word"])

    return texts.select("text_key", "text", "items").mapInArrow(align, "text_key long, item_key long, score double, end_word long")


def _few(df: DataFrame, rows: int, most: int) -> DataFrame:
    return F.broadcast(df) if rows <= most else df


def _texts_found(docs: DataFrame, benchmark: DataFrame, n: int, least: float, store: Scratch) -> DataFrame | None:
    """(text_key, item_id, score, end_word), written, for every text and item of which it holds a copy; None where there are no items.

    ``docs`` has text and text_key.
    """
    items = store.keep(_items(benchmark, n, least), "items")
    each = store.keep(items.dropDuplicates(["item_key"]).select("item_key", "fewest", "most", F.size("seeds").alias("all"), F.explode("seeds").alias("seed")), "pairs")
    if each.isEmpty():
        return None

    def held(seeds: DataFrame) -> np.ndarray:
        # of counted size, MOST_BITS at most
        return bitmap_words(seeds, "seed", min(MOST_BITS, max(16, seeds.count().bit_length() + SPARE_BITS)))

    # the rarest of an item's pairs: were SHARED of them not in an alignment, it would have too few of all pairs
    frequency = _documents_with(docs, held(each), n)
    ranked = each.join(frequency, "seed", "left").withColumn("nth", F.row_number().over(Window.partitionBy("item_key").orderBy(F.coalesce("docs", F.lit(0)), "seed")))
    ranked = ranked.withColumn("shared", F.least("fewest", F.lit(SHARED)))
    rare = store.keep(ranked.where(F.col("nth") <= F.col("all") - F.col("fewest") + F.col("shared")).select("seed", "item_key", "most", "shared").distinct(), "rare")
    places = store.keep(_places(docs, held(rare), n).distinct(), "places")
    # a seed that many copies hold is dealt over tasks
    counts = count_by(places, "seed")
    joined = salted_join(places, rare, "seed", F.xxhash64("text_key", "at"), hot_keys(counts, "seed", places.count()))
    joined = joined.select("text_key", "item_key", "at", "most", "shared").distinct()
    w = Window.partitionBy("text_key", "item_key").orderBy("at")
    before = F.when(F.col("shared") == 1, F.col("at"))
    for k in range(2, SHARED + 1):
        before = before.when(F.col("shared") == k, F.lag("at", k - 1).over(w))
    near = joined.withColumn("before", before).where(F.col("at") - F.col("before") <= F.col("most")).select("text_key", "item_key").distinct()
    near = store.keep(near, "near")
    struct = items.dropDuplicates(["item_key"]).select("item_key", F.struct("item_key", "words", "fewest", "most").alias("item"))
    lot = F.floor((F.row_number().over(Window.partitionBy("text_key").orderBy("item_key")) - 1) / ITEMS_AT_ONCE)
    lists = near.withColumn("lot", lot).join(struct, "item_key").groupBy("text_key", "lot").agg(F.collect_list("item").alias("items"))
    keys = near.select("text_key").distinct()
    texts = docs.join(_few(keys, keys.count(), BROADCAST_TEXTS), "text_key", "left_semi").groupBy("text_key").agg(F.first("text").alias("text"))
    found = _aligned(texts.join(lists, "text_key"), n, least)
    out = store.keep(found.join(items.select("item_key", "item_id"), "item_key").select("text_key", "item_id", "score", "end_word"), "found")
    store.drop("pairs", "rare", "places", "near", "items")
    return out


def _with_key(docs: DataFrame, key: str) -> DataFrame:
    return docs.withColumn(key, F.xxhash64("text"))


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 4, least: float = 0.5) -> DataFrame:
    """Pairs of a document and a test item of which it holds an exact, edited or paraphrased copy.

    ``docs`` needs doc_id and text, ``benchmark`` item_id and text; other columns
    are ignored. Words are letters and digits in lower case. Returns doc_id,
    item_id, score (Smith-Waterman score of the best passage as a share of the
    item's own, ``least`` at least), end_word (document word where that alignment
    ends) and text_key (equal for equal texts); a pair once for each distinct text.

    An item of fewer than n words is found in documents that have just its words, in order: its score is 1. Null and empty texts and items without words match nothing. Repeated
    rows give their pairs once; null ids stay null. An empty table on either side
    gives an empty result. Very long texts are searched whole. Every pair that reaches ``least`` is found where
    ``least`` times an item's words is above 1: of S pairs of an item at least K are in such an alignment, so of its S - K + SHARED
    rarest at least SHARED are. Of items with equal id and text one counts; items of equal words are searched for once. The documents are read a fixed number of times however many items there are.
    """
    spark = docs.sparkSession
    docs = _with_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text_key")
    benchmark = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    found = _texts_found(docs, benchmark, n, least, Scratch(spark, "decontaminate"))
    if found is None:
        return spark.createDataFrame([], "doc_id long, item_id long, score double, end_word long, text_key long")
    keys = found.select("text_key").distinct()
    # copies of a text that many documents share are told apart by their ids before they are moved
    holders = docs.join(_few(keys, keys.count(), BROADCAST_TEXTS), "text_key", "left_semi").select("doc_id", "text_key").distinct()
    pairs = holders.join(_few(found, found.count(), BROADCAST_TEXTS), "text_key").distinct()
    return pairs.select("doc_id", "item_id", "score", "end_word", "text_key")


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 4, least: float = 0.5) -> DataFrame:
    """The documents that hold no copy of a test item, with all their columns; ``contaminated`` tells which do.

    Rows of one text stay or go together, whatever their ids; null and empty texts stay. Without documents or items nothing changes.
    """
    store = Scratch(docs.sparkSession, "decontaminate")
    benchmark = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    found = _texts_found(_with_key(docs.select("text"), "text_key"), benchmark, n, least, store)
    if found is None:
        return docs
    bad = store.keep(found.select(F.col("text_key").alias("__mr_text_key")).distinct(), "bad")
    keyed, rows = _with_key(docs, "__mr_text_key"), bad.count()
    if rows <= BROADCAST_TEXTS:
        return keyed.join(F.broadcast(bad), "__mr_text_key", "left_anti").drop("__mr_text_key")
    counts = store.keep(count_by(keyed, "__mr_text_key"), "counts")
    hot = hot_keys(counts, "__mr_text_key", counts.agg(F.sum("n")).first()[0] or 0)
    marked = salted_join(keyed, bad.withColumn("__mr_bad", F.lit(True)), "__mr_text_key", F.monotonically_increasing_id(), hot, "left")
    return marked.where("__mr_bad IS NULL").select(docs.columns)
