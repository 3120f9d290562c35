"""Substring deduplication over sliding sentence spans (operator 1).

Every run of consecutive sentences is hashed; runs that occur in several
documents, or again in one document, meet in a global aggregate; sentences that a
run other than the first covers are removed.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bitmap import bitmap, in_bitmap
from ._skew import hot_keys, salted_join
from ._store import Scratch
from ._words import ASCII_SPACE, LOWER_AZ, RUN, U64, Words, mix, slices, words_of

#: A sentence longer than this counts as several, cut after so many words or where its words say.
SENTENCE_WORDS, MOST_SENTENCE_WORDS = 12, 22
#: Where words say: at the least hash of two words in any so many places.
CUT_WINDOW = 6
#: A run with part of a sentence has so many words at least.
PART_WORDS = 25
#: A list of repeated runs is broadcast up to so many, some 40 bytes each; else it is joined.
BROADCAST_RUNS = 1 << 20
_STOPS = np.zeros(256, bool)
_STOPS[[ord(c) for c in ".!?"]] = True
#: Places of documents without an id begin here: after all ids that are less.
NO_ID = 1 << 62
#: Repeated runs are told apart from most others by a bitmap of 2**BITMAP_BITS bits.
BITMAP_BITS = 26


class Sentences(NamedTuple):
    """Sentences of a slice of rows, in order."""

    start: np.ndarray  # byte at which each begins
    stop: np.ndarray  # byte at which the next one, or the row, ends
    words: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # of each row, its first sentence; and the number of sentences
    opens: np.ndarray  # False for what goes on with the sentence before, by content


def _content_cuts(w: Words, begin: np.ndarray, sentence_words: int) -> np.ndarray:
    """Words inside long sentences at which a new part begins, decided by the words around: equal passages have equal cuts but for some words at their ends."""
    n, size = len(w.hash), np.diff(np.append(begin, len(w.hash)))
    end = np.repeat(np.where(size > sentence_words, begin + size, 0), size)
    inner = np.ones(n, bool)
    inner[begin] = False
    at = np.flatnonzero(inner & (np.arange(n) + CUT_WINDOW <= end))
    if not len(at):
        return at
    with np.errstate(over="ignore"):
        two = mix(w.hash * RUN[24] + np.append(w.hash[:1], w.hash[:-1]) * RUN[25])
    best, place = two[at], at.copy()
    for j in range(1, CUT_WINDOW):
        other = two[at + j]
        less = other <= best
        best[less], place[less] = other[less], at[less] + j
    return _ascending(place)


def _ascending(x: np.ndarray) -> np.ndarray:
    """The different numbers, ascending; by sorting."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def sentences_of(w: Words, by_content: bool = False, sentence_words: int = SENTENCE_WORDS) -> Sentences:
    """Sentences end at a line break, or at a word ending in a full stop, '!' or '?'."""
    n = len(w.hash)
    if not n:
        none = np.zeros(0, np.int64)
        return Sentences(none, none, none, np.zeros(0, U64), np.zeros(len(w.offsets), np.int64), np.zeros(0, bool))
    lines = np.cumsum(w.data == 10)
    last = _STOPS[w.data[w.end - 1]]
    last[:-1] |= (lines[w.start[1:]] > lines[w.end[:-1] - 1]) | (w.row[1:] != w.row[:-1])
    begin = np.concatenate(([0], np.flatnonzero(last[:-1]) + 1))
    opens = np.ones(n, bool)
    if by_content:
        cuts = _content_cuts(w, begin, sentence_words)
        opens[cuts] = False
        begin = _ascending(np.concatenate((begin, cuts)))
    place = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))
    begin = np.flatnonzero(place % sentence_words == 0)
    with np.errstate(over="ignore"):
        h = mix(np.add.reduceat(w.hash * RUN[1 + place % sentence_words], begin))
    row = w.row[begin]
    stop = np.append(w.start[begin[1:]], len(w.data))
    stop = np.minimum(stop, w.offsets[row + 1])
    return Sentences(w.start[begin], stop, np.diff(np.append(begin, n)), h, np.searchsorted(row, np.arange(len(w.offsets))), opens[begin])


def runs_of(s: Sentences, row: int, length: int, part_words: int = PART_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row's runs: hashes, and the parts at which each begins and ends.

    Runs of so many sentences; and from every part runs of so many parts and ``part_words`` words, if
    a sentence cut by content is among them.
    """
    lo, n = s.first[row], s.first[row + 1] - s.first[row]
    h, opens = s.hash[lo : lo + n], s.opens[lo : lo + n]
    bound = np.append(np.flatnonzero(opens), n)
    m = max(0, len(bound) - length)
    out = np.zeros(m, U64)
    with np.errstate(over="ignore"):
        if len(bound) - 1 < n:
            k = np.arange(n) - np.repeat(bound[:-1], np.diff(bound))
            whole = mix(np.add.reduceat(h * RUN[64 + k % 4000], bound[:-1]))
        else:
            whole = mix(h * RUN[64])
        for j in range(length):
            out += whole[j : j + m] * RUN[32 + j]
        out, start, stop = mix(out), bound[:m], bound[length : length + m]
        if len(bound) - 1 == n:
            return out, start, stop
        words = np.append(0, np.cumsum(s.words[lo : lo + n]))
        end = np.maximum(np.searchsorted(words, words[:-1] + part_words), np.arange(n) + length)
        cut = ~opens
        cut[:-1] |= cut[1:]  # the part that opens a cut sentence too
        cuts = np.append(0, np.cumsum(cut))
        at = np.flatnonzero((end <= n) & (cuts[np.minimum(end, n)] > cuts[:-1]))
        size, more = end[at] - at, np.zeros(len(at), U64)
        for j in range(int(size.max()) if len(at) else 0):
            use = np.flatnonzero(size > j)
            more[use] += h[at[use] + j] * RUN[128 + j]
    return np.concatenate((out, mix(more + RUN[63]))), np.concatenate((start, at)), np.concatenate((stop, end[at]))


def _clean(text: bytes, at: int, s: Sentences, row: int, length: int, repeated: np.ndarray, least_words: int, part_words: int = PART_WORDS) -> tuple[bytes, list[bytes], int, np.ndarray]:
    """The text without covered sentences, what went, how many sentences went, and the runs that made them go."""
    runs, start, stop = runs_of(s, row, length, part_words)
    lo, n = s.first[row], s.first[row + 1] - s.first[row]
    again = np.ones(len(runs), bool)
    again[np.unique(runs, return_index=True)[1]] = False
    hit = np.isin(runs, repeated) | again
    if not hit.any():
        return text, [], 0, runs[:0]
    depth = np.bincount(start[hit], minlength=n + 1) - np.bincount(stop[hit], minlength=n + 1)
    covered = np.cumsum(depth)[:n] > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([0], covered.view(np.int8), [0]))))
    kept, gone, count, pos = [], [], 0, 0
    by = np.zeros(len(runs), bool)
    for a, b in edge.reshape(-1, 2):
        if s.words[lo + a : lo + b].sum() < least_words:
            continue
        x, y = s.start[lo + a] - at, s.stop[lo + b - 1] - at
        kept.append(text[pos:x])
        gone.append(text[x:y])
        count, pos = count + int(b - a), y
        by |= hit & (start >= a) & (start < b)
    return b"".join([*kept, text[pos:]]), gone, count, runs[by]


def substring_dedup(docs: DataFrame, run: int = 3, least_words: int = 0, by_content: bool = True, sentence_words: int = SENTENCE_WORDS, part_words: int = PART_WORDS) -> DataFrame:
    """Remove sentences that a repeated run of sentences covers, other than where it first occurs.

    ``docs`` needs a long ``doc_id`` and a string ``text``; other columns are ignored and not returned. A run is ``run``
    consecutive sentences, A-Z lower-cased and white space aside. First is the
    smallest doc_id, and the earliest place within it. Every covered stretch goes, unless a caller
    wants those of fewer than ``least_words`` words to stay. A sentence of
    over ``sentence_words`` words (MOST_SENTENCE_WORDS at most) counts as several: its words decide the cuts, so that a passage of over
    50 words is found wherever it begins in a sentence, and a run with part of a
    sentence has ``part_words`` words at least; without ``by_content`` it is cut after so many words from its begin. Returns a row
    per input row: doc_id, text (what is left), n_sentences, n_removed, removed
    (the stretches), first_in (doc_ids that keep them, ascending; null ids aren't told).

    A null text stays null; an empty text or one of fewer sentences than a run is
    unchanged. Rows of one doc_id count as one document, so repeated rows don't
    remove each other. Rows with a null id are documents of their own, by text, after all
    others (ids are below 2**62) and among themselves in the order of a hash of the text; equal ones count as repeated rows. Very long texts are treated whole. An empty table gives an empty result. Runs are
    told apart by a 64-bit hash.
    """
    if not 1 <= sentence_words <= MOST_SENTENCE_WORDS:
        raise ValueError(f"sentence_words must be 1 to {MOST_SENTENCE_WORDS}")
    store = Scratch(docs.sparkSession, "substring_dedup")
    key = F.xxhash64("text")
    # a document's place in the order: its id, and for those without one a number from NO_ID on that the text decides
    place = F.coalesce(F.col("doc_id").cast("long"), key.bitwiseAND(F.lit(NO_ID - 1)).bitwiseOR(F.lit(NO_ID)))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", place.alias("place"), key.alias("key"))

    def emit(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                s = sentences_of(words_of(part.column("text"), ASCII_SPACE, LOWER_AZ), by_content, sentence_words)
                each = [_ascending(runs_of(s, r, run, part_words)[0]) for r in range(part.num_rows)]
                back = pa.array(np.repeat(np.arange(part.num_rows), [len(x) for x in each]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(each).view(np.int64)), part.column("place").take(back), part.column("key").take(back)], ["run", "place", "key"])

    runs = store.keep(docs.where("text IS NOT NULL").select("text", "place", "key").mapInArrow(emit, "run long, place long, key long"), "runs")
    repeated = runs.groupBy("run").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.count("*").alias("n")).where("first < last").drop("last")
    repeated = store.keep(repeated, "repeated")
    store.release()
    # most runs occur once: a bitmap of fixed size keeps them from being moved again
    some = runs.join(F.broadcast(bitmap(repeated, "run", BITMAP_BITS)), in_bitmap("run", BITMAP_BITS)).select("run", "place", "key")
    # a short list of repeated runs is broadcast; beyond that a run that many documents have goes to several tasks
    if repeated.count() <= BROADCAST_RUNS:
        met = some.join(F.broadcast(repeated.drop("n")), "run")
    else:
        met = salted_join(some, repeated.drop("n"), "run", F.xxhash64("key", "place"), hot_keys(repeated.select("run", "n"), "run", runs.count()))
    hits = met.where("place > first").groupBy("place", "key").agg(F.collect_set(F.struct("run", "first")).alias("runs"))
    hits = store.keep(hits, "hits")
    store.drop("runs", "repeated")
    store.release()
    joined = docs.join(hits, ["place", "key"], "left").select("doc_id", "text", F.col("runs.run").alias("run"), F.col("runs.first").alias("first"))

    def remove(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                w = words_of(part.column("text"), ASCII_SPACE, LOWER_AZ)
                s, data = sentences_of(w, by_content, sentence_words), w.data.tobytes()
                texts, gone, counts, firsts = [], [], [], []
                for r in range(part.num_rows):
                    at, end = int(w.offsets[r]), int(w.offsets[r + 1])
                    own = part.column("run")[r].values
                    known = own.to_numpy().view(U64) if own is not None else np.zeros(0, U64)
                    left, out, n, by = _clean(data[at:end], at, s, r, run, known, least_words, part_words)
                    texts.append(left if part.column("text")[r].is_valid else None)
                    gone.append(out)
                    counts.append(n)
                    named = np.unique(part.column("first")[r].values.to_numpy()[np.isin(known, by)]) if n and own is not None else np.zeros(0, np.int64)
                    firsts.append(named[named < NO_ID])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(np.diff(s.first), pa.int64()), pa.array(counts, pa.int64()), pa.array(gone, pa.list_(pa.binary())).cast(pa.list_(pa.string())), pa.array(firsts, pa.list_(pa.int64()))],
                    ["doc_id", "text", "n_sentences", "n_removed", "removed", "first_in"],
                )

    return joined.mapInArrow(remove, "doc_id long, text string, n_sentences long, n_removed long, removed array<string>, first_in array<long>")
