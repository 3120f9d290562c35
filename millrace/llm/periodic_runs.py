"""Runs of words that repeat with a period (operator 11).

Words are ranked by comparing them; nothing is hashed and no suffix structure is built.
The method is that of Ellert and Fischer: Lyndon arrays of both orders of the words, found
from left to right with the lengths of all matches reused, name every run by the first of
its Lyndon roots; the match to the right that is known already gives its end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ._words import ASCII_SPACE, slices, spans_of

#: Times that rare words are taken out before runs are looked for; any number gives the same runs.
SIFTINGS = 8


def lyndon_array(x: list[int]) -> tuple[list[int], list[int]]:
    """For each place the next place at which a smaller suffix begins (the length if there is none), and how far the two suffixes match.

    The end is smaller than any symbol. Places whose next smaller suffix isn't known yet are a
    chain, each smaller than the one after it; the match of neighbours in the chain is kept. A new suffix is compared with them from
    the last on. Inside the furthest match, x[left:] like x[right:end], the answers to the left are
    reused; symbols are compared from ``end`` on only, so each step moves it or is the last of its kind.
    """
    n = len(x)
    after, match = [n] * n, [0] * n
    before, held = [-1] * n, [0] * n
    left = right = end = 0
    for i in range(1, n):
        j, m = i - 1, 0
        while True:
            known = False
            if right <= j and i + m < end and right < i:
                a, b = j - right + left, i - right + left
                if after[a] == b:
                    m, known = match[a], True
                elif before[b] == a:
                    m, known = held[b], True
                if i + m >= end:
                    m, known = end - i, False
            if not known:
                while i + m < n and x[j + m] == x[i + m]:
                    m += 1
                if m and i + m >= end:
                    left, right, end = j, i, i + m
            if i + m < n and x[j + m] < x[i + m]:
                before[i], held[i] = j, m
                break
            after[j], match[j] = i, m
            # further ones that match suffix j over more than m symbols are larger than suffix i too
            k, h = before[j], held[j]
            while k >= 0 and h > m:
                after[k], match[k] = i, m
                k, h = before[k], held[k]
            if k < 0:
                break
            if h < m:
                before[i], held[i] = k, h
                break
            j = k
    return after, match


def runs_of(x: list[int], exponent: int = 4, shortest: int = 6) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of at least ``exponent`` (2 or more) periods and ``shortest`` symbols, ascending by start, then period.

    A run's first Lyndon root is longest at its place in the order in which the run's next symbol is the smaller one; its
    start is less than a period before.
    """
    n, found = len(x), set()
    for sign in (1, -1):
        after, match = lyndon_array(x if sign > 0 else [-v for v in x])
        ends, ext = np.array(after, np.int64), np.array(match, np.int64)
        period = ends - np.arange(n)
        for t in np.flatnonzero((ends < n) & (ext > (exponent - 2) * period)).tolist():
            p, r = after[t] - t, match[t]
            if t >= p and after[t - p] == t and match[t - p] >= p:
                continue  # not the run's first root
            s = t
            while s > 0 and x[s - 1] == x[s - 1 + p]:
                s -= 1
            if (length := t - s + p + r) >= max(shortest, exponent * p):
                found.add((s, length, p))
    return sorted(found, key=lambda run: (run[0], run[2]))


def ranks(words: pa.Array) -> np.ndarray:
    """Each word's place among the different words, by comparing bytes."""
    return pc.rank(words, tiebreaker="dense").to_numpy().astype(np.int64) if len(words) else np.zeros(0, np.int64)


def stretches(rank: np.ndarray, row: np.ndarray, times: int, shortest: int) -> list[tuple[int, int]]:
    """(begin, end) of stretches of words outside which no run lies: a word that stands in one fewer than ``times`` times is in none of its runs, and parts it.

    The rows' runs are the stretches' runs, as a run that a rare word extended would hold it ``times`` times.
    """
    at, group = np.arange(len(rank)), row
    for _ in range(SIFTINGS):
        if not len(at):
            break
        _, which, count = np.unique(group * (len(rank) + 1) + rank[at], return_inverse=True, return_counts=True)
        stays = count[which] >= times
        whole = stays.all()
        at, group = at[stays], group[stays]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (group[1:] != group[:-1])
        group = np.cumsum(new) - 1
        long = (np.bincount(group) >= shortest)[group] if len(at) else new
        at, group = at[long], group[long]
        if whole:
            break
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(at) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(at)) - 1
    return list(zip(at[first].tolist(), (at[last] + 1).tolist(), strict=True)) if len(at) else []


def _of_slice(texts: pa.Array, exponent: int, shortest: int) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Of each row: the number of words, its runs, and the words that are left, joined by one space."""
    w = spans_of(texts)
    rows, n = len(texts), np.diff(w.first)
    rank = ranks(w.words())
    runs: list[list[tuple[int, int, int]]] = [[] for _ in range(rows)]
    gone = np.zeros(len(rank) + 1, np.int64)
    for a, b in stretches(rank, w.row, exponent, shortest):
        r = int(w.row[a])
        base = a - int(w.first[r])
        for s, length, p in runs_of(rank[a:b].tolist(), exponent, shortest):
            runs[r].append((s + base, length, p))
            gone[a + s + p] += 1
            gone[a + s + length] -= 1
    left = np.cumsum(gone)[:-1] == 0
    # bytes of the words that are left, and of one space behind each but a row's last
    keep = np.zeros(len(w.data) + 1, np.int64)
    np.add.at(keep, w.start[left], 1)
    np.add.at(keep, w.end[left], -1)
    take = np.cumsum(keep)[:-1] > 0
    data = w.data.copy()
    data[ASCII_SPACE[data]] = 0x20
    behind = np.flatnonzero(left)
    behind = behind[:-1][w.row[behind][1:] == w.row[behind][:-1]] if len(behind) else behind
    take[w.end[behind]] = True
    at = np.concatenate(([0], np.cumsum(take)))[w.offsets]
    text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(data[take].tobytes())])
    flat = np.array([x for own in runs for x in own], np.int64).reshape(-1, 3)
    offsets = np.concatenate(([0], np.cumsum([len(own) for own in runs]))).astype(np.int32)
    each = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
    return n, pa.ListArray.from_arrays(pa.array(offsets), each), text.cast(pa.large_string()).cast(pa.string())


def periodic_runs(docs: DataFrame, exponent: int = 4, shortest: int = 6) -> DataFrame:
    """Add n_words, runs and collapsed to documents: the runs of consecutive words that repeat with a period.

    ``docs`` needs a string ``text``; other columns stay, but for those of the three names, which are
    replaced. Words are what stands between ASCII white space. ``runs`` is an array of (start, length, period),
    start a word number from 0, by start, then period: stretches whose smallest period is ``period``, of at least ``exponent`` (2 or more)
    periods and ``shortest`` words, that no neighbouring word extends. ``collapsed`` holds the words that
    no run contains after its first period, joined by one space.

    Null and empty texts have no words, no runs and an empty ``collapsed``. Every row is looked at by
    itself, repeated or not, over its whole text; a very long one takes memory in proportion. An empty table gives an empty result.
    """
    docs = docs.drop("n_words", "runs", "collapsed")
    names = docs.columns
    added = StructType.fromDDL("n_words long, runs array<struct<start: long, length: long, period: long>>")

    def find(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, _of_slice(part.column("text"), exponent, shortest))], [*names, "n_words", "runs", "collapsed"])

    return docs.mapInArrow(find, StructType([*docs.schema.fields, *added.fields, StructField("collapsed", StringType())]))


def most_periodic(runs: str = "runs"):
    """Of a column of runs, the one of most periods, exactly compared; of equal ones the first; null if there is none."""
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    more = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(runs, none, lambda best, r: F.when(more(best, r), r).otherwise(best))
