"""Vectorised word hashing over Arrow string columns.

Words are found and hashed on the UTF-8 bytes of a whole slice of rows at once.
A word's hash is the sum of one random 64-bit number per (place in the word,
byte), mixed; two different words collide with probability 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text handled at once: a byte needs about 30 bytes of working memory.
SLICE_BYTES = 2 << 20
_PLACES = 64
_rng = np.random.Generator(np.random.PCG64(20240229))
_TABLE = _rng.integers(0, 2**64, size=(_PLACES * 256,), dtype=U64)
#: Odd multipliers for the words of a run.
RUN = _rng.integers(0, 2**64, size=4096, dtype=U64) | U64(1)

ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII bytes other than letters and digits: what parts words when punctuation is ignored.
NOT_ALNUM = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
AS_IS = np.arange(256, dtype=np.uint8)
LOWER_AZ = AS_IS.copy()
LOWER_AZ[65:91] += 32


class Words(NamedTuple):
    """Words of a slice of rows, in order."""

    data: np.ndarray  # the rows' bytes
    offsets: np.ndarray  # of each row in data, and the end
    start: np.ndarray  # of each word in data
    end: np.ndarray
    row: np.ndarray  # of each word
    hash: np.ndarray
    first: np.ndarray  # of each row, its first word; and the number of words


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def _spans(data: np.ndarray, offsets: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = ~parts[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def hashes_of(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """A hash of each stretch of bytes; none is empty."""
    out, step = np.empty(len(start), U64), np.cumsum(end - start)
    lo = 0
    with np.errstate(over="ignore"):
        while lo < len(start):
            hi = max(lo + 1, int(np.searchsorted(step, (step[lo - 1] if lo else 0) + SLICE_BYTES)))
            size = end[lo:hi] - start[lo:hi]
            at = np.concatenate(([0], np.cumsum(size)[:-1]))
            place = np.arange(int(size.sum())) - np.repeat(at, size)
            byte = fold[data[place + np.repeat(start[lo:hi], size)]]
            z = _TABLE[((place & (_PLACES - 1)) << 8) | byte]
            if size.max() > _PLACES:
                z *= ((place >> 6) * 2 + 1).astype(U64)
            out[lo:hi] = mix(np.add.reduceat(z, at) + size.astype(U64) * RUN[0])
            lo = hi
    return out


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The rows' bytes, and where each row begins in them, and the end; a null row has none."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, where, held = texts.buffers()
    offsets = np.frombuffer(where, np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None and held.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words_of(texts: pa.Array, parts: np.ndarray = ASCII_SPACE, fold: np.ndarray = AS_IS) -> Words:
    """The words of every row of a string or binary array; a null row has none."""
    data, offsets = bytes_of(texts)
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, offsets, none, none, none, np.zeros(0, U64), np.zeros(len(texts) + 1, np.int64))
    start, end = _spans(data, offsets, parts)
    row = np.searchsorted(offsets, start, "right") - 1
    first = np.searchsorted(start, offsets)
    return Words(data, offsets, start, end, row, hashes_of(data, start, end, fold), first)


class Spans(NamedTuple):
    """Words of a slice of rows, in order, unhashed."""

    data: np.ndarray
    offsets: np.ndarray  # of each row in data, and the end
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray  # of each row, its first word; and the number of words

    def words(self) -> pa.Array:
        size = np.concatenate(([0], np.cumsum(self.end - self.start))).astype(np.int64)
        inside = np.zeros(len(self.data) + 1, np.int8)
        inside[self.start] += 1
        inside[self.end] -= 1
        own = self.data[np.cumsum(inside, dtype=np.int8)[:-1] > 0]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.start), [None, pa.py_buffer(size.tobytes()), pa.py_buffer(own.tobytes())])


def spans_of(texts: pa.Array, parts: np.ndarray = ASCII_SPACE) -> Spans:
    """The words of every row of a string or binary array; a null row has none."""
    data, offsets = bytes_of(texts)
    start, end = _spans(data, offsets, parts) if len(data) else (np.zeros(0, np.int64),) * 2
    return Spans(data, offsets, start, end, np.searchsorted(offsets, start, "right") - 1, np.searchsorted(start, offsets))


def letters_upto(w: Words, which: np.ndarray, sizes: range) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each size: the words of ``which`` that are longer, and hashes of their first so many bytes."""
    z, size = np.zeros(len(which), U64), w.end[which] - w.start[which]
    for k in range(sizes.stop - 1):
        longer = size > k + 1
        which, z, size = which[longer], z[longer], size[longer]
        with np.errstate(over="ignore"):
            z += _TABLE[(k << 8) | w.data[w.start[which] + k].astype(np.int64)]
            if k + 1 in sizes:
                yield k + 1, which, mix(z + U64(k + 1) * RUN[0])


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about SLICE_BYTES of text, a row at least."""
    total, lo = np.cumsum(_lengths(batch.column(column))), 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + SLICE_BYTES)))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _lengths(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(texts.cast(pa.large_binary())), 0).to_numpy(zero_copy_only=False)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, and each run's row; a shorter row gives one run of all its words."""
    n = np.diff(words.first)
    with np.errstate(over="ignore"):
        m = max(0, len(words.hash) - k + 1)
        run = np.zeros(m, U64)
        for j in range(k):
            run += words.hash[j : j + m] * RUN[1 + j]
        whole = words.row[:m] == words.row[k - 1 : k - 1 + m]
        out, row = mix(run[whole]), words.row[:m][whole]
        few = np.flatnonzero((n > 0) & (n < k))
        if len(few):
            one = np.empty(len(few), U64)
            for i, r in enumerate(few):
                h = words.hash[words.first[r] : words.first[r + 1]]
                one[i] = np.add.reduce(h * RUN[64 + int(n[r]) * 8 : 64 + int(n[r]) * 8 + len(h)])
            out, row = np.concatenate((out, mix(one))), np.concatenate((row, few))
            order = np.argsort(row, kind="stable")
            out, row = out[order], row[order]
    return out, row


def sets_of(hashes: np.ndarray, row: np.ndarray, rows: int) -> list[np.ndarray]:
    """Each row's distinct hashes, ascending."""
    cut = np.searchsorted(row, np.arange(rows + 1))
    return [np.unique(hashes[cut[i] : cut[i + 1]]) for i in range(rows)]
