"""Canonical Huffman codes of limited length, packed and unpacked many symbols at once."""

from __future__ import annotations

import numpy as np

U64 = np.uint64


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """For each symbol the length of its code, at most ``limit``, that makes the whole shortest; 0 for symbols that don't occur.

    Coins of all lengths are merged in pairs, level by level. A level's chosen coins are its lightest, so
    a symbol's length is the number of levels at which it is among them. A lone symbol has one bit.
    """
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols have no codes of at most {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.int64)
    coins, own = weight, [np.ones(len(weight), bool)]
    for _ in range(limit - 1):
        pairs = coins[: len(coins) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate((weight, pairs))
        by = np.argsort(both, kind="stable")
        coins = both[by]
        own.append(by < len(weight))
    take = 2 * len(used) - 2
    for level in reversed(own):
        n = int(level[:take].sum())
        out[order[:n]] += 1
        take = 2 * (take - n)
    return out


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols in the order of their codes (by length, then symbol), and each symbol's code."""
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    top = int(lengths.max()) if len(lengths) else 0
    step = U64(1) << (top - lengths[order].astype(np.int64)).astype(U64)
    codes = np.zeros(len(lengths), U64)
    codes[order] = (np.cumsum(step) - step) >> (top - lengths[order].astype(np.int64)).astype(U64)
    return order, codes


def pack(symbols: np.ndarray, lengths: np.ndarray, codes: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbols' codes one after the other in 32-bit words, highest bit first; and the bit at which each block of ``block`` symbols begins."""
    size = lengths[symbols].astype(np.int64)
    at = np.cumsum(size) - size
    bits = int(at[-1] + size[-1]) if len(size) else 0
    value = codes[symbols] << (64 - (at & 31) - size).astype(U64)
    word, n = at >> 5, (bits >> 5) + 2
    # codes share no bit, so the sums are below 2**32 and exact
    high = np.bincount(word, weights=(value >> U64(32)).astype(np.float64), minlength=n)
    low = np.bincount(word + 1, weights=(value & U64(0xFFFFFFFF)).astype(np.float64), minlength=n)
    return (high + low).astype(np.uint32)[: (bits + 31) >> 5], at[::block].astype(U64)


def unpack(words: np.ndarray, begins: np.ndarray, n: int, lengths: np.ndarray, block: int) -> np.ndarray:
    """The first n symbols: all blocks are decoded side by side, a table look-up for each symbol."""
    order, _ = canonical(lengths)
    if not n:
        return np.zeros(0, np.uint32)
    top = int(lengths.max())
    times = 1 << (top - lengths[order].astype(np.int64))
    symbol, size = np.zeros(1 << top, np.uint32), np.ones(1 << top, U64)
    filled = int(times.sum())
    symbol[:filled], size[:filled] = np.repeat(order, times), np.repeat(lengths[order], times)
    wide = np.concatenate((words, np.zeros(2, np.uint32))).astype(U64)
    wide = (wide[:-1] << U64(32)) | wide[1:]
    out, at, last = np.empty((len(begins), block), np.uint32), begins.astype(U64), U64(len(wide) - 1)
    for k in range(block):
        # the last block may go on past the end: what it reads there is cut off
        seen = wide[np.minimum(at >> U64(5), last)] >> (U64(64 - top) - (at & U64(31)))
        seen &= U64((1 << top) - 1)
        out[:, k] = symbol[seen]
        at += size[seen]
    return out.ravel()[:n]
