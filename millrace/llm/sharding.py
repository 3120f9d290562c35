"""Sharding by minimax contiguous partition (operator 2).

Documents of equal text are one atomic group. Groups stand in one order; a binary
search finds the least capacity with which filling shards greedily in that order
needs no more shards than there are, and the groups are cut there.

The driver holds sizes of stretches of the order, not of groups: 65536 stretches
at first, and finer ones only where a cut may fall.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import Scratch

#: Hex digits of the group key by which stretches are first told apart, and by which they get finer.
STEP = 4
#: Stretches that the driver takes at once where cuts may fall.
AT_ONCE = 1_000_000
#: Rows are numbered within so many cells of each shard.
CELLS = 512


class Stretch(NamedTuple):
    """Consecutive groups: the digits that their keys begin with, their bytes and their number."""

    key: str
    size: int
    groups: int


def cut_greedily(ends: list[int], capacity: int, shards: int) -> list[int] | None:
    """Numbers of stretches after which to cut if each shard takes all that fits, or None if some are left over."""
    cuts, filled = [], 0
    for _ in range(shards):
        k = bisect_right(ends, filled + capacity)
        if k == len(ends):
            return cuts
        if k == (cuts[-1] if cuts else 0):
            return None
        cuts.append(k)
        filled = ends[k - 1]
    return None


def least_capacity(sizes: list[int], shards: int) -> int:
    """The smallest capacity for which ``cut_greedily`` succeeds."""
    ends = list(accumulate(sizes))
    if not ends:
        return 0
    lo, hi = max(max(sizes), -(-ends[-1] // shards)), ends[-1]
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if cut_greedily(ends, mid, shards) is not None else (mid + 1, hi)
    return lo


def _open(stretches: list[Stretch], largest: int, shards: int) -> list[int]:
    """Stretches of several groups in which some cut may fall, for any capacity from the least to what whole stretches allow."""
    sizes = [s.size for s in stretches]
    ends = list(accumulate(sizes))
    lo, hi = max(largest, -(-ends[-1] // shards)), least_capacity(sizes, shards)
    out, low, high = set(), 0, 0
    for _ in range(shards - 1):
        k = bisect_right(ends, low + lo)
        low, high = (ends[k - 1] if k else 0), min(ends[-1], high + hi)
        out.update(range(k, min(len(ends), bisect_right(ends, high) + 1)))
    return sorted(k for k in out if stretches[k].groups > 1)


def _giants(groups: DataFrame, total: int, shards: int) -> list[tuple[str, int]]:
    """Groups that fill a shard alone: each at least as large as the others' fair share of what is left."""
    top = [(r["key"], r["size"]) for r in groups.orderBy(F.desc("size"), "key").limit(shards - 1).collect()] if shards > 1 else []
    out = []
    for key, size in top:
        if size * (shards - len(out)) < total:
            break
        out.append((key, size))
        total -= size
    return out


def cut_keys(groups: DataFrame, shards: int) -> tuple[list[tuple[str, int]], list[str]]:
    """Keys of groups that get a shard each, and the least keys of the second and later of the other shards, in order.

    ``groups`` has key (hex digits), size and rows.
    """
    total = groups.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    giants = _giants(groups, total, shards)
    left = shards - len(giants)
    if giants:
        groups = groups.where(~F.col("key").isin([k for k, _ in giants]))
    largest = groups.agg(F.coalesce(F.max("size"), F.lit(0))).first()[0]

    def finer(df: DataFrame, digits: int) -> list[Stretch]:
        rows = df.groupBy(F.substring("key", 1, digits).alias("k")).agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()
        return sorted(Stretch(r["k"], r["s"], r["n"]) for r in rows)

    digits, stretches = STEP, finer(groups, STEP)
    while stretches and (where := _open(stretches, largest, left)):
        narrow = groups.where(F.substring("key", 1, digits).isin([stretches[k].key for k in where]))
        more = 32 if sum(stretches[k].groups for k in where) <= AT_ONCE else digits + STEP
        inside = finer(narrow, more)
        taken = set(where)
        stretches = sorted([s for k, s in enumerate(stretches) if k not in taken] + inside)
        digits = more
    sizes = [s.size for s in stretches]
    cuts = cut_greedily(list(accumulate(sizes)), least_capacity(sizes, left), left) if sizes else []
    return giants, [stretches[k].key for k in cuts]


def _place(key: Column, giants: list[tuple[str, int]], starts: list[str]) -> Column:
    """The shard of a group key. ``starts`` are compared as text: a stretch's digits stand before any key they begin."""
    first = F.size(F.filter(F.array(*[F.lit(s) for s in starts]), lambda s: s <= key)) if starts else F.lit(0)
    shard = first + len(giants)
    for k, (own, _) in enumerate(giants):
        shard = F.when(key == own, F.lit(k)).otherwise(shard)
    return shard.cast("int")


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Put documents into shards 0 to shards - 1 of near equal bytes; equal texts stay together.

    ``docs`` needs doc_id and text; all its columns stay, and size (UTF-8 bytes of
    the text plus 8), text_crc32 (unsigned, of the text's UTF-8), law ('bytes'),
    shard, slot (gapless from 0 in each shard) and grown_shard (null: the law is not
    'key') are added, replacing columns of these names.

    A group as large as the fair share of what remains has a shard alone; the other
    shards have the least possible capacity for their order. A null text counts as
    empty, and is of one group with empty texts. Repeated rows are rows of one group, each
    with a slot. Null ids take slots like others. With fewer groups than shards some
    shards are empty. An empty table gives an empty result.
    """
    store = Scratch(docs.sparkSession, "sharding")
    added = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    docs = docs.drop(*added)
    text = F.coalesce("text", F.lit(""))
    rows = docs.withColumns({"size": (F.octet_length(text) + 8).cast("long"), "text_crc32": F.crc32(text.cast("binary")), "__mr_key": F.md5(text.cast("binary")), "__mr_cell": F.pmod(F.xxhash64("doc_id"), F.lit(CELLS)).cast("int")})
    groups = store.keep(rows.groupBy(F.col("__mr_key").alias("key")).agg(F.sum("size").alias("size"), F.count("*").alias("rows")), "groups")
    placed = rows.withColumn("shard", _place(F.col("__mr_key"), *cut_keys(groups, shards)))

    # slots: rows are numbered within a cell, after the rows of the shard's earlier cells; at most shards * CELLS counts
    cells = placed.groupBy("shard", "__mr_cell").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("__mr_cell").rowsBetween(Window.unboundedPreceding, -1))
    cells = F.broadcast(cells.select("shard", "__mr_cell", F.coalesce(before, F.lit(0)).alias("__mr_before")))
    within = F.row_number().over(Window.partitionBy("shard", "__mr_cell").orderBy("doc_id", "__mr_key"))
    out = placed.withColumn("__mr_within", within).join(cells, ["shard", "__mr_cell"])
    return out.select(*docs.columns, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("__mr_before") + F.col("__mr_within") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
