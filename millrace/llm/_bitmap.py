"""A bitmap of hashes, of fixed size, that keeps rows without a partner from being moved.

A hash whose cell is empty is not among the given ones. The fuller the bitmap, the fewer rows
it holds back; results don't depend on it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cell(column: str, bits: int) -> str:
    return f"shiftrightunsigned({column}, {64 - bits})"


def bitmap(hashes: DataFrame, column: str, bits: int) -> DataFrame:
    """One row, words: a bit for each cell that one of the 64-bit hashes is in; 2**(bits - 3) bytes, whatever their number."""
    one = pa.table({"words": pa.array([bitmap_words(hashes, column, bits).view(np.int64)], pa.list_(pa.int64()))})
    return hashes.sparkSession.createDataFrame(one)


def bitmap_words(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """The same bits as an array of 64-bit words, for Python workers."""
    cell = _cell(column, bits)
    set_bits = hashes.selectExpr(f"CAST(shiftright({cell}, 6) AS int) AS word", f"shiftleft(1L, CAST({cell} & 63 AS int)) AS bit")
    rows = set_bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(1 << (bits - 6), np.int64)
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return words.view(np.uint64)


def held_in(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be among those of the bitmap."""
    cell = hashes >> np.uint64(64 - (int(len(words)).bit_length() + 5))
    return (words[cell >> np.uint64(6)] >> (cell & np.uint64(63))) & np.uint64(1) > 0


def in_bitmap(column: str, bits: int) -> Column:
    """Whether a hash may be among those of the bitmap that the row is joined with."""
    cell = _cell(column, bits)
    return F.expr(f"getbit(words[CAST(shiftright({cell}, 6) AS int)], CAST({cell} & 63 AS int)) = 1")
