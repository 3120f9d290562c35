"""Joins on keys of which one may hold a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more rows than this is dealt over several tasks.
HOT_ROWS = 4096
#: At most so many keys count as hot: the table of them, some 30 bytes a key, goes over the driver.
MOST_HOT = 50_000


def hot_keys(counts: DataFrame, key: str, rows: int, least: int | None = None) -> DataFrame | None:
    """(key, __mr_blocks) of keys with over ``least`` (HOT_ROWS) of the ``rows`` rows, from (key, n); None if there are none.

    MOST_HOT at most, as each has over rows / MOST_HOT rows.
    """
    least = max(least or HOT_ROWS, rows // MOST_HOT)
    if rows <= least:
        return None
    hot = counts.where(F.col("n") > least).select(key, F.ceil(F.col("n") / least).cast("int").alias("__mr_blocks"))
    found = hot.collect()
    return counts.sparkSession.createDataFrame(found, hot.schema) if found else None


def count_by(many: DataFrame, key: str) -> DataFrame:
    return many.groupBy(key).agg(F.count("*").alias("n"))


def salted_join(many: DataFrame, one: DataFrame, key: str, spread: Column, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """``many`` joined with ``one``, which has a key once; rows of the ``hot_keys`` are dealt by ``spread`` over several tasks. Null keys match nothing."""
    if hot is None:
        return many.join(one, key, how)
    blocks = F.coalesce("__mr_blocks", F.lit(1))
    hot = F.broadcast(hot)
    dealt = many.join(hot, key, "left").withColumn("__mr_salt", F.pmod(spread, blocks).cast("int")).drop("__mr_blocks")
    copied = one.join(hot, key, "left").withColumn("__mr_salt", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("__mr_blocks")
    return dealt.join(copied, [key, "__mr_salt"], how).drop("__mr_salt")
