"""Connected components by alternating large-star and small-star steps.

Every step is a partial aggregate and a join on node ids, two numbers a row; the edges
of a hub with more than HUB_EDGES are dealt over several tasks. The edges of a step are
written before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._skew import hot_keys, salted_join
from ._store import Scratch

#: A node with more edges than this is a hub.
HUB_EDGES = 1 << 20


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _with_least(edges: DataFrame, among: DataFrame, rows: int) -> DataFrame:
    """Edges (u, v) with m, the least neighbour of u among the given edges."""
    least = among.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return salted_join(edges, least.select("u", "m"), "u", F.xxhash64("v"), hot_keys(least, "u", rows, HUB_EDGES))


def components(edges: DataFrame, store: Scratch, name: str) -> DataFrame:
    """(node, root) for every node of the long columns u and v; root is the component's least node."""
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, last, before, i = store.keep(now, f"{name}0"), f"{name}0", None, 0
    while (state := _state(now)) != before:
        before, i = state, i + 1
        both = now.union(now.select(F.col("v"), F.col("u")))
        large = _with_least(both.where("v > u"), both, 2 * state[0]).select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        if state[0] > HUB_EDGES:
            large = store.keep(large, f"{name}large{i}")
        small = _with_least(large, large, state[0]).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        now = store.keep(small.select("e.u", "e.v").where("u <> v").distinct(), f"{name}{i}")
        store.drop(last, f"{name}large{i}")
        last = f"{name}{i}"
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
