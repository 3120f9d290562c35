"""Rollouts: rewards, advantages, metrics, and training rows.

transitions(group_id, traj_idx, step_idx, ob_tokens, ac_tokens, ac_logprobs, reward, metrics)
and trajectories(group_id, traj_idx, final_reward, metrics) are the tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.arrays import inputs, is_prefix, targets

_TRAJECTORY = ["group_id", "traj_idx"]


def total_rewards(transitions: DataFrame, trajectories: DataFrame) -> DataFrame:
    """Sum of step rewards plus the final reward; a trajectory without steps has only the latter."""
    steps = transitions.groupBy(*_TRAJECTORY).agg(F.sum("reward").alias("_steps"))
    return trajectories.join(steps, _TRAJECTORY, "left").withColumn("total_reward", F.coalesce("_steps", F.lit(0.0)) + F.col("final_reward")).drop("_steps")


def advantages(rewards: DataFrame, reward: str = "total_reward", group: str = "group_id") -> DataFrame:
    """Reward minus the group's mean; not scaled."""
    mean = rewards.groupBy(group).agg(F.avg(reward).alias("_mean"))
    return rewards.join(mean, group).withColumn("advantage", F.col(reward) - F.col("_mean")).drop("_mean")


def without_constant_groups(rewards: DataFrame, reward: str = "total_reward", group: str = "group_id") -> DataFrame:
    """Groups whose rewards differ; if none do, the first group."""
    groups = rewards.groupBy(group).agg((F.min(reward) != F.max(reward)).alias("_mixed"))
    of_all = groups.agg(F.max("_mixed").alias("_any"), F.min(group).alias("_first"))
    keep = groups.join(F.broadcast(of_all), F.lit(True)).where("_mixed OR (NOT _any AND " + group + " = _first)").select(group)
    return rewards.join(keep, group, "left_semi")


def all_same(x: Column | str) -> Column:
    """An aggregate: whether all values are equal, nulls among them; true of none."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(F.count(x) == 0, True).otherwise((F.min(x) == F.max(x)) & (F.count(x) == F.count("*")))


def group_fractions(rewards: DataFrame, reward: str = "total_reward", group: str = "group_id", good: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """Shares of groups that are mixed, all good and all bad."""
    by = by or []
    g = rewards.groupBy(*by, group).agg(F.min(reward).alias("lo"), all_same(reward).alias("same"))
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    same = F.col("same")
    return g.groupBy(*by).agg(share(~same).alias("frac_mixed"), share(same & (F.col("lo") >= good)).alias("frac_all_good"), share(same & (F.col("lo") < good)).alias("frac_all_bad"))


def metric_means(*maps: DataFrame, column: str = "metrics", by: list[str] | None = None) -> DataFrame:
    """The mean of every key over the maps that have it, of all tables pooled."""
    by = by or []
    pooled = None
    for df in maps:
        own = df.select(*by, F.explode(column).alias("key", "value"))
        pooled = own if pooled is None else pooled.unionByName(own)
    return pooled.groupBy(*by, "key").agg(F.avg("value").alias("value"))


def with_tags(groups: DataFrame, tags: str = "tags", group: str = "group_id") -> DataFrame:
    """(group, tag): every tag of a group, if some tag misses some group, and 'all'."""
    n = groups.agg(F.count("*").alias("_n"))
    each = groups.select(group, F.explode(tags).alias("tag"))
    fewest = each.groupBy("tag").count().agg(F.min("count").alias("_fewest"))
    gate = n.join(F.broadcast(fewest), F.lit(True))
    return each.join(F.broadcast(gate), F.lit(True)).where("_fewest < _n").select(group, "tag").union(groups.select(group, F.lit("all")))


def trajectory_metrics(transitions: DataFrame, trajectories: DataFrame, groups: DataFrame) -> DataFrame:
    """Metrics of every tag: token and turn counts, their ratios of sums, mean total reward, group fractions."""
    tags = with_tags(groups)
    steps = transitions.groupBy(*_TRAJECTORY).agg(F.sum("reward").alias("_steps"), F.count("*").alias("turns"), F.sum(F.size("ac_tokens")).alias("ac"), F.sum(F.size("ob_tokens")).alias("ob"))
    each = trajectories.join(steps, _TRAJECTORY, "left").na.fill(0, ["turns", "ac", "ob"])
    each = each.withColumn("total_reward", F.coalesce("_steps", F.lit(0.0)) + F.col("final_reward")).join(tags, "group_id")
    out = each.groupBy("tag").agg(
        F.try_divide(F.sum("ac"), F.sum("turns")).alias("ac_tokens_per_turn"),
        F.try_divide(F.sum("ob"), F.sum("turns")).alias("ob_tokens_per_turn"),
        F.try_divide(F.sum("turns"), F.count("*")).alias("turns_per_episode"),
        F.count("*").alias("total_episodes"), F.sum("turns").alias("total_turns"), F.sum("ac").alias("total_ac_tokens"), F.sum("ob").alias("total_ob_tokens"),
        F.avg("total_reward").alias("reward_total"),
    )
    return out.join(group_fractions(each.select("tag", "group_id", "total_reward"), by=["tag"]), "tag")


def training_rows(transitions: DataFrame, advantage: DataFrame) -> DataFrame:
    """Training rows of every trajectory: steps whose observation goes on from the last step's end are one row.

    Returns group_id, traj_idx, segment, input_tokens, target_tokens, logprobs,
    advantages, mask, shifted by one. Steps without tokens give none.
    """
    w = Window.partitionBy(*_TRAJECTORY).orderBy("step_idx")
    before = F.concat(F.lag("ob_tokens").over(w), F.lag("ac_tokens").over(w))
    steps = transitions.select(*_TRAJECTORY, "step_idx", "ob_tokens", "ac_tokens", "ac_logprobs", before.alias("_before"))
    goes_on = F.coalesce(is_prefix("_before", "ob_tokens"), F.lit(False))
    steps = steps.withColumn("_on", goes_on).withColumn("segment", (F.sum(F.when(F.col("_on"), 0).otherwise(1)).over(w) - 1).cast("int"))
    new = F.when(F.col("_on"), F.slice("ob_tokens", F.size("_before") + 1, F.size("ob_tokens"))).otherwise(F.col("ob_tokens"))
    steps = steps.withColumn("_new", new).join(advantage.select(*_TRAJECTORY, "advantage"), _TRAJECTORY)
    fill = lambda value, own: F.concat(F.array_repeat(F.lit(value), F.size("_new")), own)
    part = F.struct(
        "step_idx", F.concat("_new", "ac_tokens").alias("tokens"), fill(0.0, F.col("ac_logprobs")).alias("logprobs"),
        fill(0.0, F.array_repeat(F.col("advantage").cast("double"), F.size("ac_tokens"))).alias("advantages"),
        fill(0.0, F.array_repeat(F.lit(1.0), F.size("ac_tokens"))).alias("mask"),
    )
    whole = steps.groupBy(*_TRAJECTORY, "segment").agg(F.array_sort(F.collect_list(part)).alias("_parts"))
    joined = lambda name: F.flatten(F.transform("_parts", lambda p: p[name]))
    return whole.where(F.size(joined("tokens")) > 0).select(*_TRAJECTORY, "segment", inputs(joined("tokens")).alias("input_tokens"), targets(joined("tokens")).alias("target_tokens"), *[targets(joined(c)).alias(c) for c in ("logprobs", "advantages", "mask")])


def reward_summary(transitions: DataFrame, trajectories: DataFrame) -> DataFrame:
    """Steps with their running reward, then a row for the final and one for the total reward of each trajectory."""
    w = Window.partitionBy(*_TRAJECTORY).orderBy("step_idx")
    steps = transitions.select(*_TRAJECTORY, F.col("step_idx").cast("string").alias("step"), "reward", F.sum("reward").over(w).alias("running"))
    ends = total_rewards(transitions, trajectories)
    final = ends.select(*_TRAJECTORY, F.lit("final"), "final_reward", "total_reward")
    return steps.union(final).union(ends.select(*_TRAJECTORY, F.lit("total"), "total_reward", "total_reward"))


def representatives(rows: DataFrame, score: str, key: str, group: str, count: int = 4) -> DataFrame:
    """Rows at evenly spaced ranks of the score, of groups that have more than ``count`` rows; all rows of others."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(score, key)) - 1
    n = F.count("*").over(Window.partitionBy(group))
    ranked = rows.withColumns({"_rank": rank, "_n": n})
    picks = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.floor(i * (F.col("_n") - 1) / (count - 1)))
    return ranked.where((F.col("_n") <= count) | F.array_contains(picks, F.col("_rank").cast("bigint"))).drop("_n").withColumnRenamed("_rank", "rank")


def first_win(turns: DataFrame, won: Column, most: int, by: list[str]) -> DataFrame:
    """Games of turns: the turn of the first win within ``most`` turns, the reward, and how many turns were played."""
    own = turns.withColumn("_won", won).where(F.col("turn") <= most)
    first = F.min(F.when(F.col("_won"), F.col("turn")))
    return own.groupBy(*by).agg(first.alias("won_at"), F.when(first.isNotNull(), 1.0).otherwise(0.0).alias("reward"), F.coalesce(first, F.max("turn")).alias("turns"))


def group_mean_reward(rewards: DataFrame, reward: str = "total_reward", group: str = "group_id") -> DataFrame:
    """The mean of group means; it differs from the mean over trajectories where group sizes differ."""
    return rewards.groupBy(group).agg(F.avg(reward).alias("m")).agg(F.avg("m").alias("reward_total"))


def sampling_summary(groups: DataFrame, step: str = "sampled_at_step", seconds: str = "seconds") -> DataFrame:
    """Largest, smallest and mean sampler step and sampling time of the groups of a batch."""
    return groups.agg(*[f(c).alias(f"{name}_{k}") for c, name in ((step, "step"), (seconds, "sampling_time")) for k, f in (("max", F.max), ("min", F.min), ("mean", F.avg))])


def mean_length(rows: DataFrame, text: str) -> DataFrame:
    """Mean length of the texts that are there, in characters."""
    return rows.agg(F.avg(F.length(text)).alias("mean_length"))


def scanned(x: np.ndarray, begins: np.ndarray, gamma: float, carry: float) -> np.ndarray:
    """y[t] = x[t] + gamma * y[t - 1] within stretches that begin where ``begins`` is true; ``carry`` is y before the first row. In steps of doubling reach."""
    stretch, y, reach = np.cumsum(begins), x.astype(np.float64), 1
    if len(y) and not begins[0]:
        y[0] += gamma * carry
    while reach < len(y) and gamma**reach > 0:
        y[reach:] = y[reach:] + np.where(stretch[reach:] == stretch[:-reach], gamma**reach * y[:-reach], 0.0)
        reach *= 2
    return y


def discounted_rows(steps: DataFrame, by: str, step: str, reward: str, gamma: float, name: str = "future") -> DataFrame:
    """Add ``name``: each step's reward and what follows it in its trajectory, discounted by gamma a step; a row for each step, in no array. Null rewards count as 0.

    A trajectory's steps lie in one partition, last ones first; what follows a batch's rows is carried from batch to batch.
    """
    rows = steps.drop(name).repartition(by).sortWithinPartitions(by, F.col(step).desc())
    names = rows.columns

    def add(batches):
        last, carry, seen = None, 0.0, False
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(by).dictionary_encode()
            code = key.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            begins = np.concatenate(([not seen or batch.column(by)[0].as_py() != last], code[1:] != code[:-1]))
            y = scanned(pc.fill_null(batch.column(reward).cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False), begins, gamma, carry)
            last, carry, seen = batch.column(by)[batch.num_rows - 1].as_py(), float(y[-1]), True
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(y)], [*names, name])

    return rows.mapInArrow(add, StructType([*rows.schema.fields, StructField(name, DoubleType())]))
