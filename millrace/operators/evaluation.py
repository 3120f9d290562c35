"""Evaluation aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import pass_at_k


def pass_rates(problems: DataFrame, ks: list[int]) -> DataFrame:
    """Mean pass@k over problems with n samples, c of them right; a problem counts for k up to its n."""
    each = problems.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where("k <= n")
    return each.groupBy("k").agg(F.avg(pass_at_k("n", "c", "k")).alias("pass_at_k"))


def accuracy(rows: DataFrame, correct: str, by: str | None = None) -> DataFrame:
    """Right answers, all answers, and their ratio, overall (null) and per source."""
    grouped = rows.rollup(by) if by else rows.groupBy()
    return grouped.agg(F.sum(F.col(correct).cast("bigint")).alias("num_correct"), F.count("*").alias("num_examples")).withColumn("accuracy", F.try_divide("num_correct", "num_examples"))


def rollout_matrix(rows: DataFrame, example: str, rollout: str, reward: str) -> DataFrame:
    """Rewards of each example in rollout order, rounded, with mean and population deviation."""
    return rows.groupBy(example).agg(F.transform(F.array_sort(F.collect_list(F.struct(rollout, reward))), lambda s: F.round(s[reward], 3)).alias("rewards"), F.avg(reward).alias("mean"), F.stddev_pop(reward).alias("std"))


def merged_metrics(metrics: DataFrame) -> DataFrame:
    """(key, value) of evaluators' metrics (key, value, ord): a later evaluator's value wins."""
    return metrics.groupBy("key").agg(F.max_by("value", "ord").alias("value"))


def token_usage(rows: DataFrame, tokens_in: str, tokens_out: str) -> DataFrame:
    return rows.agg(F.sum(F.size(tokens_in)).alias("input_tokens"), F.sum(F.size(tokens_out)).alias("output_tokens")).withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))
