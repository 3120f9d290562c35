"""Preference data: mappers, pairing, tournaments, and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import cut_after_first_one
from ..functions.numbers import preference_value
from ..functions.text import _col, human_assistant_turns
from . import render


def message(role: str, content: Column | str) -> Column:
    return F.struct(F.lit(role).alias("role"), _col(content).alias("content"))


def chosen_rejected(df: DataFrame, prompt: str, chosen: Column, rejected: Column) -> DataFrame:
    """Comparisons whose first completion is the chosen one."""
    return df.select("*", F.array(message("user", prompt)).alias("prompt_conversation"), F.array(message("assistant", chosen)).alias("completion_a"), F.array(message("assistant", rejected)).alias("completion_b"), F.lit("A").alias("label"))


def hhh_comparisons(df: DataFrame) -> DataFrame:
    """Comparisons of two transcripts that are equal but for their last message; other rows go."""
    parsed = df.withColumns({"_a": human_assistant_turns("chosen"), "_b": human_assistant_turns("rejected")})
    n = F.size("_a")
    front = lambda c: F.slice(c, F.lit(1), n - 1)
    ok = (n > 0) & (n == F.size("_b")) & (front("_a") == front("_b")) & (F.try_element_at("_a", F.lit(-1)) != F.try_element_at("_b", F.lit(-1)))
    return parsed.where(ok).select(*df.columns, front("_a").alias("prompt_conversation"), F.slice("_a", F.lit(-1), F.lit(1)).alias("completion_a"), F.slice("_b", F.lit(-1), F.lit(1)).alias("completion_b"), F.lit("A").alias("label"))


def rated_comparisons(df: DataFrame, rating: str = "overall_preference") -> DataFrame:
    """A signed rating as a label: below zero is A, above B, zero goes."""
    return df.where(F.col(rating) != 0).withColumn("label", F.when(F.col(rating) < 0, "A").otherwise("B"))


def plain_parts(parts: Column) -> Column:
    """Text of a content list if all of it is text, parts joined by a space; null otherwise."""
    return F.when(F.forall(parts, lambda p: p["type"] == "text"), F.array_join(F.transform(parts, lambda p: p["text"]), " "))


def arena_comparisons(df: DataFrame) -> DataFrame:
    """Comparisons from two conversations and a winner; only plain text of users and assistants counts. The prompt is the first conversation's first message."""

    def plain(name: str) -> Column:
        own = F.filter(F.col(name), lambda m: m["role"].isin("user", "assistant") & (F.size(m["content"]) > 0))
        sound = F.forall(own, lambda m: F.forall(m["content"], lambda p: p["type"] == "text"))
        return F.when(sound, F.transform(own, lambda m: F.struct(m["role"].alias("role"), plain_parts(m["content"]).alias("content"))))

    parsed = df.where(F.col("winner").isin("model_a", "model_b")).withColumns({"_a": plain("conversation_a"), "_b": plain("conversation_b")})
    last = lambda c: F.try_element_at(c, F.lit(-1))["role"] == "assistant"
    ok = (F.size("_a") >= 2) & (F.size("_b") >= 2) & last("_a") & last("_b")
    rest = lambda c: F.slice(c, F.lit(2), F.size(c))
    return parsed.where(ok).select(*df.columns, F.slice("_a", F.lit(1), F.lit(1)).alias("prompt_conversation"), rest("_a").alias("completion_a"), rest("_b").alias("completion_b"), F.when(F.col("winner") == "model_a", "A").otherwise("B").alias("label"))


def best_and_worst(df: DataFrame, group: str, value: str, score: str, order: str) -> DataFrame:
    """Of every group of two or more with different scores: the first of the best, the last of the worst, and the gap."""
    by = F.struct(F.col(score), -F.col(order))
    own = df.groupBy(group).agg(F.max_by(value, by).alias("chosen"), F.min_by(value, by).alias("rejected"), (F.max(score) - F.min(score)).alias("gap"), F.count("*").alias("_n"))
    return own.where("_n >= 2 AND gap > 0").drop("_n")


def random_swap(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Swap half of the pairs; (seed, key) decides which."""
    even = F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), 1, 1), 16, 10).cast("int") % 2 == 0
    label = F.when(even, F.when(F.col("label") == "A", "B").when(F.col("label") == "B", "A").otherwise(F.col("label"))).otherwise(F.col("label"))
    pick = lambda a, b: F.when(even, F.col(b)).otherwise(F.col(a))
    return df.withColumns({"completion_a": pick("completion_a", "completion_b"), "completion_b": pick("completion_b", "completion_a"), "label": label})


def comparison_conversation(with_label: bool = False) -> Column:
    """One conversation that shows a prompt and both completions under headings, and the label if asked."""
    mark = lambda s: F.array(message("system", F.lit(f"==== {s} ====")))
    parts = [F.col("prompt_conversation"), mark("Completion A"), F.col("completion_a"), mark("Completion B"), F.col("completion_b"), mark("Preference")]
    return F.concat(*parts, *([F.array(message("assistant", "label"))] if with_label else []))


def dpo_pairs(comparisons: DataFrame, key: str, drop_ties: bool = False) -> DataFrame:
    """Two rows a comparison, chosen then rejected. A tie counts as B chosen unless ties are dropped."""
    if drop_ties:
        comparisons = comparisons.where("label <> 'Tie'")
    a_won = F.col("label") == "A"
    full = lambda first, second: F.concat("prompt_conversation", F.when(a_won, F.col(first)).otherwise(F.col(second)))
    sides = F.array(F.struct(F.lit("chosen").alias("side"), full("completion_a", "completion_b").alias("messages")), F.struct(F.lit("rejected").alias("side"), full("completion_b", "completion_a").alias("messages")))
    return comparisons.select(key, F.explode(sides).alias("s")).select(key, "s.side", "s.messages")


def matchups(players: DataFrame, group: str, chunk: int, both_ways: bool = False) -> DataFrame:
    """Pairs (i, j) of players of a group within chunks of consecutive players: i before j, or either way. Players are numbered by idx."""
    own = players.withColumn("_chunk", F.floor(F.col("idx") / chunk))
    keep = [c for c in players.columns if c != group]
    side = lambda p: own.select(group, "_chunk", *[F.col(c).alias(f"{c}_{p}") for c in keep])
    order = F.col("idx_i") != F.col("idx_j") if both_ways else F.col("idx_i") < F.col("idx_j")
    return side("i").join(side("j"), [group, "_chunk"]).where(order).drop("_chunk")


def tournament(matches: DataFrame, players: DataFrame, group: str, valid: Column | None = None) -> DataFrame:
    """win_minus_loss (per match) and reward (less one where invalid) of each player; null for a player without matches.

    ``matches`` has idx_i, idx_j and reward_j: what j gets and i loses.
    """
    ends = F.array(F.struct(F.col("idx_j").alias("idx"), F.col("reward_j").alias("r")), F.struct(F.col("idx_i").alias("idx"), (-F.col("reward_j")).alias("r")))
    score = matches.select(group, F.explode(ends).alias("e")).groupBy(group, F.col("e.idx").alias("idx")).agg(F.sum("e.r").alias("_s"), F.count("*").alias("_n"))
    ok = F.lit(1.0) if valid is None else valid.cast("double")
    out = players.join(score, [group, "idx"], "left").withColumn("win_minus_loss", F.try_divide("_s", "_n"))
    return out.withColumn("reward", F.col("win_minus_loss") + ok - 1.0).drop("_s", "_n")


def shorter_wins(length_a: Column | str, length_b: Column | str) -> Column:
    """What the second completion gets: 1 if it is shorter, -1 if longer."""
    return F.signum((_col(length_a) - _col(length_b)).cast("double"))


def win_rate(scores: DataFrame, first: str = "r0", second: str = "r1") -> DataFrame:
    """Mean and standard error of (r0 - r1 + 2) / 4: rewards with the policy second and first."""
    x = (F.col(first) - F.col(second) + 2.0) / 4.0
    return scores.agg(F.avg(x).alias("win_rate"), (F.stddev_pop(x) / F.sqrt(F.count(x).cast("double"))).alias("stderr"))


def reward_model_examples(comparisons: DataFrame, key: str, template: str) -> DataFrame:
    """(key, tokens, weights): a comparison and its label rendered, cut after the first trained token; bytes are tokens."""
    shown = comparisons.select(key, comparison_conversation(with_label=True).alias("messages"))
    example = shown.select(key, render.byte_example(render.pieces(shown, template)).alias("e"))
    cut = lambda c: cut_after_first_one(F.col(f"e.{c}"), "e.weights")
    return example.select(key, cut("tokens").alias("tokens"), cut("weights").alias("weights"))


def preference_prompts(comparisons: DataFrame, key: str, template: str) -> DataFrame:
    """(key, prompt): what a reward model is asked about two completions."""
    shown = comparisons.select(key, comparison_conversation().alias("messages"))
    return shown.select(key, render.generation_prompt(shown, template).alias("prompt"))


def both_ways_scores(comparisons: DataFrame, judged: DataFrame, key: str) -> DataFrame:
    """(key, r0, r1): what the judge says of new against reference and the other way round, from (key, swapped, verdict)."""
    value = preference_value("verdict")
    own = judged.groupBy(key).agg(F.max(F.when(~F.col("swapped"), value)).alias("r0"), F.max(F.when(F.col("swapped"), value)).alias("r1"))
    return comparisons.select(key).join(own, key).where("r0 IS NOT NULL AND r1 IS NOT NULL")


def judged_pairs(pairs: DataFrame, judge, preprocess=None, a: str = "completion_a", b: str = "completion_b") -> DataFrame:
    """Adds score: what ``judge``, a function of two columns, says in [-1, 1] after ``preprocess`` of either completion's text."""
    seen = preprocess or (lambda c: c)
    return pairs.withColumn("score", judge(seen(F.col(a)), seen(F.col(b))))
