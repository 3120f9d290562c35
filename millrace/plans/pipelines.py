"""Whole recipes as tables: what each training stage of a recipe reads, built from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dataset, preference, render

#: Comparisons that the policy is held against its reference on.
EVALUATION_PAIRS = 256


def preference_recipe(conversations: DataFrame, comparisons: tuple[DataFrame, DataFrame], key: str, template: str, players: DataFrame, chunk: int = 4, max_length: int | None = None) -> dict[str, DataFrame]:
    """The tables of preference learning in three stages: sft, reward_model, matches, evaluation.

    Conversations with every assistant message trained on; labelled comparisons cut after the
    label's first token; matches both ways of a policy's completions (``players``: group_id, idx) within chunks; and for evaluation what the
    reward model is asked about at most EVALUATION_PAIRS test pairs, in either order.
    """
    train, test = comparisons
    parts = render.pieces(conversations, template, "all_assistant_messages")
    sft = conversations.select("conv_id", render.byte_stats(parts, max_length).alias("s")).select("conv_id", "s.*")
    held_out = dataset.sample_rows(test, key, EVALUATION_PAIRS, 0)
    asked = preference.preference_prompts(dataset.both_orders(held_out, "completion_a", "completion_b", "label").withColumn("_id", F.struct(key, "swapped")), "_id", template)
    return {
        "sft": sft,
        "reward_model": preference.reward_model_examples(train, key, template),
        "matches": preference.matchups(players, "group_id", chunk, both_ways=True),
        "evaluation": asked.select(f"_id.{key}", "_id.swapped", "prompt"),
    }
