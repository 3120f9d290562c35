"""Environments over logged actions: grading, games, tool use, group rewards.

The model's part is a column: what it said at each turn. An episode is replayed from its
turns by windows and aggregates; nothing is generated and no code is run.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import grade, text
from ..functions.numbers import shaped_reward
from ..functions.text import _col
from . import render

# What is added to a problem, and the example shown before it.
BOXED_SUFFIX = " Write your answer in \\boxed{} format."
WORD_SUFFIX = " Provide a numerical answer without units, written inside \\boxed{}."
EXAMPLE = (
    ("user", "How many r's are in strawberry?" + BOXED_SUFFIX),
    ("assistant", "Let's spell the word out and number all the letters: 1) s 2) t 3) r 4) a 5) w 6) b 7) e 8) r 9) r 10) y. We have r's at positions 3, 8, and 9. \\boxed{3}"),
)


def problem_messages(problem: Column | str, suffix: str = BOXED_SUFFIX, example: tuple = EXAMPLE) -> Column:
    """The example turns, then the problem with its suffix, as messages."""
    turns = [*[(r, F.lit(c)) for r, c in example], ("user", F.concat(_col(problem), F.lit(suffix)))]
    return F.array(*[F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in turns])


def problem_prompts(problems: DataFrame, template: str, problem: str = "problem", **options) -> DataFrame:
    """Adds prompt: what the model is asked, in its template."""
    own = problems.withColumn("_messages", problem_messages(problem, **options))
    return own.withColumn("prompt", render.generation_prompt(own, template, messages="_messages")).drop("_messages")


def graded(rows: DataFrame, well_formed: Column, correct: Column, parsed: Column | None = None, coefficient: float = 0.1) -> DataFrame:
    """Adds format, correct and reward: one for a right answer, less ``coefficient`` where the form is wrong."""
    ok = well_formed if parsed is None else well_formed & parsed
    number = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    own = rows.withColumns({"format": number(ok), "correct": number(correct)})
    return own.withColumn("reward", shaped_reward("correct", "format", coefficient))


def graded_math(rows: DataFrame, response: str, answer: str, parsed: Column | None = None, coefficient: float = 0.1) -> DataFrame:
    """Responses whose boxed answer is held against the reference; adds given."""
    own = rows.withColumn("given", grade.extract_boxed(response))
    return graded(own, F.col("given").isNotNull(), grade.grade_answer("given", answer), parsed, coefficient)


def graded_code(rows: DataFrame, response: str, passed: Column | str, parsed: Column | None = None, coefficient: float = 0.1) -> DataFrame:
    """Responses with a code block; whether it passes its tests is a column, since generated code isn't run here."""
    block = text.last_code_block(response)
    return graded(rows, block.isNotNull(), block.isNotNull() & _col(passed), parsed, coefficient)


def test_timeout(seconds: Column | str | int, tests: Column | str) -> Column:
    """Seconds that a sandbox gets for all tests: one more than each may take, and five."""
    each = F.lit(seconds) if isinstance(seconds, int) else _col(seconds)
    return (each + 1) * F.size(_col(tests)) + 5


def graded_answers(rows: DataFrame, response: str, gold: str, parsed: Column | None = None, coefficient: float = 0.1) -> DataFrame:
    """Responses with one 'Answer:' whose normalised text is a gold answer's."""
    given = text.single_answer(response)
    return graded(rows.withColumn("given", given), F.col("given").isNotNull(), text.matches_any("given", gold), parsed, coefficient)


def search_episodes(turns: DataFrame, by: list[str], most_calls: int = 4, most_tokens: int = 32 * 1024, coefficient: float = 0.1) -> DataFrame:
    """Episodes of a search environment, replayed: by, turns, calls, failed, format, correct, reward.

    ``turns`` has turn, content, parsed, tools (names called, null if the message has no
    calls), tool_ok, next_tokens (of the next observation) and gold. An episode ends with the first
    answer or failure: an empty list of calls, another tool, one call too many, a tool that
    fails, an observation too long. A failure has no metrics and reward 0; an episode that
    neither answers nor fails has none yet.
    """
    first_tool = F.try_element_at("tools", F.lit(1))
    search = F.coalesce(first_tool == "search", F.lit(False))
    so_far = Window.partitionBy(*by).orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    own = turns.withColumn("_calls", F.sum(search.cast("int")).over(so_far))
    lost = F.col("tools").isNotNull() & (~search | (F.col("_calls") > most_calls) | ~F.coalesce("tool_ok", F.lit(False)) | (F.coalesce("next_tokens", F.lit(0)) > most_tokens))
    own = graded_answers(own.withColumns({"_lost": lost, "_ends": lost | F.col("tools").isNull()}), "content", "gold", F.col("parsed"), coefficient)
    last = F.min_by(F.struct("_lost", "turn", "_calls", "format", "correct", "reward"), F.when(F.col("_ends"), F.col("turn")))
    ends = own.groupBy(*by).agg(last.alias("_end"), F.max("turn").alias("_turns"), F.max("_calls").alias("_all"))
    of = lambda c: F.when(~F.col("_end._lost"), F.col(f"_end.{c}"))
    first = F.col("_end").isNotNull()
    return ends.select(
        *by, (F.when(first, F.col("_end.turn")).otherwise(F.col("_turns")) + 1).cast("int").alias("turns"), F.when(first, F.col("_end._calls")).otherwise(F.col("_all")).cast("int").alias("calls"),
        F.coalesce("_end._lost", F.lit(False)).alias("failed"), of("format").alias("format"), of("correct").alias("correct"), F.when(F.col("_end._lost"), 0.0).otherwise(F.col("_end.reward")).alias("reward"),
    )


def guessing_games(turns: DataFrame, by: list[str], gold: str = "gold", most: int = 10, malformed: float = -1.0) -> DataFrame:
    """Number-guessing episodes from turns (turn from 1, content, gold): by, turns, won, reward.

    The answer to each guess is 'Correct', 'Too low' or 'Too high'; a turn without a number costs. An episode ends
    with a right guess or after ``most`` turns; the reward is the sum of its turns'.
    """
    said = text.guess_feedback("content", gold)
    score = F.when(said == "Correct", 1.0).when(said.isNull(), malformed).otherwise(0.0)
    before = Window.partitionBy(*by).orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    own = turns.where(F.col("turn") <= most).withColumn("_score", score)
    own = own.withColumn("_over", F.coalesce(F.max((F.col("_score") == 1.0).cast("int")).over(before), F.lit(0)) == 1).where("NOT _over")
    return own.groupBy(*by).agg(F.count("*").cast("int").alias("turns"), (F.max("_score") == 1.0).alias("won"), F.sum("_score").alias("reward"))


def word_games(turns: DataFrame, by: list[str], answer: str = "answer", most: int = 20) -> DataFrame:
    """Twenty questions: an episode is won by 'Guess: ' and the word, in any case."""
    from .trajectory import first_win

    won = F.coalesce(F.lower(text.guess("content")) == F.lower(F.col(answer)), F.lit(False))
    return first_win(turns, won, most, by)


def group_rewards(trajectories: DataFrame, reward: Column | Callable[[pd.DataFrame], pd.Series] | None = None, group: str = "group_id", order: str = "traj_idx") -> DataFrame:
    """Adds final_reward, what a group's members get for how they compare: zero, a (window) expression, or a function of the group.

    The function sees one group at a time as pandas, in the order of ``order``; groups are small.
    """
    own = trajectories.drop("final_reward")
    if reward is None or isinstance(reward, Column):
        return own.withColumn("final_reward", F.lit(0.0) if reward is None else reward.cast("double"))

    def each(members: pd.DataFrame) -> pd.DataFrame:
        members = members.sort_values(order)
        return members.assign(final_reward=reward(members).astype("float64"))

    return own.groupBy(group).applyInPandas(each, own.withColumn("final_reward", F.lit(0.0)).schema)


def rolled_out(transitions: DataFrame, trajectories: DataFrame, reward=None) -> DataFrame:
    """Trajectories with their group reward and total_reward: sampling has filled the transitions."""
    from .trajectory import total_rewards

    return total_rewards(transitions, group_rewards(trajectories, reward))


def states_to_rollouts(states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(transitions, trajectories) of another library's rollout states.

    ``states`` has group_id, traj_idx, trajectory (array of struct<tokens struct<prompt_ids, completion_ids,
    completion_logprobs>>), reward and metrics. A step without tokens is empty, a missing reward 0.
    """
    steps = states.select("group_id", "traj_idx", F.posexplode("trajectory").alias("step_idx", "s"), (F.size("trajectory") - 1).alias("_last"))
    get = lambda name, kind: F.coalesce(F.col("s.tokens")[name], F.array().cast(kind))
    transitions = steps.select(
        "group_id", "traj_idx", "step_idx", get("prompt_ids", "array<int>").alias("ob_tokens"), get("completion_ids", "array<int>").alias("ac_tokens"), get("completion_logprobs", "array<double>").alias("ac_logprobs"),
        F.lit(0.0).alias("reward"), (F.col("step_idx") == F.col("_last")).alias("done"),
    )
    empty = F.create_map().cast("map<string,double>")
    return transitions, states.select("group_id", "traj_idx", F.coalesce(F.col("reward").cast("double"), F.lit(0.0)).alias("final_reward"), F.coalesce("metrics", empty).alias("metrics"))


def turn_speeds(turns: DataFrame, by: list[str]) -> DataFrame:
    """Tokens a second of the first two turns (turn, tokens, seconds), and how much faster the second is, in percent."""
    own = turns.groupBy(*by).agg(*[F.sum(F.when(F.col("turn") == k, F.col(c))).alias(f"{c}_{k}") for k in (1, 2) for c in ("tokens", "seconds")])
    speed = lambda k: F.coalesce(F.when(F.col(f"seconds_{k}") > 0, F.col(f"tokens_{k}") / F.col(f"seconds_{k}")), F.lit(0.0))
    out = own.select(*by, speed(1).alias("speed_1"), speed(2).alias("speed_2"))
    return out.withColumn("faster_percent", F.when((F.col("speed_1") > 0) & (F.col("speed_2") > 0), (F.col("speed_2") / F.col("speed_1") - 1) * 100))
