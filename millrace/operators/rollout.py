"""Rollouts turn by turn: the prompts of all live episodes meet completions and tool results, finished ones leave, until none is left.

A round is a few joins over the frontier of live episodes. What it made is written before the next one begins, so rounds don't pile up in one
plan, a lost executor costs tasks of one round, and a run that was stopped goes on with the first round that isn't whole.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from .environment import graded_answers

Completer = Callable[[DataFrame], DataFrame]


class TurnEnvironment(Protocol):
    """How episodes begin and what follows a completion. Columns of its own travel with an episode."""

    def start(self, episodes: DataFrame) -> DataFrame:
        """Adds prompt, and what the environment remembers."""
        ...

    def step(self, rows: DataFrame) -> DataFrame:
        """Adds reward, done and observation to rows with prompt, turn (from 0) and what the completer added; may change what is remembered."""
        ...


def completed_from(known: DataFrame, on: list[str]) -> Completer:
    """Completions that were made before: ``known`` has the columns ``on`` (prompt, say, or an episode's id and turn), unique, and completion.

    A row without one gets null.
    """
    return lambda rows: rows.join(known, on, "left")


class TurnRollouts:
    """Rolls out episodes under ``path``, a folder of its own.

    An episode whose prompt has no completion ends there, unanswered: null completion, reward 0. Turns are not bounded but by the environment. With ``most`` no more than so many
    rounds are done in one call; the next goes on.
    """

    def __init__(self, path: str, completer: Completer, environment: TurnEnvironment, most: int | None = None):
        self.path, self.completer, self.environment, self.most = path, completer, environment, most

    def _round(self, k: int) -> str:
        return f"{self.path}/steps/round={k}"

    def _whole(self, spark: SparkSession, k: int) -> bool:
        mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self._round(k)}/_SUCCESS")
        return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)

    def _step(self, rows: DataFrame) -> DataFrame:
        out = self.environment.step(self.completer(rows))
        silent = F.col("completion").isNull()
        return out.withColumns({"reward": F.when(silent, 0.0).otherwise(F.col("reward").cast("double")), "done": silent | F.coalesce("done", F.lit(False)), "observation": F.when(~silent, F.col("observation")), "unanswered": silent})

    def run(self, episodes: DataFrame) -> DataFrame:
        """(what episodes have, turn, prompt, completion, reward, done, observation, unanswered, ...): a row for each turn of each episode."""
        spark, k, made = episodes.sparkSession, 0, 0
        first = self.environment.start(episodes).withColumn("turn", F.lit(0))
        names, schema = first.columns, None
        while self.most is None or made < self.most:
            if not self._whole(spark, k):
                if k:
                    before = spark.read.parquet(self._round(k - 1)).where("NOT done")
                    rows = before.withColumns({"prompt": F.concat("prompt", "completion", F.coalesce("observation", F.lit(""))), "turn": F.col("turn") + 1}).select(names)
                else:
                    rows = first
                self._step(rows).write.mode("overwrite").parquet(self._round(k))
                made += 1
            own = spark.read.parquet(self._round(k))
            schema = own.schema
            k += 1
            if own.where("NOT done").isEmpty():
                break
        steps = spark.read if schema is None else spark.read.schema(schema)
        return steps.parquet(*[self._round(j) for j in range(k)])

    def live(self, spark: SparkSession) -> int:
        """Episodes that wait for their next turn."""
        k = 0
        while self._whole(spark, k):
            k += 1
        return spark.read.parquet(self._round(k - 1)).where("NOT done").count() if k else 0


class ConversationTurns:
    """Conversations gone through again: an episode's prompt is what stands before its first assistant turn; what users say next follows from a table.

    ``replies`` has ``episode`` (columns of an episode's id), turn (from 0, of the completion that is replied to), observation, and last: whether nothing is asked after it.
    """

    def __init__(self, replies: DataFrame, episode: list[str]):
        self.replies, self.episode = replies, episode

    def start(self, episodes: DataFrame) -> DataFrame:
        return episodes

    def step(self, rows: DataFrame) -> DataFrame:
        out = rows.join(self.replies, [*self.episode, "turn"], "left")
        return out.withColumns({"reward": F.lit(0.0), "done": F.coalesce("last", F.lit(True))}).drop("last")


class NumberGame:
    """A number is to be guessed: the answer to a guess is 'Correct', 'Too low' or 'Too high'; a turn without a number costs ``malformed``. ``gold`` travels with the episode."""

    def __init__(self, gold: str = "gold", most: int = 10, malformed: float = -1.0):
        self.gold, self.most, self.malformed = gold, most, malformed

    def start(self, episodes: DataFrame) -> DataFrame:
        return episodes.withColumn("prompt", F.lit("Guess the number.\n"))

    def step(self, rows: DataFrame) -> DataFrame:
        said = text.guess_feedback("completion", self.gold)
        won = F.coalesce(said == "Correct", F.lit(False))
        score = F.when(won, 1.0).when(said.isNull(), self.malformed).otherwise(0.0)
        return rows.withColumns({"reward": score, "done": won | (F.col("turn") + 1 >= self.most), "observation": F.concat(F.lit("\n"), F.coalesce(said, F.lit("Invalid guess")), F.lit("\n"))})


class SearchTurns:
    """A question, searches, and an answer: completions have content (completion), tools (names called, null without calls), query and parsed; results are a table (query, documents).

    An episode ends with its first answer or failure: an empty list of calls, another tool, one call too many, a query without results, a prompt
    of over ``most_tokens`` (as ``tokens`` counts them; by default bytes). A failure gives no metrics and no reward. question and gold travel with the episode, calls is counted.
    """

    def __init__(self, results: DataFrame, most_calls: int = 4, most_tokens: int = 32 * 1024, coefficient: float = 0.1, tokens: Callable[[Column], Column] = F.octet_length):
        self.results, self.most_calls, self.most_tokens, self.coefficient, self.tokens = results, most_calls, most_tokens, coefficient, tokens

    def start(self, episodes: DataFrame) -> DataFrame:
        return episodes.withColumns({"prompt": F.concat("question", F.lit("\n")), "calls": F.lit(0)})

    def step(self, rows: DataFrame) -> DataFrame:
        asked = rows.join(self.results, "query", "left")
        called = F.col("tools").isNotNull()
        search = F.coalesce(F.try_element_at("tools", F.lit(1)) == "search", F.lit(False))
        found = F.concat(F.lit("\n"), F.array_join("documents", "\n"), F.lit("\n"))
        asked = asked.withColumns({"calls": F.col("calls") + search.cast("int"), "observation": F.when(called & search, found)})
        long = self.tokens(F.concat("prompt", "completion", F.coalesce("observation", F.lit("")))) > self.most_tokens
        lost = called & (~search | (F.col("calls") > self.most_calls) | F.col("documents").isNull() | long)
        out = graded_answers(asked.drop("reward", "format", "correct"), "completion", "gold", F.col("parsed"), self.coefficient)
        answered = ~called
        of = lambda c: F.when(answered, F.col(c))
        return out.withColumns({"failed": lost, "done": answered | lost, "format": of("format"), "correct": of("correct"), "reward": F.when(answered, F.col("reward")).otherwise(0.0)}).drop("documents", "given")


def episodes_of(steps: DataFrame, by: list[str]) -> DataFrame:
    """One row for each episode: by, turns, total_reward, final_prompt, unanswered."""
    last = F.max_by(F.struct("prompt", "unanswered"), "turn")
    own = steps.groupBy(*by).agg(F.count("*").alias("turns"), F.sum("reward").alias("total_reward"), last.alias("_last"))
    return own.select(*by, "turns", "total_reward", F.col("_last.prompt").alias("final_prompt"), F.col("_last.unanswered").alias("unanswered"))
