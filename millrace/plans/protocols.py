"""Extension points: what a caller can plug in, and offline stand-ins for the remote ones."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from functools import reduce
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Preprocessor = Callable[[Column], Column]
Grader = Callable[[Column, Column], Column]


class Environment(Protocol):
    """Prompts for problems, and rewards for what was said to them."""

    def prompts(self, problems: DataFrame) -> DataFrame: ...

    def graded(self, responses: DataFrame) -> DataFrame: ...


class ProblemSet(Protocol):
    """Train and test problems by name."""

    def __call__(self) -> tuple[DataFrame, DataFrame | None]: ...


class Completer(Protocol):
    """Adds completions to prompts: tokens and their log-probabilities."""

    def complete(self, prompts: DataFrame) -> DataFrame: ...


class Evaluator(Protocol):
    """(key, value) metrics of a table of responses."""

    def __call__(self, responses: DataFrame) -> DataFrame: ...


class Tool(Protocol):
    """Adds the result of a tool to rows of calls."""

    def invoke(self, calls: DataFrame) -> DataFrame: ...


class Logger(Protocol):
    """Takes metrics, configurations and long texts."""

    def log_metrics(self, metrics: DataFrame) -> None: ...

    def log_config(self, config: Any) -> None: ...

    def log_long_text(self, key: str, texts: DataFrame) -> None: ...

    def sync(self) -> None: ...

    def location(self) -> str: ...

    def close(self) -> None: ...


class TableCompleter:
    """Completions that were made before, looked up by prompt; a prompt without one gets none. Reading log-probabilities that are missing is an error."""

    def __init__(self, known: DataFrame, prompt: str = "prompt"):
        self.known, self.prompt = known, prompt

    def complete(self, prompts: DataFrame) -> DataFrame:
        return prompts.join(self.known, self.prompt, "left")

    @staticmethod
    def logprobs(column: str = "logprobs") -> Column:
        return F.coalesce(F.col(column), F.raise_error(F.lit("completion without log-probabilities")).cast("array<double>"))


class TableTool:
    """A search tool whose results are a table (query, documents)."""

    def __init__(self, results: DataFrame):
        self.results = results

    def invoke(self, calls: DataFrame) -> DataFrame:
        return calls.join(self.results, "query", "left").withColumn("documents", F.coalesce("documents", F.array().cast("array<string>")))


class FileLogger:
    """A logger that appends metrics to a folder of JSON lines, and long texts beside them.

    ``run`` names the run among those that log to the folder. Its texts are numbered: a run that is started again and logs them again leaves one copy of each.
    """

    def __init__(self, path: str, run: str = "run"):
        self.path, self.run, self.config, self.open, self.texts_logged = path, run, None, True, 0

    def _check(self) -> None:
        if not self.open:
            raise ValueError("the logger is closed")

    def log_metrics(self, metrics: DataFrame) -> None:
        from ..sources.writers import write_metrics

        self._check()
        write_metrics(metrics, self.path)

    def log_config(self, config: Any) -> None:
        from ..sources.writers import config_json

        self.config = config_json(config)

    def log_long_text(self, key: str, texts: DataFrame) -> None:
        """Append rows (step, text) under a key."""
        from ..sources.appended import append_once

        self._check()
        append_once(texts.select(F.lit(key).alias("key"), "step", "text"), f"{self.path}/_texts", f"{self.run}-{self.texts_logged:09d}")
        self.texts_logged += 1

    def long_texts(self, spark) -> DataFrame:
        """(key, step, text) of all runs."""
        from ..sources.appended import read_appended

        return read_appended(spark, f"{self.path}/_texts", "key string, step long, text string").drop("batch")

    def sync(self) -> None:
        """Everything logged is written when a call returns: nothing waits."""
        self._check()

    def location(self) -> str:
        """Where the logs can be looked at."""
        return self.path

    def close(self) -> None:
        self.open = False


def evaluated(responses: DataFrame, evaluators: dict[str, Evaluator]) -> DataFrame:
    """(key, value) of several evaluators, each key under its evaluator's name."""
    parts = [e(responses).select(F.concat(F.lit(f"{name}/"), "key").alias("key"), F.col("value").cast("double").alias("value")) for name, e in evaluators.items()]
    return reduce(DataFrame.unionByName, parts)


def graded_with(responses: DataFrame, grader: Grader, response: str, target: str) -> DataFrame:
    """Adds correct: what any grader of two columns says."""
    return responses.withColumn("correct", F.coalesce(grader(F.col(response), F.col(target)), F.lit(False)))


def lookup(name: str) -> Any:
    """What ``module:name`` names."""
    module, _, attribute = name.partition(":")
    if not module or not attribute:
        raise ValueError(f"not of the form module:name: {name}")
    return reduce(getattr, attribute.split("."), importlib.import_module(module))


def rolled_out_with(strategy: Callable[[DataFrame], DataFrame], problems: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Rollouts of problems by a strategy that the caller names; one that doesn't give the columns is an error."""
    out = strategy(problems)
    if lacking := [c for c in columns if c not in out.columns]:
        raise ValueError(f"rollouts without {', '.join(lacking)}")
    return out
