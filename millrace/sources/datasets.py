"""Named datasets as tables: problems with answers, coding tasks, and labelled comparisons.

A dataset lies under a root folder as ``<dataset>/<config>/<split>``, Parquet; ``Source``
reads one split. Each loader gives (train, test), test None where there is none. Rows that
can't be used go, as they do in the mappers.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grade, text
from ..operators import dataset, preference

#: Configurations of the competition problems, and of the coding tasks by split. Fixed values.
MATH_CONFIGS = ("algebra", "counting_and_probability", "geometry", "intermediate_algebra", "number_theory", "prealgebra", "precalculus")
CODE_CONFIGS = {"train": ("primeintellect", "taco", "lcbv5"), "test": ("codeforces", "lcbv5")}
Pair = tuple[DataFrame, DataFrame | None]


class Source:
    """Reads splits of datasets under a root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def read(self, name: str, config: str, split: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}/{config}/{split}")


def concatenated(*parts: DataFrame) -> DataFrame:
    """All rows of several tables, columns by name; repeated rows stay."""
    return reduce(DataFrame.unionByName, parts)


def non_empty(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which none of the columns is null or ''."""
    return df.where(reduce(lambda a, b: a & b, [F.coalesce(F.col(c), F.lit("")) != "" for c in columns]))


def _problems(df: DataFrame, problem: str, answer: str, name: str) -> DataFrame:
    return non_empty(df.select(F.col(problem).alias("problem"), F.col(answer).alias("answer"), F.lit(name).alias("dataset")), "problem", "answer")


def competition_problems(source: Source) -> Pair:
    """All configurations and splits without the held-out problems; the boxed answer of the solution, rows without one go."""
    held_out = source.read("math_held_out", "default", "test")
    parts = [source.read("math", c, s).select("problem", "solution") for c in MATH_CONFIGS for s in ("train", "test")]
    answered = lambda df: _problems(df.withColumn("answer", grade.extract_boxed("solution")), "problem", "answer", "math")
    return answered(dataset.without(concatenated(*parts), held_out, "problem")), answered(held_out)


def word_problems(source: Source) -> Pair:
    """Grade-school problems: the answer stands after ####."""
    def answered(split: str) -> DataFrame:
        return _problems(source.read("gsm8k", "main", split).withColumn("final", text.gsm8k_answer("answer")), "question", "final", "gsm8k")

    return answered("train"), answered("test")


def polaris_problems(source: Source) -> Pair:
    return _problems(source.read("polaris", "default", "train"), "problem", "answer", "polaris"), None


def deepmath_problems(source: Source) -> Pair:
    return _problems(source.read("deepmath", "default", "train"), "question", "final_answer", "deepmath"), None


def coding_tasks(source: Source) -> Pair:
    """Coding tasks of several configurations with their prompt; those without a question go."""
    def tasks(split: str) -> DataFrame:
        parts = [source.read("deepcoder", c, split) for c in CODE_CONFIGS[split]]
        both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        asked = [c for c in ("question", "prompt", "problem") if c in both.columns]
        starter = F.col("starter_code") if "starter_code" in both.columns else F.lit(None).cast("string")
        return both.withColumn("question", text.first_filled(*asked)).where("question IS NOT NULL").withColumn("prompt", text.code_prompt("question", starter))

    return tasks("train"), tasks("test")


PROBLEMS: dict[str, Callable[[Source], Pair]] = {"math": competition_problems, "gsm8k": word_problems, "polaris": polaris_problems, "deepmath": deepmath_problems, "deepcoder": coding_tasks}


def problems(source: Source, name: str) -> Pair:
    if name not in PROBLEMS:
        raise ValueError(f"unknown dataset: {name}")
    return PROBLEMS[name](source)


def _halves(df: DataFrame, key: str, test: int, seed: int = 0) -> Pair:
    marked = dataset.train_test_split(df, key, seed, test)
    return marked.where("split = 'train'").drop("split", "rn"), marked.where("split = 'test'").drop("split", "rn")


def hhh(source: Source, test: int = 1024) -> Pair:
    own = source.read("hhh", "default", "test")
    return preference.hhh_comparisons(source.read("hhh", "default", "train")), preference.hhh_comparisons(dataset.sample_rows(own, "id", test, 0))


def helpsteer3(source: Source, test: int = 1024) -> Pair:
    def mapped(df: DataFrame) -> DataFrame:
        one = lambda c: F.array(preference.message("assistant", c))
        return preference.rated_comparisons(df).withColumns({"prompt_conversation": F.col("context"), "completion_a": one("response1"), "completion_b": one("response2")})

    return mapped(source.read("helpsteer3", "preference", "train")), mapped(dataset.sample_rows(source.read("helpsteer3", "preference", "validation"), "id", test, 0))


def ultrafeedback(source: Source, test: int = 1024) -> Pair:
    train, held = _halves(source.read("ultrafeedback", "default", "train"), "id", test)
    return tuple(preference.chosen_rejected(x, "instruction", F.col("chosen_response"), F.col("rejected_response")) for x in (train, held))


def tulu(source: Source, test: int = 1024) -> Pair:
    """The second message of either conversation is the completion."""
    second = lambda c: F.try_element_at(F.col(c), F.lit(2))["content"]
    return tuple(preference.chosen_rejected(x, "prompt", second("chosen"), second("rejected")) for x in _halves(source.read("tulu_preference", "default", "train"), "id", test))


def arena(source: Source, test: int = 1024) -> Pair:
    return tuple(preference.arena_comparisons(x) for x in _halves(source.read("arena", "default", "train"), "id", test))


def helpsteer2(source: Source) -> Pair:
    """Best against worst response of each prompt; a tenth of the prompts, 1024 at most, is test."""
    pairs = preference.best_and_worst(source.read("helpsteer2", "default", "train"), "prompt", "response", "helpfulness", "id")
    marked = dataset.train_test_split(pairs, "prompt", 0)
    both = preference.chosen_rejected(marked, "prompt", F.col("chosen"), F.col("rejected"))
    return both.where("split = 'train'").drop("split", "rn"), both.where("split = 'test'").drop("split", "rn")


COMPARISONS: dict[str, Callable[..., Pair]] = {"hhh": hhh, "helpsteer3": helpsteer3, "ultrafeedback": ultrafeedback, "tulu": tulu, "arena": arena, "helpsteer2": helpsteer2}
#: Those that preference optimisation is offered with.
PREFERENCE_OPTIMISATION = ("hhh", "helpsteer3", "ultrafeedback")


def comparisons(source: Source, name: str, offered: tuple[str, ...] = tuple(COMPARISONS), **options) -> Pair:
    if name not in offered:
        raise ValueError(f"unknown dataset: {name}")
    return COMPARISONS[name](source, **options)


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table given in the program."""
    return spark.createDataFrame(rows, schema)


def environment_rows(df: DataFrame) -> DataFrame:
    """prompt, example_id, task, answer ('' where there is none) and info (an empty map) of an environment's dataset."""
    answer = F.coalesce("answer", F.lit("")) if "answer" in df.columns else F.lit("")
    empty = F.create_map().cast("map<string,string>")
    info = F.coalesce("info", empty) if "info" in df.columns else empty
    return df.select("prompt", "example_id", "task", answer.alias("answer"), info.alias("info"))


def checked_embeddings(df: DataFrame, size: int, vector: str = "embedding", of: str | None = None) -> DataFrame:
    """Rows whose text (``of``) isn't blank; a vector that is missing or of another length is an error."""
    from ..functions.text import strip

    own = df if of is None else df.where(strip(of) != "")
    wrong = F.raise_error(F.concat(F.lit("embedding of length "), F.coalesce(F.size(vector), F.lit(-1)).cast("string"))).cast(df.schema[vector].dataType)
    return own.withColumn(vector, F.when(F.size(vector) == size, F.col(vector)).otherwise(wrong))
