"""Parameter counts and the table of models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Organisation, model, version, size, whether it is a chat model.
MODELS = [
    ("meta-llama", "Llama-3.2-1B-Instruct", "3.2", "1B", True),
    ("meta-llama", "Llama-3.2-3B-Instruct", "3.2", "3B", True),
    ("meta-llama", "Llama-3.1-8B-Instruct", "3.1", "8B", True),
    ("meta-llama", "Llama-3.2-1B", "3.2", "1B", False),
    ("meta-llama", "Llama-3.2-3B", "3.2", "3B", False),
    ("meta-llama", "Llama-3.1-8B", "3.1", "8B", False),
    ("meta-llama", "Llama-3.1-70B", "3.1", "70B", False),
    ("meta-llama", "Llama-3.3-70B-Instruct", "3.3", "70B", True),
    ("Qwen", "Qwen3-4B-Base", "3", "4B", False),
    ("Qwen", "Qwen3-8B-Base", "3", "8B", False),
    ("Qwen", "Qwen3-14B-Base", "3", "14B", False),
    ("Qwen", "Qwen3-30B-A3B-Base", "3", "30B-A3B", False),
    ("Qwen", "Qwen3-0.6B", "3", "0.6B", True),
    ("Qwen", "Qwen3-1.7B", "3", "1.7B", True),
    ("Qwen", "Qwen3-4B", "3", "4B", True),
    ("Qwen", "Qwen3-8B", "3", "8B", True),
    ("Qwen", "Qwen3-14B", "3", "14B", True),
    ("Qwen", "Qwen3-32B", "3", "32B", True),
    ("Qwen", "Qwen3-30B-A3B", "3", "30B-A3B", True),
    ("Qwen", "Qwen3-4B-Instruct-2507", "3", "4B", True),
    ("Qwen", "Qwen3-30B-A3B-Instruct-2507", "3", "30B-A3B", True),
    ("Qwen", "Qwen3-235B-A22B-Instruct-2507", "3", "235B-A22B", True),
    ("deepseek-ai", "DeepSeek-V3.1", "3", "671B-A37B", True),
    ("deepseek-ai", "DeepSeek-V3.1-Base", "3", "671B-A37B", False),
    ("openai", "gpt-oss-20b", "1", "21B-A3.6B", True),
    ("openai", "gpt-oss-120b", "1", "117B-A5.1B", True),
]
#: Name segments of weights that adapters leave out. Fixed value.
NOT_ADAPTED = ["gate", "embed_tokens", "q_b_proj", "kv_b_proj"]


def models(spark: SparkSession) -> DataFrame:
    """organization, model, version, size, is_chat, and the templates meant for the model, best first."""
    table = spark.createDataFrame(MODELS, "organization string, model string, version string, size string, is_chat boolean")
    org, name = F.col("organization"), F.col("model")
    fit = (
        F.when(~F.col("is_chat"), F.array(F.lit("role_colon")))
        .when(org == "meta-llama", F.array(F.lit("llama3")))
        .when((org == "Qwen") & name.contains("-Instruct"), F.array(F.lit("qwen3_instruct")))
        .when(org == "Qwen", F.array(F.lit("qwen3"), F.lit("qwen3_disable_thinking")))
        .when(org == "deepseek-ai", F.array(F.lit("deepseekv3_disable_thinking"), F.lit("deepseekv3")))
        .when(org == "openai", F.array(F.lit("gpt_oss_no_sysprompt"), F.lit("gpt_oss_medium_reasoning")))
    )
    return table.withColumn("templates", fit)


def with_models(df: DataFrame, model: str = "model_name") -> DataFrame:
    """Rows with their model's attributes by full name; the table of models is a constant, so it is broadcast."""
    table = models(df.sparkSession).withColumn(model, F.concat_ws("/", "organization", "model"))
    return df.join(F.broadcast(table.drop("model")), model, "left")


def lora_parameters(shapes: DataFrame, rank: int = 32, experts: bool = True, shared_outer: bool = True, by: list[str] | None = None) -> DataFrame:
    """Adapter parameters from (name, shape): expert_params, non_expert_params, total_params.

    Two-dimensional weights count the sum of both sides, times the rank. Of experts that
    share their outer side, each counts its inner side and the first also the outer.
    """
    parts = F.split("name", r"\.")
    left_out = NOT_ADAPTED if experts else [*NOT_ADAPTED, "experts"]
    use = (F.size("shape") == 2) & F.col("name").endswith(".weight") & ~F.arrays_overlap(parts, F.array(*[F.lit(x) for x in left_out]))
    at = F.array_position(parts, F.lit("experts")).cast("int")
    expert = (at > 0) & F.lit(shared_outer)
    number, kind = F.try_element_at(parts, at + 1).try_cast("int"), F.try_element_at(parts, at + 2)
    a, b = F.element_at("shape", 1), F.element_at("shape", 2)
    inner = F.when(kind == "down_proj", b).otherwise(a)
    outer = F.when(kind == "down_proj", a).otherwise(b)
    known = F.when(kind.isin("gate_proj", "down_proj", "up_proj"), inner + F.when(number == 0, outer).otherwise(0)).otherwise(F.raise_error(F.concat(F.lit("unexpected expert weight: "), kind)).cast("bigint"))
    sums = shapes.where(use).groupBy(*(by or [])).agg(F.coalesce(F.sum(F.when(expert, known)), F.lit(0)).alias("e"), F.coalesce(F.sum(F.when(~expert, a + b)), F.lit(0)).alias("d"))
    return sums.select(*(by or []), (F.col("e") * rank).alias("expert_params"), (F.col("d") * rank).alias("non_expert_params"), ((F.col("e") + F.col("d")) * rank).alias("total_params"))


def full_parameters(shapes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """All parameters, and the learning rate multiplier: one over their root."""
    size = F.aggregate("shape", F.lit(1.0), lambda p, x: p * x)
    return shapes.groupBy(*(by or [])).agg(F.sum(size).alias("params")).withColumn("lr_multiplier", 1.0 / F.sqrt("params"))
