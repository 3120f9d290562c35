"""Statistics of per-token log-probabilities, on arrays or on one row per token."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import discounted, regenerated, scattered, total, zipped_strictly
from ..functions.numbers import neg_log_sigmoid
from ..functions.text import _col


def weighted_nll(logprob: Column | str, weight: Column | str) -> Column:
    """An aggregate: minus the weighted mean; not a number if no weight is left."""
    lp, w = _col(logprob), _col(weight)
    return F.when(F.sum(w) == 0, F.lit(float("nan"))).otherwise(-F.try_divide(F.sum(lp * w), F.sum(w)))


def kl_sample_train(sampled: Column | str, trained: Column | str) -> list[Column]:
    """Aggregates over action tokens: kl_v1, kl_v2 and entropy."""
    d, s = _col(sampled) - _col(trained), _col(sampled)
    return [F.avg(d).alias("kl_v1"), (0.5 * F.avg(d * d)).alias("kl_v2"), (-F.avg(s)).alias("entropy")]


def penalised_advantages(rows: DataFrame, coefficient: float, gamma: float = 0.0, mean: DataFrame | None = None) -> DataFrame:
    """advantages plus coefficient * mask * (mean difference - difference), discounted if gamma > 0.

    ``rows`` has arrays logprobs, base_logprobs, mask, advantages. The mean is over all tokens
    of the mask; a caller that has the tokens one by one can give it (one row, kl_mean), which spares making the arrays twice. Adds kl_mean.
    """
    diff = F.zip_with(F.zip_with("logprobs", "base_logprobs", lambda a, b: a - b), "mask", lambda d, m: d * m)
    with_diff = rows.withColumn("_diff", diff)
    if mean is None:
        mean = with_diff.agg(F.try_divide(F.sum(total("_diff")), F.sum(total("mask"))).alias("kl_mean"))
    joined = with_diff.join(F.broadcast(mean), F.lit(True))
    add = F.zip_with("mask", "_diff", lambda m, d: coefficient * m * (F.col("kl_mean") - d))
    add = discounted(add, gamma) if gamma > 0 else add
    return joined.withColumn("advantages", F.zip_with("advantages", add, lambda a, x: a + x)).drop("_diff")


def teacher_advantages(rows: DataFrame, coefficient: float, gamma: float = 0.0, replace: bool = False) -> DataFrame:
    """advantages plus (or, if replaced, only) minus coefficient * mask * (logprobs - teacher_logprobs). Adds kl."""
    kl = F.zip_with(F.zip_with("logprobs", "teacher_logprobs", lambda a, b: a - b), "mask", lambda d, m: d * m)
    add = F.transform(kl, lambda x: -coefficient * x)
    add = discounted(add, gamma) if gamma > 0 else add
    return rows.withColumn("kl", total(kl)).withColumn("advantages", add if replace else F.zip_with("advantages", add, lambda a, x: a + x))


def spread_teacher(rows: DataFrame, skip_mismatch: bool = False) -> DataFrame:
    """teacher_logprobs of generated tokens, put at the mask's places. If their number differs they are zeros, or null if ``skip_mismatch``."""
    spread = scattered("teacher_generated", "mask")
    if skip_mismatch:
        spread = F.when(F.size(F.filter("mask", lambda m: m > 0.5)) == F.size("teacher_generated"), spread)
    return rows.withColumn("teacher_logprobs", spread)


def kl_by_group(tokens: DataFrame, kl: str, mask: str, by: str) -> DataFrame:
    """Mean KL of each group with unmasked tokens, and over all (null)."""
    return tokens.rollup(by).agg(F.sum(F.col(kl) * F.col(mask)).alias("_k"), F.sum(mask).alias("_m")).where(F.col("_m") > 0).select(by, (F.col("_k") / F.col("_m")).alias("kl"))


def mean_kl(kl: Column | str, mask: Column | str) -> Column:
    """An aggregate: summed KL over unmasked tokens, one at least."""
    return F.sum(_col(kl)) / F.greatest(F.sum(_col(mask)), F.lit(1.0))


def dpo_metrics(pairs: DataFrame, beta: float) -> DataFrame:
    """Loss, accuracy, margin and rewards of pairs with columns chosen and rejected: log-ratios to the reference. The margin has beta twice."""
    c, r = F.col("chosen"), F.col("rejected")
    return pairs.agg(
        F.avg(neg_log_sigmoid(beta * (c - r))).alias("dpo_loss"), F.avg(F.when(c > r, 1.0).otherwise(0.0)).alias("accuracy"),
        (beta * F.avg(beta * c - beta * r)).alias("margin"), F.avg(beta * c).alias("chosen_reward"), F.avg(beta * r).alias("rejected_reward"),
    )


def agreement(a: Column | str, b: Column | str) -> list[Column]:
    """Aggregates: mean and largest absolute difference, mean squared difference."""
    d = _col(a) - _col(b)
    return [F.avg(F.abs(d)).alias("mean_abs"), F.max(F.abs(d)).alias("max_abs"), F.avg(d * d).alias("mse")]


def surrogate_losses(rows: DataFrame) -> DataFrame:
    """Offline values of the service's losses: importance sampling sum(exp(new - old) * advantage), and weighted cross-entropy."""
    ratio = F.zip_with(F.zip_with("new_logprobs", "logprobs", lambda a, b: F.exp(a - b)), "advantages", lambda r, a: r * a)
    return rows.withColumn("importance", total(ratio)).withColumn("cross_entropy", -total(F.zip_with("new_logprobs", "mask", lambda a, m: a * m)))


def token_report(rows: DataFrame, key: str) -> DataFrame:
    """A row per token: position, whether generated or prompt, and the masked difference of student and teacher."""
    each = rows.select(key, F.posexplode(F.arrays_zip("logprobs", "teacher_logprobs", "mask")).alias("position", "t"))
    return each.select(key, "position", F.when(F.col("t.mask") > 0, "GEN").otherwise("PROMPT").alias("part"), ((F.col("t.logprobs") - F.col("t.teacher_logprobs")) * F.col("t.mask")).alias("kl"))


def token_report_totals(report: DataFrame, key: str) -> DataFrame:
    """total and average KL of each key of a ``token_report``; the average is over generated tokens, one at least."""
    generated = F.sum((F.col("part") == "GEN").cast("int"))
    return report.groupBy(key).agg(F.sum("kl").alias("total_kl"), (F.sum("kl") / F.greatest(generated, F.lit(1))).alias("mean_kl"), generated.cast("bigint").alias("n_generated"))


def mean_difference(tokens: DataFrame, a: str, b: str, mask: str) -> DataFrame:
    """One row, kl_mean: the masked mean of a - b over a row per token."""
    return tokens.agg(F.try_divide(F.sum((F.col(a) - F.col(b)) * F.col(mask)), F.sum(mask)).alias("kl_mean"))


def update_kl(rows: DataFrame) -> DataFrame:
    """kl_v1 and kl_v2 between the policy before and after an update, over action tokens.

    ``rows`` has arrays logprobs (of targets), mask, and new_logprobs of the whole sequence, whose first
    token has none before it and is left out; other lengths are an error.
    """
    new = F.slice("new_logprobs", F.lit(2), F.greatest(F.size("new_logprobs") - 1, F.lit(0)))
    pairs = zipped_strictly(zipped_strictly("logprobs", new), "mask")
    each = rows.select(F.explode(pairs).alias("t")).where("t.b > 0").select((F.col("t.a.a") - F.col("t.a.b")).alias("d"))
    return each.agg(F.avg("d").alias("kl_v1"), (0.5 * F.avg(F.col("d") * F.col("d"))).alias("kl_v2"))


def with_teachers(datums: DataFrame, groups: DataFrame, teachers: DataFrame) -> DataFrame:
    """Training rows with their teacher: by group to the dataset it came from, and by dataset to its teacher.

    ``datums`` has group_id, ``groups`` group_id and dataset_idx, ``teachers`` dataset_idx. The table of teachers is a few rows, so it is broadcast.
    """
    return datums.join(groups.select("group_id", "dataset_idx"), "group_id").join(F.broadcast(teachers), "dataset_idx")


def with_teacher_prompts(datums: DataFrame, environments: DataFrame) -> DataFrame:
    """Training rows with the prompt that the teacher sees: by the trajectory's environment. teacher_tokens is that prompt and what was generated."""
    own = datums.join(environments.select("group_id", "traj_idx", "teacher_prompt"), ["group_id", "traj_idx"])
    return own.withColumn("teacher_tokens", regenerated("teacher_prompt", "target_tokens", "mask"))


def temperature_agreement(base: DataFrame, tempered: DataFrame, tau: float, by: list[str]) -> DataFrame:
    """How well log-probabilities at temperature tau keep the differences of those at one, divided by tau.

    Both tables have the keys, token and logprob. Of tokens that both have, all pairs are compared: tokens,
    pairs, mean_abs and max_abs, null where there is no pair. The tokens of a key are a vocabulary's most likely ones.
    """
    both = base.select(*by, "token", F.col("logprob").alias("x")).join(tempered.select(*by, "token", F.col("logprob").alias("y")), [*by, "token"])
    one = both.select(*by, *[F.col(c).alias(f"{c}_i") for c in ("token", "x", "y")])
    pairs = one.join(both, by).where("token_i < token").select(*by, F.abs((F.col("y_i") - F.col("y")) - (F.col("x_i") - F.col("x")) / max(tau, 1e-9)).alias("e"))
    errors = pairs.groupBy(*by).agg(F.count("*").alias("pairs"), F.avg("e").alias("mean_abs"), F.max("e").alias("max_abs"))
    return both.groupBy(*by).agg(F.count("*").alias("tokens")).join(errors, by, "left").withColumn("pairs", F.coalesce("pairs", F.lit(0)))


def custom_loss(rows: DataFrame, loss: Column, by: list[str] | None = None) -> DataFrame:
    """The value of a loss over several sequences: any aggregate of the rows' columns."""
    return rows.groupBy(*(by or [])).agg(loss.alias("loss"))


def training_columns(rows: DataFrame) -> DataFrame:
    """What goes to training: all but the mask."""
    return rows.drop("mask")
