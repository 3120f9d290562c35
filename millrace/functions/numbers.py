"""Numeric functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, strip


def shaped_reward(correct: Column | str, well_formed: Column | str, coefficient: float = 0.1) -> Column:
    return _col(correct).cast("double") + coefficient * (_col(well_formed).cast("double") - 1.0)


def neg_log_sigmoid(x: Column | str) -> Column:
    """-log(sigmoid(x)) without overflow."""
    x = _col(x)
    return F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def pass_at_k(n: Column | str, c: Column | str, k: Column | int | str) -> Column:
    """Chance that one of k samples, drawn from n with c right, is right."""
    n, c, k = _col(n).cast("int"), _col(c).cast("int"), F.lit(k) if isinstance(k, int) else _col(k).cast("int")
    wrong = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0), lambda p, i: p * (1.0 - k / i))
    return F.when(n < k, None).when(c == 0, 0.0).when(n - c < k, 1.0).otherwise(1.0 - wrong)


def learning_rate(step: Column | str, steps: Column | str, schedule: str = "linear", floor: float | None = None) -> Column:
    """Share of the base rate, not below ``floor`` if there is one; an unknown schedule is an error."""
    if schedule == "linear":
        share = 1.0 - _col(step) / _col(steps)
        return share if floor is None else F.greatest(share, F.lit(float(floor)))
    if schedule == "constant":
        return F.lit(1.0)
    raise ValueError(f"unknown schedule: {schedule}")


def recommended_lr(model: Column | str, hidden: Column | str, lora: bool = True) -> Column:
    """A model family's learning rate at a hidden size; null for other families. 5e-5, 10, 0.781, 0.0775."""
    name = F.lower(_col(model))
    exponent = F.when(name.contains("llama"), 0.781).when(name.contains("qwen"), 0.0775)
    return (5e-5 * (10.0 if lora else 1.0)) * F.pow(2000.0 / _col(hidden), exponent)


def progress(step: Column | str, steps: Column | str) -> Column:
    """Share of the steps that are done after this one."""
    return (_col(step) + 1) / _col(steps)


def preference_value(x: Column | str) -> Column:
    """A is -1, B is 1, anything else 0."""
    x = strip(x)
    return F.when(x == "A", -1.0).when(x == "B", 1.0).otherwise(0.0)


def relative_difference(a: Column | str, b: Column | str) -> Column:
    a, b = _col(a), _col(b)
    return F.try_divide(F.abs(a - b), F.greatest(F.abs(a), F.abs(b)))


def edge(j: Column, n: Column, k: Column | int) -> Column:
    """Edge j of k contiguous parts of n items, as stepping by n / k in floating point and cutting off gives it."""
    k = F.lit(k) if isinstance(k, int) else k
    return F.when(j == k, n).otherwise((j * (n / k.cast("double"))).cast("bigint"))
