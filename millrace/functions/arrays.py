"""Functions on token, weight and log-probability arrays, as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .text import _col


def is_prefix(a: Column | str, b: Column | str) -> Column:
    a, b = _col(a), _col(b)
    return F.slice(b, F.lit(1), F.size(a)) == a


def head(x: Column | str, n: int | Column) -> Column:
    return F.slice(_col(x), F.lit(1), F.lit(n) if isinstance(n, int) else n)


def inputs(x: Column | str) -> Column:
    """All but the last."""
    x = _col(x)
    return F.slice(x, F.lit(1), F.greatest(F.size(x) - 1, F.lit(0)))


def targets(x: Column | str) -> Column:
    """All but the first."""
    x = _col(x)
    return F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0)))


def whole_sequence(tokens_in: Column | str, tokens_out: Column | str) -> Column:
    """Inputs followed by the last target."""
    out = _col(tokens_out)
    return F.concat(_col(tokens_in), F.slice(out, F.greatest(F.size(out), F.lit(1)), F.lit(1)))


def cut_after_first_one(x: Column | str, weights: Column | str) -> Column:
    """Up to the first weight of one; null if there is none."""
    at = F.array_position(F.transform(_col(weights), lambda w: w.cast("double")), F.lit(1.0)).cast("int")
    return F.when(at > 0, F.slice(_col(x), F.lit(1), at))


def total(x: Column | str) -> Column:
    return F.aggregate(_col(x), F.lit(0.0), lambda s, v: s + v)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(_col(a), _col(b), lambda x, y: (x * y).cast("double")))


def discounted(x: Column | str, gamma: float) -> Column:
    """y[t] = x[t] + gamma * y[t + 1], in one pass; an Arrow UDF, as growing an array in an expression copies it at every step."""

    def backwards(values) -> list[float] | None:
        if values is None:
            return None
        out, future = [0.0] * len(values), 0.0
        for t in range(len(values) - 1, -1, -1):
            out[t] = future = float(values[t]) + gamma * future
        return out

    def all_of(arrays: pd.Series) -> pd.Series:
        return arrays.map(backwards)

    return F.pandas_udf(all_of, ArrayType(DoubleType()))(_col(x))


def padded(n: Column | str, values: Column | str, with_value: float = 0.0) -> Column:
    """``n`` times a value, then the values."""
    return F.concat(F.array_repeat(F.lit(with_value), _col(n).cast("int")), _col(values))


def where_mask(x: Column | str, mask: Column | str, above: float = 0.0) -> Column:
    """Elements whose mask exceeds ``above``."""
    pairs = F.arrays_zip(_col(x).alias("v"), _col(mask).alias("m"))
    return F.transform(F.filter(pairs, lambda p: p["m"] > above), lambda p: p["v"])


def scattered(values: Column | str, mask: Column | str) -> Column:
    """Values put where the mask exceeds a half, zero elsewhere; all zero if their number differs."""
    values, mask = _col(values), _col(mask)
    places = F.filter(F.transform(mask, lambda m, i: F.when(m > 0.5, i)), lambda i: i.isNotNull())
    zeros = lambda n: F.array_repeat(F.lit(0.0), n.cast("int"))
    # before each value, as many zeros as lie between its place and the last one's: linear in the mask
    parts = F.transform(values, lambda v, k: F.concat(zeros(F.element_at(places, k + 1) - F.when(k == 0, -1).otherwise(F.try_element_at(places, k)) - 1), F.array(v.cast("double"))))
    tail = zeros(F.size(mask) - 1 - F.coalesce(F.try_element_at(places, F.lit(-1)), F.lit(-1)))
    return F.when(F.size(places) == F.size(values), F.concat(F.flatten(parts), tail)).otherwise(zeros(F.size(mask)))


def zipped_strictly(a: Column | str, b: Column | str) -> Column:
    """array<struct<a, b>> of two arrays of one length; another length is an error."""
    a, b = _col(a), _col(b)
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    wrong = F.raise_error(F.concat(F.lit("lengths differ: "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string")))
    return F.when(F.size(a) == F.size(b), pairs).otherwise(F.when(a.isNotNull() & b.isNotNull(), F.filter(pairs, lambda p: wrong.cast("boolean"))))


def flattened(x: Column | str) -> Column:
    """All elements of an array of arrays, in order."""
    return F.flatten(_col(x))


def common_elements(a: Column | str, b: Column | str) -> Column:
    """Elements that both arrays hold, ascending, each once."""
    return F.array_sort(F.array_intersect(_col(a), _col(b)))


def prefixed(metrics: Column | str, prefix: str) -> Column:
    """A metrics map with ``prefix/`` before each key."""
    return F.transform_keys(_col(metrics), lambda k, _: F.concat(F.lit(f"{prefix}/"), k))


def regenerated(prefix: Column | str, tokens: Column | str, mask: Column | str) -> Column:
    """A new prefix followed by the generated tokens: those whose mask exceeds a half."""
    return F.concat(_col(prefix), where_mask(tokens, mask, 0.5))
