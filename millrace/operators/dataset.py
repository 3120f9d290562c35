"""Dataset operators: shuffling, splitting, batching, sampling, combining.

An order that (seed, id) alone decides takes the place of a stateful random number
generator: it is the same however the data are partitioned. Positions over a whole
table come from counts per bucket of the order, so no task holds all rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import edge
from ..functions.text import _col

#: Buckets of an order: four hex digits of the hash. A task sorts whole buckets; their counts are 65536 at most.
_BUCKET_DIGITS = 4


def shuffle_key(key: Column | str, seed: int) -> Column:
    return F.md5(F.concat(_col(key).cast("string"), F.lit(f":{seed}")))


def with_position(df: DataFrame, key: str, seed: int, name: str = "rn", within: list[str] | None = None) -> DataFrame:
    """Number rows from 1 in shuffled order, over the table or within groups."""
    order = shuffle_key(key, seed)
    if within:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*within).orderBy(order, key)))
    bucketed = df.withColumn("_order", order).withColumn("_bucket", F.substring("_order", 1, _BUCKET_DIGITS))
    counts = bucketed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    numbered = bucketed.withColumn("_within", F.row_number().over(Window.partitionBy("_bucket").orderBy("_order", key)))
    # at most 65536 counts, however large the table
    joined = numbered.join(F.broadcast(before), "_bucket")
    return joined.withColumn(name, F.col("_before") + F.col("_within")).drop("_order", "_bucket", "_before", "_within")


def count_rows(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(F.count("*").alias(name))


def _beside(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Every row with the columns of a table that has one row."""
    return df.join(F.broadcast(one_row), F.lit(True))


def train_test_split(df: DataFrame, key: str, seed: int, test: int | None = None) -> DataFrame:
    """Mark rows test or train: the first ``test`` of the shuffled order, if there are more than that; by default a tenth, 1024 at most."""
    numbered = _beside(with_position(df, key, seed), count_rows(df, "_n"))
    k = F.least(F.lit(1024), F.floor(F.col("_n") / 10)) if test is None else F.lit(test)
    return numbered.withColumn("split", F.when((F.col("_n") > k) & (F.col("rn") <= k), "test").otherwise("train")).drop("_n")


def tail_split(df: DataFrame, order: str, most: int = 100) -> DataFrame:
    """The last fifth, ``most`` at most, is test: rows from the ``most``-th last value of ``order`` (unique) on."""
    k = min(df.count() // 5, most)
    last = df.select(order).orderBy(F.desc(order)).limit(k).agg(F.min(order)).first()[0] if k else None
    return df.withColumn("split", F.lit("train") if last is None else F.when(F.col(order) >= F.lit(last), "test").otherwise("train"))


def batches(df: DataFrame, size: int, position: str = "rn", keep_last: bool = False, count: int | None = None) -> DataFrame:
    """Add batch_idx, by position; a short last batch goes unless it is kept."""
    out = df.withColumn("batch_idx", F.floor((F.col(position) - 1) / size))
    if keep_last:
        return out
    return _beside(out, count_rows(df, "_n")).where(F.col("batch_idx") < F.floor(F.col("_n") / size)).drop("_n")


def balanced_parts(df: DataFrame, parts: int, position: str = "rn") -> DataFrame:
    """Add part: contiguous parts of nearly equal size. More parts than rows is an error."""
    if parts <= 0:
        raise ValueError("parts must be positive")
    edges = F.transform(F.sequence(F.lit(0), F.lit(parts)), lambda j: edge(j, F.col("_n"), parts))
    checked = F.when(F.col("_n") >= parts, edges).otherwise(F.raise_error(F.lit("more parts than rows")).cast("array<bigint>"))
    return _beside(df, count_rows(df, "_n").withColumn("_edges", checked)).withColumn("part", (F.size(F.filter("_edges", lambda e: e < F.col(position))) - 1).cast("int")).drop("_n", "_edges")


def stratified_sample(df: DataFrame, key: str, stratum: str, k: int, seed: int) -> DataFrame:
    """At most k rows of each stratum. Rows that can't be among the first k are dropped before their stratum is gathered."""
    return with_position(df, key, seed, within=[stratum]).where(F.col("rn") <= k)


def sample_rows(df: DataFrame, key: str, m: int, seed: int) -> DataFrame:
    """At most m rows, uniformly."""
    return df.orderBy(shuffle_key(key, seed), key).limit(m)


def repeated(df: DataFrame, times: int, name: str = "epoch") -> DataFrame:
    """Each row so many times, numbered from 0."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(times - 1)))) if times > 0 else df.withColumn(name, F.lit(0)).where(F.lit(False))


def composite_batches(members: list[DataFrame], sizes: list[int], key: str, seed: int) -> DataFrame:
    """Batch i of every member together, tagged dataset_idx, for as long as all members have batches."""
    parts, counts = [], []
    for i, (df, size) in enumerate(zip(members, sizes, strict=True)):
        parts.append(with_position(df, key, seed).withColumn("batch_idx", F.floor((F.col("rn") - 1) / size)).withColumn("dataset_idx", F.lit(i)))
        counts.append(count_rows(df, "n").select(F.floor(F.col("n") / size).alias("n")))
    fewest = reduce(DataFrame.union, counts).agg(F.min("n").alias("_n"))
    return _beside(reduce(DataFrame.unionByName, parts), fewest).where(F.col("batch_idx") < F.col("_n")).drop("_n")


def without(df: DataFrame, other: DataFrame, on: str) -> DataFrame:
    """Rows whose value the other table hasn't; repeated rows stay repeated."""
    return df.join(other.select(on).distinct(), on, "left_anti")


def mapped(df: DataFrame, one: Column | None = None, many: Column | None = None, name: str = "datum") -> DataFrame:
    """A row for each row (one) or for each element of an array (many); exactly one of the two."""
    if (one is None) == (many is None):
        raise ValueError("give one or many")
    return df.withColumn(name, one) if one is not None else df.withColumn(name, F.explode(many))


def first_message(turns: DataFrame, role: str = "user", key: str = "conv_id") -> DataFrame:
    """The first message of a role in each conversation; conversations without one, or with an empty one, go."""
    own = turns.where(F.col("role") == role)
    return own.groupBy(key).agg(F.min_by("text", "turn").alias("prompt")).where("prompt IS NOT NULL AND prompt <> ''")


def remap_role(role: Column | str, keep_user: bool = True) -> Column:
    """human (and user, if kept) to user, anything else to assistant."""
    return F.when(_col(role).isin(["human", "user"] if keep_user else ["human"]), "user").otherwise("assistant")


def fresh(df: DataFrame, step: Column | str, sampled: Column | str, most: int) -> DataFrame:
    """Add requeue: whether a group was sampled too many steps ago."""
    return df.withColumn("requeue", (_col(step) - _col(sampled)) > most)


def both_orders(pairs: DataFrame, a: str, b: str, label: str) -> DataFrame:
    """Every pair as it is and swapped, the label with it."""
    swapped = F.when(F.col(label) == "A", "B").when(F.col(label) == "B", "A").otherwise(F.col(label))
    return pairs.withColumn("swapped", F.lit(False)).unionByName(pairs.withColumns({a: F.col(b), b: F.col(a), label: swapped, "swapped": F.lit(True)}))


def unique_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """name, name-2, name-3 in order of appearance."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(order))
    return df.withColumn("unique_name", F.when(n == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("-"), n.cast("string"))))


def parameter_grid(spark, **values: list) -> DataFrame:
    """All combinations of a few parameter values."""
    grid = spark.range(1).select()
    for name, options in values.items():
        grid = grid.select("*", F.explode(F.array(*[F.lit(v) for v in options])).alias(name))
    return grid


def first_rows(df: DataFrame, order: str, n: int | None) -> DataFrame:
    """The first n rows by ``order``; all of them without a limit."""
    return df if n is None else df.orderBy(order).limit(n)


def without_names(df: DataFrame, name: str, parts: list[str]) -> DataFrame:
    """Rows whose name holds none of the parts, in order of the name."""
    held = F.exists(F.array(*[F.lit(p) for p in parts]).cast("array<string>"), lambda p: F.contains(F.col(name), p))
    return df.where(~held).orderBy(name)


def joined_strictly(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both sides by key; a key that either side lacks or the right one repeats is an error."""
    one = right.groupBy(*keys).agg(F.first(F.struct(*[c for c in right.columns if c not in keys])).alias("_r"), F.count("*").alias("_n"))
    both = left.withColumn("_l", F.lit(1)).join(one, keys, "full")
    bad = F.col("_l").isNull() | F.col("_n").isNull() | (F.col("_n") > 1)
    wrong = F.raise_error(F.lit("keys of the two sides differ")).cast("boolean")
    return both.where(F.when(bad, wrong).otherwise(F.lit(True))).select(*left.columns, "_r.*")
