"""Mixing sources to target weights by Poisson replication (operator 10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits of the hash that make a uniform number: 52 bits.
_DIGITS = 13
#: Sources are broadcast when they are this few and their rates this small: 16 MB at most; else they are joined.
BROADCAST_SOURCES, BROADCAST_RATE = 1_000, 1_000.0


def hash_uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) that the parts alone decide; a null part counts as the word null."""
    text = F.concat_ws(":", *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, _DIGITS), 16, 10).cast("double") / F.lit(float(16**_DIGITS))


def poisson_tables(rates: DataFrame) -> DataFrame:
    """``rates`` (source, rate) with cdf: P(X <= k) for k = 0, 1, ... until what is left is below 2**-52.

    One row per source and k, summed up in the order of k, from logarithms, so that large rates
    don't underflow; [1] where the rate is zero.
    """
    k, rate = F.col("k"), F.col("rate")
    upto = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    each = rates.where("rate > 0").withColumn("k", F.explode(F.sequence(F.lit(0), (rate + 12 * F.sqrt(rate) + 30).cast("int"))))
    each = each.withColumn("log_k", F.sum(F.when(k > 0, F.log(k.cast("double"))).otherwise(0.0)).over(upto))
    each = each.withColumn("p", F.sum(F.exp(k * F.log(rate) - rate - F.col("log_k"))).over(upto))
    tables = each.groupBy("source", "rate").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "p"))), lambda x: x["p"]).alias("cdf"))
    return tables.unionByName(rates.where("rate <= 0").select("source", "rate", F.array(F.lit(1.0)).alias("cdf")))


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = 0.5, size: int | None = None, source: str = "source") -> DataFrame:
    """(source, n_docs, rate): the mean number of times that each document of a source is to be repeated.

    ``weights`` gives each source's share of the mixture, in any unit, and sources
    not named get none. Without it a source's weight is its count to the ``power``, so
    that large sources yield to small ones. ``size`` is the expected rows of the
    mixture, as many as came in by default.
    """
    counts = docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n_docs"))
    if weights is None:
        weighed = counts.withColumn("weight", F.pow(F.col("n_docs").cast("double"), F.lit(power)))
    else:
        rows = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, weight double")
        weighed = counts.alias("c").join(rows.alias("w"), F.col("c.source").eqNullSafe(F.col("w.source")), "left").select("c.source", "n_docs", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    weight, have = weighed.agg(F.sum("weight"), F.sum("n_docs")).first()
    scale = (have if size is None else size) / weight if weight else 0.0
    return weighed.select("source", "n_docs", (F.col("weight") * F.lit(float(scale)) / F.col("n_docs")).alias("rate"))


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = 0.5, size: int | None = None, seed: int = 0, source: str = "source") -> DataFrame:
    """Repeat each document a Poisson number of times so that sources reach their target weights, in random order.

    ``docs`` needs doc_id and the ``source`` column; all its columns stay, and
    rate, copy (0, 1, ...) and shuffle_key are added, replacing columns of these
    names. A document's count inverts the Poisson distribution of its source's rate
    at a number that (seed, doc_id) decides. Rows come out in a random order that
    (seed, doc_id, copy) decides: dealt to partitions by shuffle_key and ordered by
    it within each.

    A null source is a source of its own. Repeated rows, and rows with a null id,
    get equal counts; the latter are told apart in the order by what else they hold. Null, empty and very long texts are treated
    like others. An empty table gives an empty result.
    """
    docs = docs.drop("rate", "copy", "shuffle_key")
    hashed = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString()]
    own = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), F.xxhash64(*hashed).cast("string")))
    rates = source_rates(docs, weights, power, size, source)
    few = rates.agg(F.count("*"), F.coalesce(F.max("rate"), F.lit(0.0))).first()
    rates = poisson_tables(rates).select(F.col("source").alias("__mr_source"), "rate", F.col("cdf").alias("__mr_cdf"))
    if few[0] <= BROADCAST_SOURCES and few[1] <= BROADCAST_RATE:
        rates = F.broadcast(rates)
    joined = docs.withColumn("__mr_u", hash_uniform(F.lit(seed), "doc_id")).join(rates, F.col(source).eqNullSafe(F.col("__mr_source")))
    copies = joined.withColumn("__mr_n", F.size(F.filter("__mr_cdf", lambda p: p <= F.col("__mr_u")))).where("__mr_n > 0").select(*docs.columns, "rate", F.explode(F.sequence(F.lit(0), F.col("__mr_n") - 1)).alias("copy"))
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit("order"), F.lit(seed).cast("string"), own, F.col("copy").cast("string"))))
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
