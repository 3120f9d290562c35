import hashlib
import math
from collections import Counter

from millrace.llm.mixing import mix_sources, poisson_tables, source_rates
from pyspark.sql import functions as F


def poisson(rate, u):
    k, p, c = 0, math.exp(-rate), math.exp(-rate)
    while c <= u:
        k += 1
        p *= rate / k
        c += p
    return k


def docs(spark, n=3000):
    rows = [(i, "big" if i % 3 == 0 else f"s{i % 7}", "t") for i in range(n)] + [(None, "big", "t"), (1, None, None), (1, None, None)]
    return rows, spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 AS rate", "2 AS copy").repartition(3)


def test_against_inversion(spark):
    rows, df = docs(spark)
    weights = {"big": 1.0, "s1": 3.0, "s2": 0.5, None: 0.002}
    rates = {r.source: r.rate for r in source_rates(df, weights).collect()}
    assert math.isclose(sum(rates[s] * c for s, c in Counter(s for _, s, _ in rows).items()), len(rows)) and rates["s3"] == 0
    out = mix_sources(df, weights, seed=5).collect()
    got = Counter((r.doc_id, r.source) for r in out)
    want = Counter()
    for d, s, _ in rows:
        u = int(hashlib.md5(f"5:{'null' if d is None else d}".encode()).hexdigest()[:13], 16) / 2**52
        want[d, s] += poisson(rates[s], u) if rates[s] else 0
    assert got == +want
    share = sum(r.source == "s1" for r in out) / len(out)
    assert abs(share - 3 / 4.502) < 0.05


def test_order_is_random_and_repeatable(spark):
    _, df = docs(spark)
    a, b = (mix_sources(df).select("doc_id", "copy", "shuffle_key", F.spark_partition_id().alias("p")).collect() for _ in range(2))
    assert a == b
    for p in {r.p for r in a}:
        keys = [r.shuffle_key for r in a if r.p == p]
        assert keys == sorted(keys)
    ids = [r.doc_id for r in a if r.doc_id is not None]
    rises = sum(x < y for x, y in zip(ids, ids[1:], strict=False)) / len(ids)
    assert 0.4 < rises < 0.6


def test_large_rates_do_not_underflow(spark):
    rates = spark.createDataFrame([("a", 2000.0), ("b", 0.0), (None, 1.5)], "source string, rate double")
    tables = {r.source: r.cdf for r in poisson_tables(rates).collect()}
    assert tables["b"] == [1.0] and all(abs(x - sum(math.exp(-1.5) * 1.5**j / math.factorial(j) for j in range(k + 1))) < 1e-12 for k, x in enumerate(tables[None]))
    cdf = tables["a"]
    assert abs(cdf[2000] - 0.5) < 0.02 and abs(cdf[-1] - 1) < 1e-9


def test_empty_table(spark):
    _, df = docs(spark)
    assert mix_sources(df.limit(0)).count() == 0 and mix_sources(df, {"none": 1.0}).count() == 0


def test_null_ids_do_not_share_a_place(spark):
    df = spark.createDataFrame([(None, "a", f"t{i}") for i in range(400)], "doc_id long, source string, text string")
    out = mix_sources(df, {"a": 1.0}, seed=9, size=1200).collect()
    assert len({r.shuffle_key for r in out}) == len(out) > 0


def test_very_long_and_empty_texts_are_repeated_whole(spark):
    long = "word " * 300_000
    rows = [(i, "a", text) for i, text in enumerate([long, "", None, "x"] * 5)]
    out = mix_sources(spark.createDataFrame(rows, "doc_id long, source string, text string"), {"a": 1.0}, size=60).collect()
    texts = {i: t for i, _, t in rows}
    assert len(out) > 20 and all(r.text == texts[r.doc_id] for r in out) and long in {r.text for r in out}
