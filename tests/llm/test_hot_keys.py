"""Nine tenths of the rows on one key, adaptive execution off: no task gets much more than its share."""

import pytest
from pyspark.sql import functions as F

import millrace.llm._skew as skew
from millrace.llm.embedding_dedup import embedding_near_duplicates
from millrace.llm.ngram_join import ngram_jaccard_join


@pytest.fixture
def plain(spark, monkeypatch):
    """Eight partitions that nothing evens out afterwards, and keys that count as hot from few rows on."""
    monkeypatch.setattr(skew, "HOT_ROWS", 30)
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    for k, v in zip(before, ("false", "8", "-1"), strict=True):
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def largest(df):
    """Rows of the largest partition over its share of eight."""
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(sizes) * 8 / sum(sizes)


@pytest.mark.parametrize("vector", [[1.0, 0.5, -2.0], None])
def test_equal_and_unusable_vectors(plain, vector):
    rows = [(i, vector if i % 10 else [float(i), 1.0, float(i % 7)]) for i in range(3000)]
    out = embedding_near_duplicates(plain.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(8))
    assert largest(out) < 2
    kept = {r.vec_id: r for r in out.where("vec_id IN (1, 2)").collect()}
    assert (kept[2].n_links, kept[2].component_id) == ((2699, 1) if vector else (0, 2))


@pytest.mark.parametrize("text", ["one and the same text of many documents again", None, ""])
def test_equal_texts_and_none(plain, text):
    rows = [(i, text if i % 10 else f"text number {i} has words of its own {i * 7} {i * 13}") for i in range(3000)]
    out = ngram_jaccard_join(plain.createDataFrame(rows, "doc_id long, text string").repartition(8))
    assert largest(out) < 2
    own = out.where("doc_id = 2").first()
    assert own.component_id == (1 if text else 2)
