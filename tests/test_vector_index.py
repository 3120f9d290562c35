import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import vector_index
from millrace.operators.retrieval import top_k
from millrace.operators.vector_index import VectorIndex, build_index, recall

SCHEMA = "vec_id long, embedding array<float>"


def table(spark, x, first=0):
    return spark.createDataFrame([(first + i, v) for i, v in enumerate(np.asarray(x, float).tolist())], SCHEMA).repartition(3)


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
def test_recall_and_distances(spark, tmp_path, metric):
    r = np.random.Generator(np.random.PCG64(1))
    centres = r.standard_normal((30, 24)) * 2
    corpus = table(spark, centres[r.integers(0, 30, 1500)] + r.standard_normal((1500, 24)) * 0.6)
    path = str(tmp_path / "index")
    build_index(corpus, path, metric)
    queries = corpus.where("vec_id % 20 = 0")
    index = VectorIndex(spark, path)
    probes = index.probes_for(corpus, queries.where("vec_id % 40 = 0"), 0.98, 3, others_only=True)
    assert 1 <= probes < len(index.rows) / 2
    exact = top_k(queries, corpus, 3, metric, others_only=True)
    found = index.search(queries, corpus, 3, probes, others_only=True)
    row = recall(found, exact).first()
    assert row["queries"] == 75 and row["there"] == 225 and row["recall"] >= 0.95
    far = {(x.query_id, x.neighbour_id): x.distance for x in exact.collect()}
    same = [(far[x.query_id, x.neighbour_id], x.distance) for x in found.collect() if (x.query_id, x.neighbour_id) in far]
    assert len(same) > 200 and all(abs(a - b) < 1e-12 for a, b in same)
    # with all lists and all candidates the search is exact
    whole = index.search(queries, corpus, 3, len(index.rows), 1500, others_only=True)
    assert sorted((x.query_id, x.neighbour_id, x.rank) for x in whole.collect()) == sorted((x.query_id, x.neighbour_id, x.rank) for x in exact.collect())


def test_a_list_with_most_vectors_is_parted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "CELL_ROWS", 64)
    monkeypatch.setattr(vector_index, "CELL_QUERIES", 16)
    r = np.random.Generator(np.random.PCG64(2))
    x = np.vstack([np.tile(r.standard_normal(8), (900, 1)), r.standard_normal((100, 8))])
    corpus = table(spark, x)
    path = str(tmp_path / "index")
    build_index(corpus, path, "l2", lists=10, sample=200)
    index = VectorIndex(spark, path)
    assert index.rows.sum() == 1000 and index.rows.max() >= 900
    out = index.search(corpus.where("vec_id % 10 = 0"), corpus, 5, 2).collect()
    assert len(out) == 500
    for q in range(0, 900, 10):
        assert [x.distance for x in out if x.query_id == q] == [0.0] * 5


def test_odd_rows(spark, tmp_path):
    good = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (3, [0.0, 1.0]), (None, [0.5, 0.5])]
    odd = [(10, None), (11, []), (12, [0.0, 0.0]), (13, [None, 1.0]), (14, [float("nan"), 1.0]), (15, [float("inf"), 1.0])]
    corpus = spark.createDataFrame([(*row, "x") for row in good + odd], f"{SCHEMA}, list string")
    path = str(tmp_path / "index")
    build_index(corpus, path, lists=2)
    index = VectorIndex(spark, path)
    assert index.rows.sum() == 4
    out = index.search(corpus.dropDuplicates(["vec_id"]), corpus, 2, 2)
    assert sorted((x.query_id, x.rank, x.neighbour_id) for x in out.collect()) == [(1, 1, 1), (1, 2, 2), (2, 1, 2), (2, 2, 1), (3, 1, 3), (3, 2, 3)]
    with pytest.raises(Exception, match="length"):
        index.search(spark.createDataFrame([(1, [1.0, 2.0, 3.0])], SCHEMA), corpus).collect()
    with pytest.raises(ValueError, match="one length"):
        build_index(spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [1.0])], SCHEMA), str(tmp_path / "bad"))
    none = spark.createDataFrame([], SCHEMA)
    build_index(none, str(tmp_path / "none"))
    assert VectorIndex(spark, str(tmp_path / "none")).search(corpus, none).count() == 0
    assert index.search(none, corpus).count() == 0


def test_the_corpus_is_read_once_however_many_queries(spark, tmp_path, data, monkeypatch):
    corpus = spark.read.parquet(f"{data}/embeddings.parquet")
    path = str(tmp_path / "index")
    build_index(corpus, path)
    search = VectorIndex(spark, path).search(corpus.where("vec_id % 20 = 0"), corpus, 3)
    plan = search._jdf.queryExecution().optimizedPlan().toString()
    scans = [line for line in plan.splitlines() if "Relation" in line and "embedding" in line]
    # the queries are read for their lists and for the last comparison, the corpus once
    assert len(scans) == 3
    assert VectorIndex(spark, path).search(corpus, corpus, 3).select("query_id").distinct().count() == corpus.count()


def test_candidates_follow_from_a_wanted_recall(spark, tmp_path):
    x = np.random.Generator(np.random.PCG64(5)).standard_normal((6000, 64))
    corpus = table(spark, x)
    path = str(tmp_path / "index")
    build_index(corpus, path, lists=20, parts=8)
    queries = corpus.where("vec_id % 40 = 0")
    index, exact = VectorIndex(spark, path), top_k(queries, corpus, 3, others_only=True)
    found = lambda refine: recall(index.search(queries, corpus, 3, 20, refine, others_only=True), exact).first()["recall"]
    refine = index.refine_for(corpus, queries, 20, 0.98, 3, others_only=True)
    assert found(None) < 0.8 and found(refine) >= 0.97 and refine < 6000


def test_memory_does_not_grow_with_lists():
    import tracemalloc

    x = np.random.Generator(np.random.PCG64(6)).standard_normal((4096, 4))
    want = np.array([((v - x) ** 2).sum(axis=1).argmin() for v in x[:50]])
    tracemalloc.start()
    try:
        own = vector_index._nearest(x, x)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert (own[:50] == want).all() and most < 64 << 20
