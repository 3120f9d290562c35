import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import retrieval
from millrace.sources import datasets, readers, writers
from millrace.sources.scratch import scratch_folder
from millrace.streaming import streams


def test_search_against_brute_force_with_ties(spark, monkeypatch):
    r = np.random.default_rng(2)
    x = np.round(r.standard_normal((300, 12)), 1)
    x[200:240] = x[0]  # equal vectors: ties go by id
    x[250] = 0
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(900, None)], "vec_id long, embedding array<double>").repartition(5)
    queries = df.where("vec_id % 20 = 0")
    for metric in ("cosine", "l2", "ip"):
        def far(a, b):
            if metric == "l2":
                return ((a - b) ** 2).sum()
            dot = (a * b).sum()
            return 1 - dot if metric == "ip" else 1 - dot / np.sqrt((a * a).sum() * (b * b).sum())

        want = set()
        for q in range(0, 300, 20):
            with np.errstate(invalid="ignore"):
                order = sorted((round(float(d), 9), i) for i in range(300) if i != q and np.isfinite(d := far(x[q], x[i])))
            want |= {(q, i, k + 1) for k, (_, i) in enumerate(order[:4])}
        for block in (1 << 26, 200):
            monkeypatch.setattr(retrieval, "BLOCK_BYTES", block)
            monkeypatch.setattr(retrieval, "ROWS_AT_ONCE", 64)
            got = {(v.query_id, v.neighbour_id, v["rank"]) for v in retrieval.top_k(queries, df, 4, metric, others_only=True).collect()}
            assert got == want, metric
    assert retrieval.top_k(queries.limit(0), df).count() == 0
    with pytest.raises(ValueError):
        retrieval.top_k(queries, df, metric="other")


def test_distances_agree_with_the_expression(spark):
    df = spark.createDataFrame([([1.0, 2.0], [2.0, 0.5])], "a array<double>, b array<double>")
    for metric in ("cosine", "l2", "ip"):
        a, b = np.array([[1.0, 2.0]]), np.array([[2.0, 0.5]])
        own = retrieval._exact(retrieval._prepared(a, metric), retrieval._prepared(b, metric), metric)[0]
        assert abs(df.select(retrieval.distance("a", "b", metric)).first()[0] - own) < 1e-12


def test_unknown_datasets(spark, tmp_path):
    source = datasets.Source(spark, str(tmp_path))
    with pytest.raises(ValueError):
        datasets.problems(source, "none")
    with pytest.raises(ValueError):
        datasets.comparisons(source, "arena", datasets.PREFERENCE_OPTIMISATION)


def test_held_out_problems_do_not_overlap(spark, tmp_path):
    rows = spark.range(140).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("problem"), F.lit("\\boxed{1}").alias("solution"), F.lit("1").alias("answer"))
    for i, (c, s) in enumerate((c, s) for c in datasets.MATH_CONFIGS for s in ("train", "test")):
        rows.where(f"CAST(substring(problem, 2) AS INT) % 14 = {i}").select("problem", "solution").write.parquet(f"{tmp_path}/math/{c}/{s}")
    rows.limit(20).write.parquet(f"{tmp_path}/math_held_out/default/test")
    train, test = datasets.problems(datasets.Source(spark, str(tmp_path)), "math")
    a, b = ({r.problem for r in x.collect()} for x in (train, test))
    assert len(a) == 120 and len(b) == 20 and not a & b


def test_wrong_embeddings_are_an_error(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "vec_id long, embedding array<double>")
    assert datasets.checked_embeddings(df.limit(1), 2).count() == 1
    with pytest.raises(Exception, match="embedding of length 1"):
        datasets.checked_embeddings(df, 2).collect()


def test_tables_as_html_and_markdown(spark):
    assert writers.records_of([{"a": 1, "b": 2}, {"a": 3, "c": 4}]) == (["a", "b"], [[1, 2], [3, None]])
    assert writers.records_of({"a": [1, 2], "b": [3, 4]}) == (["a", "b"], [[1, 3], [2, 4]])
    assert writers.records_of({"a": 1}) == (["key", "value"], [["a", 1]]) and writers.records_of([]) == ([], [])
    with pytest.raises(ValueError):
        writers.records_of({"a": [1], "b": [1, 2]})
    assert writers.html_table([{"x": "<b>"}]) == "<table><tr><th>x</th></tr><tr><td>&lt;b&gt;</td></tr></table>"
    assert writers.html_table(spark.range(1)) == "<table><tr><th>id</th></tr><tr><td>0</td></tr></table>"
    assert writers.markdown(spark.range(1)).splitlines() == ["| id |", "| --- |", "| 0 |"]


def test_config_and_fan_out(spark):
    assert json.loads(writers.config_json({"a": 1, "f": len})) == {"a": 1, "f": "<class 'builtin_function_or_method'>"}
    seen = []
    writers.fan_out(lambda b, n: seen.append((b.count(), n)), lambda b, n: seen.append((b.columns, n)))(spark.range(3), 7)
    assert seen == [(3, 7), (["id"], 7)]


def test_trace_document_of_no_and_some_events(spark):
    kind = "name string, ph string, pid long, tid long, ts double"
    text = lambda rows: "\n".join(r.value for r in writers.trace_array(spark.createDataFrame(rows, kind)).collect())
    assert json.loads(text([])) == []
    got = json.loads(text([("b", "E", 1, 1, 2.0), ("a", "B", 1, 1, 1.0), ("c", "i", 2, 1, 3.0)]))
    assert [e["name"] for e in got] == ["a", "b", "c"]
    again = [("a", "B", 1, 1, 1.0)] * 3 + [("z", None, None, 1, None)] * 2 + [("c", "i", 2, 1, 3.0)]
    assert sorted(e.get("name") for e in json.loads(text(again))) == ["a", "a", "a", "c", "z", "z"]


def test_tensor_headers_by_uri(spark, tmp_path):
    header = json.dumps({"w": {"dtype": "F32", "shape": [4], "data_offsets": [0, 16]}}).encode()
    (tmp_path / "x.tensors").write_bytes(len(header).to_bytes(8, "little") + header + b"\0" * 16)
    spark.dataSource.register(readers.TensorHeaders)
    for path in (f"{tmp_path}/x.tensors", f"file://{tmp_path}/x.tensors"):
        assert spark.read.format("tensor_headers").option("path", path).load().first()["shape"] == [4]


def test_shuffled_batches_carry_what_is_left(spark, tmp_path):
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run(out):
        sink = streams.ShuffledBatches(str(tmp_path / out), "id", 8, seed=1)
        source = readers.table_stream(spark, str(tmp_path / "in"), "id long", 1)
        source.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / f"{out}-c")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.batch_idx, r.id) for r in sink.batches(spark).collect())

    a = run("a")
    assert sorted({b for b, _ in a}) == [0, 1, 2] and all(sum(b == k for b, _ in a) == 8 for k in range(3)) and len({i for _, i in a}) == 24
    # a micro-batch that is run again writes the same
    sink = streams.ShuffledBatches(str(tmp_path / "b"), "id", 8, seed=1)
    for _ in range(2):
        sink(spark.range(10), 0)
    sink(spark.range(10, 20), 1)
    once = sorted(map(tuple, sink.batches(spark).collect()))
    sink(spark.range(10, 20), 1)
    assert sorted(map(tuple, sink.batches(spark).collect())) == once and len(once) == 16


def test_log_tail_goes_on_where_it_stopped(spark, tmp_path):
    folder, out = str(tmp_path / "log"), str(tmp_path / "out")

    def step(lo, hi):
        spark.range(lo, hi).selectExpr("id AS step", "id / 10.0D AS loss").write.mode("append").json(folder)
        readers.tail_log(spark, folder, "step long, loss double", 1).writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-c").trigger(availableNow=True).start().awaitTermination()
        return sorted(r.step for r in spark.read.parquet(out).collect())

    assert step(0, 5) == list(range(5)) and step(5, 9) == list(range(9))


def test_resume_point(spark):
    kind = "name string, epoch long, batch long, state_path string, line_no long"
    assert tuple(streams.resume_point(spark.createDataFrame([("a", 1, 5, "s", 0), ("b", 1, 9, None, 1)], kind)).first()) == (1, 5)
    assert tuple(streams.resume_point(spark.createDataFrame([], kind)).first()) == (0, 0)


def test_scratch_folder_is_the_shared_one():
    from types import SimpleNamespace

    def session(named, master):
        context = SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda key: None))
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: named), sparkContext=context)

    assert scratch_folder(session("/shared/c/", "yarn"), "x").startswith("/shared/c/millrace/x-")
    assert scratch_folder(session(None, "local[2]"), "x").startswith("file://")
    with pytest.raises(ValueError):
        scratch_folder(session(None, "yarn"), "x")


def test_metric_logs_in_either_layout(spark, tmp_path):
    (tmp_path / "a" / "run7").mkdir(parents=True)
    (tmp_path / "a" / "run7" / "metrics.jsonl").write_text('{"step": 1, "loss": 0.5, "note": "x"}\n{"step": 2, "loss": 0.25}\n')
    got = sorted(map(tuple, readers.read_metrics(spark, str(tmp_path / "a")).collect()))
    assert got == [("run7", 1, "loss", 0.5), ("run7", 2, "loss", 0.25)]
    writers.write_metrics(spark.createDataFrame([("r", 3, "loss", 1.5)], "run_id string, step long, key string, value double"), str(tmp_path / "b"))
    assert [tuple(r) for r in readers.read_metrics(spark, str(tmp_path / "b")).collect()] == [("r", 3, "loss", 1.5)]
