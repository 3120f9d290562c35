import json
import math

import pytest
from pyspark.sql import functions as F

from millrace.operators import accounting, dataset, evaluation, logprob, preference, render, runlog, trajectory
from millrace.sources import readers, writers
from millrace.streaming import streams

PAIR = [("c", 0, "user", "Hi"), ("c", 1, "assistant", "Yo")]


def conversation(spark, turns=PAIR):
    return render.conversations(spark.createDataFrame(turns, "conv_id string, turn int, role string, text string"))


@pytest.mark.parametrize(
    ("name", "text"),
    [
        ("role_colon", "User: Hi\n\nAssistant: Yo\n\nUser:"),
        ("qwen3", "<|im_start|>user\nHi<|im_end|>\n<|im_start|>assistant\n<think>Yo<|im_end|>"),
        ("qwen3_instruct", "<|im_start|>user\nHi<|im_end|>\n<|im_start|>assistant\nYo<|im_end|>"),
        ("llama3", "<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n\nHi<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\nYo<|eot_id|>"),
        ("gpt_oss_no_sysprompt", "<|start|>user<|message|>Hi<|end|><|start|>assistant<|channel|>final<|message|>Yo<|return|>"),
        ("deepseekv3", "<｜begin▁of▁sentence｜><｜User｜>Hi<｜Assistant｜>Yo<｜end▁of▁sentence｜>"),
        ("deepseekv3_disable_thinking", "<｜begin▁of▁sentence｜><｜User｜>Hi<｜Assistant｜></think>Yo<｜end▁of▁sentence｜>"),
    ],
)
def test_templates(spark, name, text):
    c = conversation(spark)
    assert c.select(render.rendered(render.pieces(c, name))).first()[0] == text


@pytest.mark.parametrize(("train_on", "loss"), [("last_assistant_message", 10), ("all_assistant_messages", 10), ("all_user_and_system_messages", 5), ("all_messages", 15), ("all_tokens", 29)])
def test_loss_tokens(spark, train_on, loss):
    c = conversation(spark)
    p = render.pieces(c, "role_colon", train_on)
    assert tuple(c.select(render.byte_stats(p).alias("s")).select("s.*").first()) == (29, loss)
    example = c.select(render.byte_example(p).alias("e")).select("e.*").first()
    assert len(example.tokens) == 30 and sum(example.weights[1:]) == loss and bytes(example.tokens).decode() == "User: Hi\n\nAssistant: Yo\n\nUser:"


def test_cut_example_has_no_loss(spark):
    c = conversation(spark)
    s = c.select(render.byte_stats(render.pieces(c, "role_colon", "all_assistant_messages"), 12).alias("s")).select("s.*").first()
    assert tuple(s) == (11, 0)


def test_customized_needs_trainable(spark):
    c = conversation(spark)
    with pytest.raises(ValueError):
        render.pieces(c, "role_colon", "customized")
    own = spark.createDataFrame([([("user", "a", True), ("assistant", "b", False)],)], "messages array<struct<role:string,content:string,trainable:boolean>>")
    assert own.select(F.transform(render.pieces(own, "qwen3_instruct", "customized"), lambda p: p["w"])).first()[0] == [0, 0, 1, 0, 0]
    with pytest.raises(ValueError):
        render.template("unknown")


def test_unsupported_role_is_an_error(spark):
    c = conversation(spark, [("c", 0, "system", "x")])
    with pytest.raises(Exception, match="unsupported role"):
        c.select(render.rendered(render.pieces(c, "deepseekv3"))).collect()


def test_stop_tokens(spark):
    a = lambda *x: F.array(*[F.lit(v) for v in x])
    get = lambda *x: tuple(spark.range(1).select(render.parse_stop(a(*x), 99).alias("p")).select("p.*").first())
    assert get(1, 2, 99) == ([1, 2], True) and get(1, 2) == ([1, 2], False)
    with pytest.raises(Exception, match="more than one"):
        get(1, 99, 99)


def test_weight_runs(spark):
    runs = spark.range(1).select(render.weight_runs(F.array(*[F.lit(x) for x in (0, 0, 1, 1, 0)]))).first()[0]
    assert [tuple(r) for r in runs] == [(0, 2, 0), (2, 2, 1), (4, 1, 0)]


def test_prefix_merge(spark):
    steps = spark.createDataFrame([("g", 0, 0, [1, 2], [3], [-0.1]), ("g", 0, 1, [1, 2, 3, 4], [5], [-0.2]), ("g", 0, 2, [9], [8], [-0.3])], "group_id string, traj_idx int, step_idx int, ob_tokens array<int>, ac_tokens array<int>, ac_logprobs array<double>")
    adv = spark.createDataFrame([("g", 0, 0.5)], "group_id string, traj_idx int, advantage double")
    a, b = trajectory.training_rows(steps, adv).orderBy("segment").collect()
    assert (a.input_tokens, a.target_tokens, a.mask, a.advantages) == ([1, 2, 3, 4], [2, 3, 4, 5], [0, 1, 0, 1], [0, 0.5, 0, 0.5])
    assert (b.input_tokens, b.target_tokens, b.mask, b.logprobs) == ([9], [8], [1], [-0.3])


def rewards(spark, groups):
    return spark.createDataFrame([(g, i, float(r)) for g, rs in enumerate(groups) for i, r in enumerate(rs)], "group_id int, traj_idx int, total_reward double")


def test_advantages_and_groups(spark):
    assert [r.advantage for r in trajectory.advantages(rewards(spark, [[1, 0, 0, 1]])).orderBy("traj_idx").collect()] == [0.5, -0.5, -0.5, 0.5]
    assert {r.group_id for r in trajectory.without_constant_groups(rewards(spark, [[1, 1], [0, 0]])).collect()} == {0}
    assert {r.group_id for r in trajectory.without_constant_groups(rewards(spark, [[1, 1], [0, 1]])).collect()} == {1}
    assert all(math.isclose(x, 1 / 3) for x in trajectory.group_fractions(rewards(spark, [[1, 1], [0, 0], [0, 1]])).first())


def test_metric_means_over_keys_that_are_there(spark):
    df = spark.createDataFrame([({"a": 1.0, "b": 0.0},), ({"a": 3.0},)], "metrics map<string,double>")
    assert {r.key: r.value for r in trajectory.metric_means(df).collect()} == {"a": 2.0, "b": 0.0}


def test_logprobs(spark):
    df = spark.createDataFrame([(-1.0, -1.5, 0.0), (-2.0, -1.0, 1.0), (-3.0, 0.0, 1.0)], "lp double, base double, w double")
    assert df.agg(logprob.weighted_nll("lp", "w")).first()[0] == 2.5
    assert math.isnan(df.agg(logprob.weighted_nll("lp", F.lit(0.0))).first()[0])
    assert tuple(df.limit(2).agg(*logprob.kl_sample_train("lp", "base")).first()) == (-0.25, 0.3125, 1.5)
    rows = spark.createDataFrame([([0.5, -1.0], [0.0, 0.0], [1.0, 1.0], [0.0, 0.0])], "logprobs array<double>, base_logprobs array<double>, mask array<double>, advantages array<double>")
    assert [round(x, 6) for x in logprob.penalised_advantages(rows, 0.1).first().advantages] == [-0.075, 0.075]


def test_dpo_margin_has_beta_twice(spark):
    m = logprob.dpo_metrics(spark.createDataFrame([(1.0, 0.0)], "chosen double, rejected double"), 0.1).first()
    assert (round(m.dpo_loss, 6), m.accuracy, round(m.margin, 6), m.chosen_reward, m.rejected_reward) == (0.644397, 1.0, 0.01, 0.1, 0.0)


def test_mismatched_teacher_counts_as_zero_unless_skipped(spark):
    rows = spark.createDataFrame([([-1.0], [0.0, 1.0, 1.0])], "teacher_generated array<double>, mask array<double>")
    assert logprob.spread_teacher(rows).first().teacher_logprobs == [0.0, 0.0, 0.0]
    assert logprob.spread_teacher(rows, True).first().teacher_logprobs is None


def test_tournament(spark):
    players = spark.createDataFrame([("g", i) for i in range(6)], "group_id string, idx int")
    pairs = {(r.idx_i, r.idx_j) for r in preference.matchups(players, "group_id", 3).collect()}
    assert pairs == {(0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (4, 5)}
    two = spark.createDataFrame([("g", 0, 5), ("g", 1, 3), ("g", 9, 1)], "group_id string, idx int, n int")
    matches = preference.matchups(two, "group_id", 3, True).withColumn("reward_j", preference.shorter_wins("n_i", "n_j"))
    assert {r.idx: r.reward for r in preference.tournament(matches, two, "group_id").collect()} == {0: -1.0, 1: 1.0, 9: None}


def test_preferences(spark):
    w = preference.win_rate(spark.createDataFrame([(1.0, -1.0), (0.0, 0.0)], "r0 double, r1 double")).first()
    assert (w.win_rate, round(w.stderr, 6)) == (0.75, 0.176777)
    rated = spark.createDataFrame([("p", "a", 3, 0), ("p", "b", 3, 1), ("p", "c", 1, 2), ("p", "d", 1, 3), ("q", "e", 1, 4)], "p string, r string, h int, o int")
    assert [tuple(r) for r in preference.best_and_worst(rated, "p", "r", "h", "o").collect()] == [("p", "a", "d", 2)]
    arena = spark.createDataFrame([("model_b", [("user", [("text", "q")]), ("assistant", [("text", "x"), ("text", "y")])], [("user", [("text", "z")]), ("assistant", [("text", "w")])]), ("tie", [], [])], "winner string, conversation_a array<struct<role:string,content:array<struct<type:string,text:string>>>>, conversation_b array<struct<role:string,content:array<struct<type:string,text:string>>>>")
    row = preference.arena_comparisons(arena).collect()
    assert len(row) == 1 and row[0].label == "B" and row[0].completion_a[0].content == "x y" and row[0].prompt_conversation[0].content == "q"


def test_parts_and_picks(spark):
    df = spark.range(1, 6).select(F.col("id").cast("int").alias("rn"))
    assert [r.part for r in dataset.balanced_parts(df, 2).orderBy("rn").collect()] == [0, 0, 1, 1, 1]
    assert [r.part for r in dataset.balanced_parts(df, 3).orderBy("rn").collect()] == [0, 1, 1, 2, 2]
    with pytest.raises(Exception, match="more parts"):
        dataset.balanced_parts(df, 6).collect()
    ten = spark.range(10).select(F.lit("g").alias("g"), F.col("id").alias("k"), F.col("id").alias("s"))
    assert [r["rank"] for r in trajectory.representatives(ten, "s", "k", "g").orderBy("rank").collect()] == [0, 3, 6, 9]
    with pytest.raises(ValueError):
        dataset.mapped(df)
    assert dataset.parameter_grid(spark, a=[1, 2], b=["x", "y", "z"]).count() == 6


def test_logs(spark):
    rows = spark.createDataFrame([("a", None, 0), (None, "b", 1)], "state_path string, sampler_path string, line_no int")
    assert runlog.last_checkpoint(rows).first()["last"].state_path == "a"
    events = spark.createDataFrame([("f", "B", 1, 1, 0.0, 0), ("g", "B", 1, 1, 1.0, 1), ("g", "E", 1, 1, 2.0, 2), ("g", "B", 1, 1, 3.0, 3), ("g", "E", 1, 1, 5.0, 4), ("f", "E", 1, 1, 9.0, 5)], "name string, ph string, pid long, tid long, ts double, line_no long")
    assert sorted((s.name, s.depth, s.duration) for s in runlog.spans(events).collect()) == [("f", 1, 9.0), ("g", 2, 1.0), ("g", 2, 2.0)]
    meta = "k string, labels map<string,string>, count int, status string"
    merged = runlog.merged_metadata(spark.createDataFrame([("x", {"a": "1", "b": "2"}, 1, "old")], meta), spark.createDataFrame([("x", {"a": "9"}, 2, "new")], meta), "k").first()
    assert (merged.labels, merged["count"], merged.status) == ({"a": "9", "b": "2"}, 3, "old")
    assert evaluation.merged_metrics(spark.createDataFrame([("a", 1.0, 0), ("a", 2.0, 1)], "key string, value double, ord int")).first().value == 2.0


def test_models_and_counts(spark):
    df = spark.createDataFrame([("Qwen/Qwen3-8B",), ("x/y",)], "model_name string")
    assert {r.model_name: r.templates for r in accounting.with_models(df).collect()} == {"Qwen/Qwen3-8B": ["qwen3", "qwen3_disable_thinking"], "x/y": None}
    shapes = spark.createDataFrame([("a.weight", [2, 3]), ("a.gate.weight", [5, 5]), ("m.experts.0.down_proj.weight", [7, 11]), ("m.experts.1.down_proj.weight", [7, 11]), ("n.weight", [4])], "name string, shape array<bigint>")
    assert tuple(accounting.lora_parameters(shapes, 2).first()) == (58, 10, 68)
    assert tuple(accounting.lora_parameters(shapes, 2, experts=False).first()) == (0, 10, 10)


def test_readers_and_writers(spark, tmp_path):
    def put(name, *lines):
        (tmp_path / name).write_text("\n".join(lines))
        return str(tmp_path / name)

    ok = put("c.jsonl", json.dumps({"messages": [{"role": "user", "content": "a"}]}))
    assert readers.read_conversations(spark, ok).first().messages[0].content == "a"
    with pytest.raises(Exception, match="no messages"):
        readers.read_conversations(spark, put("d.jsonl", "{}")).collect()
    good, bad = readers.read_jsonl_tolerant(spark, put("t.jsonl", '{"a": 1}', "{oops", '{"a": 2}'), "a int")
    assert sorted(r.a for r in good.collect()) == [1, 2] and bad.count() == 1
    assert readers.read_checkpoints(spark, str(tmp_path / "none.jsonl")).count() == 0
    metrics = spark.createDataFrame([("r1", 1, "loss", 0.5), ("r1", 1, "acc", 1.0)], "run_id string, step long, key string, value double")
    writers.write_metrics(metrics, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first().metrics.loss == 0.5
    header = json.dumps({"__metadata__": {}, "w": {"dtype": "F32", "shape": [2, 3], "data_offsets": [0, 24]}}).encode()
    (tmp_path / "x.tensors").write_bytes(len(header).to_bytes(8, "little") + header + b"\0" * 24)
    spark.dataSource.register(readers.TensorHeaders)
    row = spark.read.format("tensor_headers").option("path", str(tmp_path / "x.tensors")).load().first()
    assert (row["name"], row["shape"]) == ("w", [2, 3])
    sums = readers.arithmetic_problems(spark, 3, 4)
    assert sums.where("CAST(answer AS INT) <> x + y OR x < 0 OR x > 100").count() == 0 and sums.count() == 12
    assert readers.guess_numbers(spark).where("split = 'train'").count() == 921


def test_stream_batches_count_invalid_items(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for i in range(3):
        spark.range(i * 5, i * 5 + 5).withColumn("ok", F.col("id") % 4 != 0).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run(**options):
        out = str(tmp_path / f"out{len(options)}")
        stream = spark.readStream.schema("id long, ok boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        streams.minibatches(stream, "id", 4, valid="ok", **options).writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-state").trigger(availableNow=True).start().awaitTermination()
        rows = spark.read.parquet(out).collect()
        return sorted(sum(r.batch_idx == b for r in rows) for b in {r.batch_idx for r in rows})

    assert sum(run()) == 9 and run(valid_only=True) == [4, 4]


def test_discounted_rows_by_plain_loops(spark):
    import random

    from millrace.operators.trajectory import discounted_rows

    r = random.Random(9)
    rows = [(k if k else None, s, r.choice([None, 1.0, -0.5, r.random()])) for k in range(5) for s in range([0, 1, 7, 300, 25_000][k])]
    want = {}
    for k in {k for k, _, _ in rows}:
        future = 0.0
        for _, s, x in sorted((x for x in rows if x[0] == k), key=lambda x: -x[1]):
            want[k, s] = future = (x or 0.0) + 0.99 * future
    shuffled = spark.createDataFrame(r.sample(rows, len(rows)), "who long, step int, reward double").selectExpr("*", "'x' AS future")
    got = {(x.who, x.step): x.future for x in discounted_rows(shuffled, "who", "step", "reward", 0.99).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert discounted_rows(shuffled.limit(0), "who", "step", "reward", 0.99).count() == 0
