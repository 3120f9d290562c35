import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import arrays, text
from millrace.operators import dataset, environment, logprob, preference, render, trajectory
from millrace.plans import protocols


def one(spark, *columns):
    row = spark.range(1).select(*columns).first()
    return row[0] if len(columns) == 1 else tuple(row)


def test_discounting_and_scattering_against_plain_loops(spark):
    r = random.Random(1)
    rows = []
    for _ in range(60):
        mask = [float(r.random() < 0.4) for _ in range(r.randrange(0, 40))]
        rows.append((mask, [r.uniform(-2, 0) for _ in range(int(sum(mask)) + (r.random() < 0.3))], [r.uniform(-1, 1) for _ in mask]))
    rows += [([], [], []), ([1.0] * 5000, [0.5] * 5000, [1.0] * 5000)]
    df = spark.createDataFrame(rows, "mask array<double>, values array<double>, x array<double>")
    got = df.select("mask", "values", "x", arrays.scattered("values", "mask").alias("s"), arrays.discounted("x", 0.9).alias("d")).collect()
    for row in got:
        fits, it = len(row["values"]) == sum(row.mask), iter(row["values"])
        assert row.s == [next(it) if fits and m > 0.5 else 0.0 for m in row.mask]
        want, future = [], 0.0
        for v in reversed(row.x):
            future = v + 0.9 * future
            want.insert(0, future)
        assert all(abs(a - b) < 1e-9 for a, b in zip(row.d, want, strict=True))


def test_strict_zips_and_joins(spark):
    a = lambda *x: F.array(*[F.lit(v) for v in x])
    assert [tuple(p) for p in one(spark, arrays.zipped_strictly(a(1, 2), a(3, 4)))] == [(1, 3), (2, 4)]
    for x, y in ((a(1), a(1, 2)), (a(1, 2), a(1))):
        with pytest.raises(Exception, match="lengths differ"):
            one(spark, arrays.zipped_strictly(x, y))
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k long, x string")
    right = lambda *rows: spark.createDataFrame(rows, "k long, y string")
    assert sorted(map(tuple, dataset.joined_strictly(left, right((1, "c"), (2, "d")), ["k"]).collect())) == [(1, "a", "c"), (2, "b", "d")]
    for bad in (right((1, "c")), right((1, "c"), (2, "d"), (3, "e")), right((1, "c"), (2, "d"), (2, "e"))):
        with pytest.raises(Exception, match="keys of the two sides"):
            dataset.joined_strictly(left, bad, ["k"]).collect()


def test_tail_split(spark):
    df = spark.range(23)
    split = {r.id: r.split for r in dataset.tail_split(df, "id").collect()}
    assert [i for i, s in sorted(split.items()) if s == "test"] == [19, 20, 21, 22]
    assert dataset.tail_split(df.limit(4), "id").where("split = 'test'").count() == 0
    assert dataset.tail_split(spark.range(1000), "id", most=7).where("split = 'test'").count() == 7
    assert dataset.tail_split(df.limit(0), "id").count() == 0


def test_paths(spark):
    prefix = lambda *xs: one(spark, text.boundary_prefix(F.lit(min(xs)), F.lit(max(xs))))
    assert [prefix("runs/a/x", "runs/a/y"), prefix("runs/ab", "runs/ac"), prefix("exp_one", "exp_two"), prefix("abc", "abd"), prefix("same/", "same/"), prefix("", "x")] == ["runs/a/", "runs/", "exp_", "", "same/", ""]
    short = lambda x: one(spark, text.abbreviated_path(F.lit(x)))
    assert [short("learning_rate=3"), short("a_long_b/folder/name"), short("my-long-x/deeper/last_part_of"), short("x" * 30)] == ["lr=3", "a_long_b/folder/name", "mlx/dee/last_part_of", "..." + "x" * 17]


def test_replayed_search(spark):
    kind = "e long, turn int, content string, parsed boolean, tools array<string>, tool_ok boolean, next_tokens int, gold array<string>"
    call = lambda e, t, tools=("search",), ok=True, n=10: (e, t, "", True, list(tools), ok, n, ["Paris"])
    said = lambda e, t, s, parsed=True: (e, t, s, parsed, None, None, None, ["Paris"])
    rows = [call(1, 0), said(1, 1, "Answer: paris!"), call(2, 0, ()), call(3, 0, ok=False), *[call(4, t) for t in range(6)], said(5, 0, "Answer: Rome"), said(6, 0, "Answer: Paris", False), call(7, 0), call(7, 1), call(8, 0, n=10**6)]
    got = {r.e: (r.turns, r.calls, r.failed, r.format, r.correct, round(r.reward, 6) if r.reward is not None else None) for r in environment.search_episodes(spark.createDataFrame(rows, kind), ["e"]).collect()}
    assert got == {
        1: (2, 1, False, 1.0, 1.0, 1.0), 2: (1, 0, True, None, None, 0.0), 3: (1, 1, True, None, None, 0.0), 4: (5, 5, True, None, None, 0.0), 5: (1, 0, False, 1.0, 0.0, 0.0), 6: (1, 0, False, 0.0, 1.0, 0.9),
        7: (2, 2, False, None, None, None), 8: (1, 1, True, None, None, 0.0),
    }


def test_games(spark):
    rows = [(1, 1, "Guess: 4"), (1, 2, "Guess: 9"), (1, 3, "hm"), (1, 4, "Guess: 5"), (1, 5, "Guess: 5"), (2, 1, "x"), (3, 12, "Guess: 5")]
    df = spark.createDataFrame(rows, "g long, turn int, content string").withColumn("gold", F.lit(5))
    assert sorted(map(tuple, environment.guessing_games(df, ["g"]).collect())) == [(1, 4, True, 0.0), (2, 1, False, -1.0)]


def test_prompts_and_grades(spark):
    rows = spark.createDataFrame([("1+1?", "\\boxed{2}", "2"), ("1+1?", "two", "2"), ("1+1?", "\\boxed{3}", "2")], "problem string, said string, answer string")
    out = environment.graded_math(environment.problem_prompts(rows, "qwen3_instruct"), "said", "answer").collect()
    assert out[0].prompt.endswith("<|im_start|>user\n1+1? Write your answer in \\boxed{} format.<|im_end|>\n<|im_start|>assistant\n") and out[0].prompt.count("<|im_start|>") == 4
    assert [(r.format, r.correct, round(r.reward, 6)) for r in out] == [(1.0, 1.0, 1.0), (0.0, 0.0, -0.1), (1.0, 0.0, 0.0)]
    assert environment.problem_prompts(rows, "role_colon", example=(), suffix=environment.WORD_SUFFIX).first().prompt == "User: 1+1? Provide a numerical answer without units, written inside \\boxed{}.\n\nAssistant:"


def test_group_reward_functions(spark):
    df = spark.createDataFrame([("g", 1, 5), ("g", 0, 3), ("h", 0, 9)], "group_id string, traj_idx int, n int")
    own = lambda r: {(x.group_id, x.traj_idx): x.final_reward for x in environment.group_rewards(df, r).collect()}
    assert own(None) == {("g", 0): 0.0, ("g", 1): 0.0, ("h", 0): 0.0}
    assert own(F.col("n") * 2) == {("g", 0): 6.0, ("g", 1): 10.0, ("h", 0): 18.0}
    assert own(lambda m: m["n"] - m["n"].iloc[0]) == {("g", 0): 0.0, ("g", 1): 2.0, ("h", 0): 0.0}


def test_reward_model_example_ends_with_its_label(spark):
    m = "array<struct<role:string,content:string>>"
    df = spark.createDataFrame([(1, [("user", "q")], [("assistant", "x")], [("assistant", "y")], "B")], f"k long, prompt_conversation {m}, completion_a {m}, completion_b {m}, label string")
    r = preference.reward_model_examples(df, "k", "role_colon").first()
    assert bytes(r.tokens).decode().endswith("System: ==== Preference ====\n\nAssistant: ") and r.weights[-1] == 1 and sum(r.weights) == 1


def test_update_kl_leaves_out_the_first_token(spark):
    rows = spark.createDataFrame([([-1.0, -2.0, -3.0], [0.0, 1.0, 1.0], [9.0, -5.0, -2.5, -2.0])], "logprobs array<double>, mask array<double>, new_logprobs array<double>")
    r = logprob.update_kl(rows).first()
    assert (r.kl_v1, r.kl_v2) == (-0.25, 0.3125)
    with pytest.raises(Exception, match="lengths differ"):
        logprob.update_kl(rows.withColumn("new_logprobs", F.array(F.lit(1.0)))).collect()


def test_temperature_agreement(spark):
    base = spark.createDataFrame([(1, t, -float(t)) for t in range(4)] + [(2, 0, -1.0)], "k long, token int, logprob double")
    tempered = spark.createDataFrame([(1, t, -2.0 * t + 7) for t in range(3)] + [(2, 0, -3.0)], "k long, token int, logprob double")
    got = {r.k: (r.tokens, r.pairs, r.mean_abs) for r in logprob.temperature_agreement(base, tempered, 0.5, ["k"]).collect()}
    assert got == {1: (3, 3, 0.0), 2: (1, 0, None)}


def test_protocols(spark):
    assert protocols.lookup("millrace.functions.text:strip") is text.strip
    with pytest.raises(ValueError):
        protocols.lookup("millrace.functions.text")
    prompts = spark.createDataFrame([("a",), ("b",)], "prompt string")
    done = protocols.TableCompleter(spark.createDataFrame([("a", [1], [-0.5]), ("b", [2], None)], "prompt string, tokens array<int>, logprobs array<double>")).complete(prompts)
    with pytest.raises(Exception, match="without log-probabilities"):
        done.select(protocols.TableCompleter.logprobs()).collect()
    with pytest.raises(ValueError, match="logprobs"):
        protocols.rolled_out_with(lambda df: df, prompts, ("logprobs",))


def test_file_logger(spark, tmp_path):
    log = protocols.FileLogger(str(tmp_path / "log"))
    log.log_config({"rate": 0.1, "f": len})
    log.log_metrics(spark.createDataFrame([("r", 1, "loss", 0.5)], "run_id string, step long, key string, value double"))
    log.close()
    assert "builtin" in log.config and spark.read.json(str(tmp_path / "log")).count() == 1
    with pytest.raises(ValueError, match="closed"):
        log.log_metrics(spark.range(1))


def test_long_texts_are_logged_once(spark, tmp_path):
    for _ in range(2):  # a run, and the same run started again
        log = protocols.FileLogger(str(tmp_path / "log"), "first")
        log.log_metrics(spark.createDataFrame([("r", 1, "loss", 0.5)], "run_id string, step long, key string, value double"))
        log.log_long_text("sample", spark.createDataFrame([(1, "a\nb"), (2, "c" * 10_000)], "step long, text string"))
        log.log_long_text("other", spark.createDataFrame([(1, None)], "step long, text string"))
        log.sync()
    assert sorted((r.key, r.step, r.text) for r in log.long_texts(spark).collect()) == [("other", 1, None), ("sample", 1, "a\nb"), ("sample", 2, "c" * 10_000)]
    assert log.location() == str(tmp_path / "log") and spark.read.json(log.location()).count() == 2
    log.close()
    for call in (log.sync, lambda: log.log_long_text("x", spark.range(1))):
        with pytest.raises(ValueError, match="closed"):
            call()


def test_coloured_text_is_the_text(spark):
    import re

    c = render.conversations(spark.createDataFrame([("c", 0, "user", "Hi"), ("c", 1, "assistant", "Yo")], "conv_id string, turn int, role string, text string"))
    shown = render.previewed(c, "role_colon", "conv_id").first().preview
    assert re.sub("\x1b\\[\\d+m", "", shown) == "User: Hi\n\nAssistant: Yo\n\nUser:" and "\x1b[32m Yo" in shown


def test_one_aggregate_for_metrics_keeps_trajectories_without_steps(spark):
    steps = spark.createDataFrame([("g", 0, [1, 2], [3], 1.0)], "group_id string, traj_idx int, ob_tokens array<int>, ac_tokens array<int>, reward double")
    trajectories = spark.createDataFrame([("g", 0, 0.5), ("g", 1, 0.25)], "group_id string, traj_idx int, final_reward double")
    r = trajectory.trajectory_metrics(steps, trajectories, spark.createDataFrame([("g", ["t"])], "group_id string, tags array<string>")).where("tag = 'all'").first()
    assert (r.total_episodes, r.total_turns, r.reward_total, r.turns_per_episode) == (2, 1, 0.875, 0.5)


def test_all_same(spark):
    same = lambda *xs: spark.createDataFrame([(x,) for x in xs], "x int").agg(trajectory.all_same("x")).first()[0]
    assert [same(1, 1), same(1, 2), same(), same(None, None), same(1, None)] == [True, False, True, True, False]


def test_truncation_by_tokens(spark):
    from millrace.functions import tokens

    cut = lambda s, n, **k: one(spark, tokens.truncated(n, **k)(F.lit(s)))
    assert [cut("aé日", n) for n in (1, 2, 3, 6)] == ["a", "a", "aé", "aé日"] and one(spark, tokens.truncated(3)(F.lit(None).cast("string"))) is None
    assert cut("x<|a|>yz", 2, specials=("<|a|>",)) == "x<|a|>"


def test_library_tokenizers(spark):
    public = pytest.importorskip("public_tokenizers")
    pytest.importorskip("tokenizers")
    pytest.importorskip("sentencepiece")
    from millrace.functions import tokens

    for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        path = public.path(name)
        ids = one(spark, tokens.encoder(path)(F.lit("some words here")))
        assert len(ids) < 8 and one(spark, tokens.decoder(path)(F.array(*[F.lit(i) for i in ids]))) == "some words here"
        assert one(spark, tokens.truncated(1, path)(F.lit("some words here"))).strip() == "some"
