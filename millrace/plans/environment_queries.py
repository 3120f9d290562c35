"""Queries on environments, preferences, log-probabilities and streams, over tables that stand in for them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import environment, evaluation, logprob, preference, render, rollout, runlog, trajectory
from ..sources import datasets
from ..sources.scratch import scratch_folder
from ..streaming import streams
from . import pipelines, protocols
from .registry import ORACLES, query
from .rollout_queries import _TOK, _rollouts, _streamed, _tokens

#: The example that comes before a problem, as the SQL expects it. A fixed value.
_EXAMPLE = "'User: How many r''s are in strawberry? Write your answer in \\boxed{} format.' || chr(10) || chr(10) || 'Assistant: Let''s spell the word out and number all the letters: 1) s 2) t 3) r 4) a 5) w 6) b 7) e 8) r 9) r 10) y. We have r''s at positions 3, 8, and 9. \\boxed{3}' || chr(10) || chr(10)"


@query(f"""SELECT p_partkey, {_EXAMPLE} || 'User: ' || p_name || ' Write your answer in \\boxed{{}} format.' || chr(10) || chr(10) || 'Assistant:' AS prompt, CASE WHEN k = 2 THEN NULL ELSE CAST(p_size + (k = 1)::INT AS VARCHAR) END AS given,
 CASE WHEN k = 2 OR p_partkey % 4 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS format, CASE WHEN k = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS correct, round((k = 0)::INT + 0.1 * ((k <> 2 AND p_partkey % 4 <> 0)::INT - 1), 6)::DOUBLE AS reward FROM (SELECT *, p_partkey % 3 AS k FROM part)""")
def math_environment(t):
    """Problems with their prompt; responses that are right, wrong, or without a box, a quarter of them cut off."""
    three, n = F.col("p_partkey") % 3, F.col("p_size")
    said = F.when(three == 2, "no box").otherwise(F.concat(F.lit("so \\boxed{"), (n + (three == 1).cast("int")).cast("string"), F.lit("}")))
    rows = environment.problem_prompts(t.part.withColumn("said", said), "role_colon", problem="p_name")
    out = environment.graded_math(rows.withColumn("answer", n.cast("string")), "said", "answer", F.col("p_partkey") % 4 != 0)
    return out.select("p_partkey", "prompt", "given", "format", "correct", F.round("reward", 6).alias("reward"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS format, CASE WHEN p_partkey % 3 = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS correct, round(CASE p_partkey % 3 WHEN 0 THEN -0.1 WHEN 1 THEN 1.0 ELSE 0.0 END, 6)::DOUBLE AS reward, 7 * (p_size % 3 + 1) + 5 AS seconds FROM part")
def code_environment(t):
    """Whether a program passed its tests is a column: nothing is run."""
    three = F.col("p_partkey") % 3
    rows = t.part.withColumns({"said": F.when(three == 0, "no code").otherwise("```python\nx\n```"), "passed": three != 2, "tests": F.array_repeat(F.lit("t"), (F.col("p_size") % 3 + 1).cast("int"))})
    out = environment.graded_code(rows, "said", "passed")
    return out.select("p_partkey", "format", "correct", F.round("reward", 6).alias("reward"), environment.test_timeout(6, "tests").alias("seconds"))


@query("""SELECT o_custkey, CAST(CASE k WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 5 WHEN 3 THEN 2 ELSE 2 END AS INT) AS turns, CAST(CASE k WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 2 THEN 5 WHEN 3 THEN 2 ELSE 1 END AS INT) AS calls, k IN (1, 2, 3) AS failed,
 CASE k WHEN 0 THEN 1.0 WHEN 4 THEN 0.0 END::DOUBLE AS format, CASE k WHEN 0 THEN 1.0 WHEN 4 THEN 0.0 END::DOUBLE AS correct, round(CASE k WHEN 0 THEN 1.0 WHEN 4 THEN -0.1 ELSE 0.0 END, 6)::DOUBLE AS reward FROM (SELECT DISTINCT o_custkey, o_custkey % 5 AS k FROM orders)""")
def search_replay(t):
    """Logged episodes: an answer after two calls, another tool, a call too many, an observation too long, an answer of the wrong form."""
    k = F.col("k")
    turns = t.orders.select("o_custkey").distinct().withColumn("k", F.col("o_custkey") % 5).withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(5))))
    answers = ((k == 0) & (F.col("turn") >= 2)) | ((k == 4) & (F.col("turn") >= 1))
    tools = F.when(~answers, F.when(k == 1, F.array(F.lit("other"))).otherwise(F.array(F.lit("search"))))
    turns = turns.withColumns({
        "tools": tools, "content": F.when(k == 0, "Answer: The Tower!").otherwise("I don't know"), "parsed": F.lit(True), "tool_ok": F.lit(True),
        "next_tokens": F.when((k == 3) & (F.col("turn") == 1), 10**6).otherwise(100), "gold": F.array(F.lit("x"), F.lit("tower")),
    })
    return environment.search_episodes(turns, ["o_custkey"]).withColumn("reward", F.round("reward", 6))


@query("""WITH e AS (SELECT user_id, event_id % 7 AS said, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn FROM events), f AS (SELECT *, coalesce(min(turn) FILTER (said = 3) OVER (PARTITION BY user_id), 10) AS stop FROM e WHERE turn <= 10)
SELECT user_id, CAST(count(*) AS INT) AS turns, bool_or(said = 3) AS won, sum(CASE said WHEN 3 THEN 1.0 WHEN 6 THEN -1.0 ELSE 0.0 END)::DOUBLE AS reward FROM f WHERE turn <= stop GROUP BY user_id""")
def guessing_games(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    said = F.when(F.col("event_id") % 7 == 6, "no guess").otherwise(F.concat(F.lit("Guess: "), (F.col("event_id") % 7).cast("string")))
    turns = t.events.select("user_id", F.row_number().over(w).alias("turn"), said.alias("content"), F.lit(3).alias("gold"))
    return environment.guessing_games(turns, ["user_id"])


@query("WITH w AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn FROM events) SELECT user_id, CAST(min(turn) FILTER (event_type = 'purchase') AS INT) AS won_at, CASE WHEN min(turn) FILTER (event_type = 'purchase') IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS reward, CAST(coalesce(min(turn) FILTER (event_type = 'purchase'), max(turn)) AS INT) AS turns FROM w WHERE turn <= 20 GROUP BY user_id")
def word_games(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    turns = t.events.select("user_id", F.row_number().over(w).alias("turn"), F.concat(F.lit("Guess: "), F.upper("event_type")).alias("content"), F.lit("Purchase").alias("answer"))
    return environment.word_games(turns, ["user_id"])


@query("""WITH c AS (SELECT DISTINCT conv_id FROM conversations), g AS (SELECT source, count(*) AS n FROM documents GROUP BY source)
SELECT 'sft' AS stage, count(*) AS n FROM c UNION ALL SELECT 'reward_model', count(*) FILTER (conv_id % 4 > 0) FROM c UNION ALL SELECT 'evaluation', 2 * least(count(*) FILTER (conv_id % 4 = 0), 256) FROM c
UNION ALL SELECT 'matches', CAST(sum((n // 4) * 12 + (n % 4) * (n % 4 - 1)) AS BIGINT) FROM g""")
def preference_recipe(t):
    """How many rows each stage of preference learning reads."""
    pairs = _pairs(t)
    players = t.documents.select(F.col("source").alias("group_id"), (F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1).alias("idx"))
    tables = pipelines.preference_recipe(render.conversations(t.conversations), (pairs.where("conv_id % 4 > 0"), pairs.where("conv_id % 4 = 0")), "conv_id", "llama3", players)
    return datasets.concatenated(*[df.agg(F.lit(name).alias("stage"), F.count("*").alias("n")) for name, df in tables.items()])


_TOTALS = "SELECT user_id AS group_id, event_type AS traj_idx, sum(event_id % 2) AS steps, count(*) AS n FROM events GROUP BY ALL"


@query(f"SELECT group_id, traj_idx, round(steps, 6)::DOUBLE AS plain, round(steps + rank, 6)::DOUBLE AS ranked FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY traj_idx) - 1 AS rank FROM ({_TOTALS}))")
def group_rollouts(t):
    """Rollouts whose group gives no reward, and others whose group rewards its members by their place, from a function of the group."""
    steps, trajectories, _ = _rollouts(t)
    plain = environment.rolled_out(steps, trajectories).select("group_id", "traj_idx", F.round("total_reward", 6).alias("plain"))
    ranked = environment.rolled_out(steps, trajectories, lambda members: members["traj_idx"].rank() - 1).select("group_id", "traj_idx", F.round("total_reward", 6).alias("ranked"))
    return plain.join(ranked, ["group_id", "traj_idx"])


@query("SELECT p_partkey AS group_id, CAST(step AS INT) AS step_idx, CASE WHEN step = 0 THEN 2 ELSE 0 END AS n_seen, CASE WHEN step = 0 THEN 1 ELSE 0 END AS n_said, step = p_partkey % 3 AS done, CASE WHEN p_partkey % 2 = 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS final_reward, CAST(p_partkey % 2 AS INT) AS n_metrics FROM part, range(p_partkey % 3 + 1) r(step)")
def rollout_states(t):
    """States of another library: only the first step has tokens, every second state a reward, the others a metric."""
    kind = "struct<tokens:struct<prompt_ids:array<int>,completion_ids:array<int>,completion_logprobs:array<double>>>"
    full = F.struct(F.struct(F.array(F.lit(1), F.lit(2)).alias("prompt_ids"), F.array(F.lit(3)).alias("completion_ids"), F.array(F.lit(-0.5)).alias("completion_logprobs")).alias("tokens")).cast(kind)
    empty = F.struct(F.lit(None).cast("struct<prompt_ids:array<int>,completion_ids:array<int>,completion_logprobs:array<double>>").alias("tokens")).cast(kind)
    odd = F.col("p_partkey") % 2 == 1
    states = t.part.select(F.col("p_partkey").alias("group_id"), F.lit(0).alias("traj_idx"), F.concat(F.array(full), F.array_repeat(empty, (F.col("p_partkey") % 3).cast("int"))).alias("trajectory"), F.when(~odd, 0.5).alias("reward"), F.when(odd, F.create_map(F.lit("m"), F.lit(1.0))).alias("metrics"))
    steps, trajectories = environment.states_to_rollouts(states)
    return steps.join(trajectories, ["group_id", "traj_idx"]).select("group_id", "step_idx", F.size("ob_tokens").alias("n_seen"), F.size("ac_tokens").alias("n_said"), "done", "final_reward", F.size("metrics").alias("n_metrics"))


@query("SELECT o_custkey, round(n / 2.0, 6)::DOUBLE AS speed_1, round(n / 4.0, 6)::DOUBLE AS speed_2, -50.0::DOUBLE AS faster_percent FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)")
def turn_speeds(t):
    own = t.orders.groupBy("o_custkey").agg(F.count("*").alias("tokens")).withColumn("turn", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("seconds", F.col("turn") * F.lit(2.0))
    out = environment.turn_speeds(own, ["o_custkey"])
    return out.select("o_custkey", *[F.round(c, 6).alias(c) for c in ("speed_1", "speed_2", "faster_percent")])


_SEGMENTS = "SELECT user_id AS group_id, event_type AS traj_idx, (row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1) // 4 AS segment FROM events"


@query(f"SELECT group_id, traj_idx, CAST(segment AS INT) AS segment, CAST(2 * count(*) AS INT) AS n, (2 * count(*))::DOUBLE AS n_trained FROM ({_SEGMENTS}) GROUP BY ALL")
def trajectory_to_training_rows(t):
    """Observations grow by what was said, but start anew every fourth step."""
    e = t.events.select(F.col("user_id").alias("group_id"), F.col("event_type").alias("traj_idx"), "event_id", "ts")
    w = Window.partitionBy("group_id", "traj_idx").orderBy("ts", "event_id")
    e = e.withColumn("step_idx", F.row_number().over(w) - 1).withColumn("block", F.floor(F.col("step_idx") / 4))
    past = F.collect_list("event_id").over(Window.partitionBy("group_id", "traj_idx", "block").orderBy("step_idx").rowsBetween(Window.unboundedPreceding, -1))
    ob = F.concat(F.array(F.col("block").cast("bigint")), F.flatten(F.transform(past, lambda x: F.array(x, x + 1))))
    steps = e.select("group_id", "traj_idx", "step_idx", ob.alias("ob_tokens"), F.array("event_id", F.col("event_id") + 1).alias("ac_tokens"), F.array(F.lit(-0.5), F.lit(-0.25)).alias("ac_logprobs"))
    adv = steps.select("group_id", "traj_idx").distinct().withColumn("advantage", F.lit(1.0))
    out = trajectory.training_rows(steps, adv)
    return out.select("group_id", "traj_idx", "segment", F.size("input_tokens").alias("n"), F.aggregate("mask", F.lit(0.0), lambda s, x: s + x).alias("n_trained"))


def _pairs(t):
    """Comparisons of conversations: the second completion is longer, every third is preferred."""
    c = render.conversations(t.conversations).select("conv_id", F.transform("messages", lambda m: F.struct(m["role"], m["content"])).alias("prompt_conversation"))
    one = lambda x: F.array(preference.message("assistant", F.lit(x)))
    return c.withColumns({"completion_a": one("yes"), "completion_b": one("no, never"), "label": F.when(F.col("conv_id") % 3 == 0, "A").when(F.col("conv_id") % 3 == 1, "B").otherwise("Tie")})


@query("""WITH h AS (SELECT strlen('<|start_header_id|><|end_header_id|>') + 2 AS head, strlen('<|eot_id|>') AS tail),
 c AS (SELECT conv_id, sum(head + strlen(role) + strlen(text) + tail) AS said FROM conversations, h GROUP BY conv_id)
SELECT conv_id, CAST(strlen('<|begin_of_text|>') + said + 5 * (head + tail) + strlen('systemsystemsystem' || '==== Completion A ====' || '==== Completion B ====' || '==== Preference ====') + strlen('assistantassistant' || 'yes' || 'no, never') + head + strlen('assistant') + 1 AS BIGINT) AS n_tokens, 1 AS n_trained FROM c, h""")
def reward_model_examples(t):
    """A reward model's examples end with the first byte of the label."""
    out = preference.reward_model_examples(_pairs(t), "conv_id", "llama3")
    return out.select("conv_id", F.size("tokens").cast("bigint").alias("n_tokens"), F.size(F.filter("weights", lambda w: w > 0)).alias("n_trained"))


@query("""SELECT conv_id, CASE conv_id % 2 WHEN 0 THEN -1.0 ELSE 1.0 END::DOUBLE AS r0, 0.0::DOUBLE AS r1, ends FROM (SELECT DISTINCT conv_id, TRUE AS ends FROM conversations) WHERE conv_id % 5 <> 0""")
def judged_both_ways(t):
    """A judge's verdicts in either order; where one is missing there is no score. Prompts end with the heading of the verdict."""
    pairs = _pairs(t)
    prompts = preference.preference_prompts(pairs, "conv_id", "role_colon").select("conv_id", F.endswith("prompt", F.lit("System: ==== Preference ====\n\nAssistant:")).alias("ends"))
    verdict = F.when(F.col("swapped"), "Tie").when(F.col("conv_id") % 2 == 0, "A").otherwise("B")
    judged = pairs.select("conv_id", F.explode(F.array(F.lit(False), F.lit(True))).alias("swapped")).where("NOT (swapped AND conv_id % 5 = 0)").withColumn("verdict", verdict)
    return preference.both_ways_scores(pairs, judged, "conv_id").join(prompts, "conv_id").select("conv_id", "r0", "r1", "ends")


@query("""WITH s AS (SELECT conv_id, label, ('0x' || substr(md5(CAST(conv_id AS VARCHAR) || ':4'), 1, 1))::INT % 2 = 0 AS swap FROM (SELECT DISTINCT conv_id, CASE conv_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'Tie' END AS label FROM conversations))
SELECT conv_id, CASE WHEN swap THEN 'no, never' ELSE 'yes' END AS first, CASE WHEN NOT swap OR label = 'Tie' THEN label WHEN label = 'A' THEN 'B' ELSE 'A' END AS label, CASE WHEN swap THEN 1.0 ELSE -1.0 END::DOUBLE AS score FROM s""")
def random_swap(t):
    """Half of the pairs swapped, and what a judge of lengths says after white space is dropped."""
    said = lambda c: F.element_at(c, 1)["content"]
    swapped = preference.random_swap(_pairs(t), "conv_id", 4).withColumns({"a": said("completion_a"), "b": said("completion_b")})
    judged = preference.judged_pairs(swapped, lambda a, b: preference.shorter_wins(F.length(a), F.length(b)), text.strip, "a", "b")
    return judged.select("conv_id", F.col("a").alias("first"), "label", "score")


@query("""SELECT conv_id, 'q' || conv_id AS prompt, CASE WHEN conv_id % 2 = 0 THEN 'yes' ELSE 'no' END AS chosen, 'A' AS label, CASE conv_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' END AS rated FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 3 < 2""")
def rated_pairs(t):
    rows = t.conversations.select("conv_id").distinct().withColumns({"prompt": F.concat(F.lit("q"), F.col("conv_id").cast("string")), "overall_preference": F.when(F.col("conv_id") % 3 == 0, -2).when(F.col("conv_id") % 3 == 1, 1).otherwise(0)})
    even = F.col("conv_id") % 2 == 0
    pairs = preference.chosen_rejected(rows, "prompt", F.when(even, "yes").otherwise("no"), F.when(even, "no").otherwise("yes"))
    rated = preference.rated_comparisons(rows.select("conv_id", "overall_preference")).select("conv_id", F.col("label").alias("rated"))
    return pairs.join(rated, "conv_id").select("conv_id", F.element_at("prompt_conversation", 1)["content"].alias("prompt"), F.element_at("completion_a", 1)["content"].alias("chosen"), "label", "rated")


@query("SELECT o_orderkey AS datum_id, o_custkey % 3 AS dataset_idx, 't' || (o_custkey % 3) AS teacher, 2 + o_orderkey % 2 AS n_teacher FROM orders")
def teacher_lookup(t):
    """Each training row's teacher by its group's dataset, and the tokens that the teacher sees by its trajectory's environment."""
    o = t.orders.select(F.col("o_orderkey").alias("datum_id"), F.col("o_custkey").alias("group_id"), F.col("o_orderkey").alias("traj_idx"))
    datums = o.withColumns({"target_tokens": F.array(F.lit(5), F.lit(6)), "mask": F.array(F.lit(1.0), (F.col("datum_id") % 2).cast("double"))})
    groups = o.select("group_id").distinct().withColumn("dataset_idx", F.col("group_id") % 3)
    teachers = t.spark.createDataFrame([(i, f"t{i}") for i in range(3)], "dataset_idx long, teacher string")
    environments = o.select("group_id", "traj_idx", F.array(F.lit(1)).alias("teacher_prompt"))
    out = logprob.with_teacher_prompts(logprob.with_teachers(datums, groups, teachers), environments)
    return out.select("datum_id", "dataset_idx", "teacher", F.size("teacher_tokens").cast("bigint").alias("n_teacher"))


def _token_lists(t):
    part = F.array_sort(F.collect_list(F.struct("lp", "base", "mask")))
    own = _tokens(t).groupBy("l_orderkey").agg(part.alias("p"))
    take = lambda c: F.transform("p", lambda x: x[c])
    return own.select("l_orderkey", take("lp").alias("logprobs"), take("base").alias("base"), take("mask").alias("mask"))


@query(f"SELECT round(avg(lp - base), 6) AS kl_v1, round(0.5 * avg((lp - base) * (lp - base)), 6) AS kl_v2 FROM ({_TOK}) WHERE mask > 0")
def update_kl(t):
    """The new policy gives a value for the first token too, which has no counterpart."""
    rows = _token_lists(t).withColumn("new_logprobs", F.concat(F.array(F.lit(9.0)), "base"))
    return logprob.update_kl(rows).select(F.round("kl_v1", 6).alias("kl_v1"), F.round("kl_v2", 6).alias("kl_v2"))


@query(f"SELECT l_orderkey, round(sum(exp(base - lp) * mask), 6) AS importance, round(-sum(base * mask), 6) + 0.0 AS cross_entropy, round(sum(base * mask), 6) + 0.0 AS custom FROM ({_TOK}) GROUP BY l_orderkey")
def surrogate_losses(t):
    rows = _token_lists(t).select("l_orderkey", "logprobs", F.col("base").alias("new_logprobs"), "mask", F.col("mask").alias("advantages"))
    custom = logprob.custom_loss(_tokens(t), F.sum(F.col("base") * F.col("mask")), ["l_orderkey"]).select("l_orderkey", (F.round("loss", 6) + 0.0).alias("custom"))
    out = logprob.surrogate_losses(rows).select("l_orderkey", F.round("importance", 6).alias("importance"), (F.round("cross_entropy", 6) + 0.0).alias("cross_entropy"))
    return out.join(custom, "l_orderkey")


@query(f"SELECT l_orderkey, round(sum((lp - base) * mask), 6) + 0.0 AS total_kl, round(sum((lp - base) * mask) / greatest(sum(mask), 1), 6) + 0.0 AS mean_kl, CAST(sum(mask) AS BIGINT) AS n_generated FROM ({_TOK}) GROUP BY l_orderkey")
def token_reports(t):
    rows = _token_lists(t).select("l_orderkey", "logprobs", F.col("base").alias("teacher_logprobs"), "mask")
    out = logprob.token_report_totals(logprob.token_report(rows, "l_orderkey"), "l_orderkey")
    return out.select("l_orderkey", (F.round("total_kl", 6) + 0.0).alias("total_kl"), (F.round("mean_kl", 6) + 0.0).alias("mean_kl"), "n_generated")


@query("""WITH b AS (SELECT o_custkey, o_orderkey AS token, -o_totalprice / 100000 AS x, -o_totalprice / 50000 + 0.01 * (o_orderkey % 3) AS y FROM orders WHERE o_orderkey % 4 <> 0),
 e AS (SELECT a.o_custkey, abs((a.y - b.y) - (a.x - b.x) / 0.5) AS e FROM b a JOIN b ON a.o_custkey = b.o_custkey AND a.token < b.token)
SELECT o_custkey, count(*) AS tokens, (SELECT count(*) FROM e WHERE e.o_custkey = b.o_custkey) AS pairs, round((SELECT avg(e) FROM e WHERE e.o_custkey = b.o_custkey), 6) AS mean_abs, round((SELECT max(e) FROM e WHERE e.o_custkey = b.o_custkey), 6) AS max_abs FROM b GROUP BY o_custkey""")
def temperature_agreement(t):
    """Tokens of a customer's orders; a quarter is only known at temperature one."""
    o = t.orders.select("o_custkey", F.col("o_orderkey").alias("token"), "o_totalprice")
    base = o.select("o_custkey", "token", (-F.col("o_totalprice") / 100000).alias("logprob"))
    tempered = o.where("token % 4 <> 0").select("o_custkey", "token", (-F.col("o_totalprice") / 50000 + 0.01 * (F.col("token") % 3)).alias("logprob"))
    out = logprob.temperature_agreement(base, tempered, 0.5, ["o_custkey"])
    return out.select("o_custkey", "tokens", "pairs", F.round("mean_abs", 6).alias("mean_abs"), F.round("max_abs", 6).alias("max_abs"))


@query("SELECT CAST(max(o_custkey) AS BIGINT) AS step_max, CAST(min(o_custkey) AS BIGINT) AS step_min, round(avg(o_custkey), 6) AS step_mean, round(max(o_totalprice), 6) AS sampling_time_max, round(min(o_totalprice), 6) AS sampling_time_min, round(avg(o_totalprice), 4) AS sampling_time_mean FROM orders")
def sampling_summary(t):
    out = trajectory.sampling_summary(t.orders.select(F.col("o_custkey").alias("sampled_at_step"), F.col("o_totalprice").alias("seconds")))
    return out.select(*[F.round(c, 4 if c == "sampling_time_mean" else 6).alias(c) if dict(out.dtypes)[c] == "double" else F.col(c) for c in out.columns])


@query("SELECT round(avg(length(text)), 6) AS mean_length FROM documents WHERE doc_id % 3 <> 0")
def mean_feedback_length(t):
    out = trajectory.mean_length(t.documents.select(F.when(F.col("doc_id") % 3 != 0, F.col("text")).alias("feedback")), "feedback")
    return out.select(F.round("mean_length", 6).alias("mean_length"))


@query("SELECT round(avg(event_id % 7), 6) AS mean_kept, CAST(sum(event_id % 3 + 1) AS BIGINT) AS input_tokens, CAST(sum(event_id % 5) AS BIGINT) AS output_tokens, CAST(sum(event_id % 3 + 1 + event_id % 5) AS BIGINT) AS total_tokens, FALSE AS has_mask FROM events")
def token_usage(t):
    n = lambda m, k=0: F.array_repeat(F.lit(1), (F.col("event_id") % m + k).cast("int"))
    rows = t.events.select(n(3, 1).alias("seen"), n(5).alias("said"), n(7).alias("mask"))
    kept = rows.agg(F.round(F.avg(F.size("mask")), 6).alias("mean_kept"))
    usage = evaluation.token_usage(logprob.training_columns(rows), "seen", "said")
    return kept.join(usage, F.lit(True)).withColumn("has_mask", F.lit("mask" in logprob.training_columns(rows).columns))


@query("""WITH t AS (SELECT conv_id, upper(left(role, 1)) || lower(substr(role, 2)) || ': ' || text AS said, role, text, max(turn) OVER (PARTITION BY conv_id) = turn AS last FROM conversations),
 c AS (SELECT conv_id, sum(strlen(said) + 2 + CASE WHEN NOT last THEN 0 WHEN role = 'assistant' THEN 5 ELSE 8 END) - 1 AS n, sum(CASE WHEN role = 'assistant' THEN strlen(text) + 3 + CASE WHEN last THEN 5 ELSE 0 END ELSE 0 END) AS w FROM t GROUP BY conv_id)
SELECT count(*) AS num_sequences, CAST(sum(n) AS BIGINT) AS num_tokens, CAST(sum(w) AS BIGINT) AS num_loss_tokens FROM c""")
def batch_counters(t):
    c = render.conversations(t.conversations)
    stats = c.select(render.byte_stats(render.pieces(c, "role_colon", "all_assistant_messages")).alias("s")).select("s.*")
    return render.counters(stats)


_GREEN, _YELLOW, _RESET = "chr(27) || '[32m'", "chr(27) || '[33m'", "chr(27) || '[0m'"


@query(f"""SELECT conv_id, string_agg({_YELLOW} || upper(left(role, 1)) || lower(substr(role, 2)) || ':' || {_RESET} || CASE WHEN role = 'assistant' THEN {_GREEN} ELSE {_YELLOW} END || ' ' || text || chr(10) || chr(10) || CASE WHEN NOT last THEN '' WHEN role = 'assistant' THEN 'User:' ELSE '<UNUSED>' END || {_RESET}, '' ORDER BY turn) AS preview
FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) = turn AS last FROM conversations) WHERE conv_id IN (SELECT DISTINCT conv_id FROM conversations ORDER BY conv_id LIMIT 100) GROUP BY conv_id""")
def render_preview(t):
    """The feature is the limit: the first hundred conversations as they are trained on, in colour."""
    return render.previewed(render.conversations(t.conversations), "role_colon", "conv_id", "all_assistant_messages")


@query("SELECT p_partkey, CAST(n AS BIGINT) AS n, CASE WHEN n % 2 = 1 THEN '1' ELSE '1,2' END AS content, n % 2 = 1 AS ok, '0:1:0|1:' || n || ':1|' || (n + 1) || ':2:-1' AS runs FROM (SELECT p_partkey, p_size % 4 + 1 AS n FROM part)")
def stop_tokens_and_runs(t):
    """Responses cut at their stop token, and stretches of equal weight sign."""
    rows = t.part.select("p_partkey", (F.col("p_size") % 4 + 1).cast("bigint").alias("n"))
    answer = F.when(F.col("n") % 2 == 1, F.array(F.lit(1), F.lit(99))).otherwise(F.array(F.lit(1), F.lit(2)))
    weights = F.concat(F.array(F.lit(0.0)), F.array_repeat(F.lit(0.5), F.col("n").cast("int")), F.array(F.lit(-1.0), F.lit(-2.0)))
    parsed, join = render.parse_stop(answer, 99), lambda x: F.array_join(F.transform(x, lambda v: v.cast("string")), ",")
    runs = F.array_join(F.transform(render.weight_runs(weights), lambda r: F.concat_ws(":", r["start"].cast("string"), r["length"].cast("string"), r["w"].cast("string"))), "|")
    return rows.select("p_partkey", "n", join(parsed["tokens"]).alias("content"), parsed["ok"].alias("ok"), runs.alias("runs"))


@query("""SELECT conv_id, '<|start|>system<|message|>You are ChatGPT, a large language model trained by OpenAI.' || chr(10) || 'Knowledge cutoff: 2024-06' || chr(10) || 'Current date: 2025-03-04' || chr(10) || chr(10) || 'Reasoning: high' || chr(10) || chr(10) || '# Valid channels: analysis, commentary, final. Channel must be included for every message.<|end|>'
 || string_agg('<|start|>' || role || CASE WHEN role = 'assistant' THEN CASE WHEN last THEN '<|channel|>analysis<|message|>hm<|end|><|start|>assistant' ELSE '' END || '<|channel|>final' ELSE '' END || '<|message|>' || text || CASE WHEN last THEN '<|return|>' ELSE '<|end|>' END, '' ORDER BY turn) AS rendered
FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) = turn AS last FROM conversations) GROUP BY conv_id""")
def sft_render_gpt_oss_reasoning(t):
    """With a system message, and with thoughts, of which only the last message shows its own."""
    c = render.conversations(t.conversations).select("conv_id", F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), F.lit("hm").alias("thinking"))).alias("messages"))
    return c.select("conv_id", render.rendered(render.pieces(c, "gpt_oss_high_reasoning", "all_messages", date="2025-03-04")).alias("rendered"))


@query("""SELECT conv_id, CAST(sum(strlen(text) + 10) FILTER (turn % 2 = 1) AS BIGINT) AS n_trained, bool_and(TRUE) AS has_call FROM conversations GROUP BY conv_id""")
def customized_training(t):
    """Every second message is trained on; messages of assistants have tool calls in their text."""
    call = F.lit("\n<tool_call>\n{}\n</tool_call>")
    c = render.conversations(t.conversations).select("conv_id", F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), call.alias("tool_text"), (m["turn"] % 2 == 1).alias("trainable"))).alias("messages"))
    parts = render.pieces(c, "qwen3_instruct", "customized")
    trained = F.aggregate(F.filter(parts, lambda p: p["w"] > 0), F.lit(0).cast("bigint"), lambda s, p: s + F.octet_length(p["text"]) - F.octet_length(call))
    return c.select("conv_id", F.nullif(trained, F.lit(0).cast("bigint")).alias("n_trained"), F.contains(render.rendered(parts), call).alias("has_call"))


@query("""SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN NULL ELSE 'a' || conv_id END AS completion, CASE WHEN conv_id % 3 = 0 THEN 0 ELSE 2 END AS n_logprobs, CASE WHEN conv_id % 2 = 0 THEN 'd' || conv_id ELSE '' END AS found FROM (SELECT DISTINCT conv_id FROM conversations)""")
def offline_completions(t):
    """Completions and tool results that were made before, looked up."""
    number = F.col("conv_id").cast("string")
    prompts = t.conversations.select("conv_id").distinct().withColumns({"prompt": F.concat(F.lit("p"), number), "query": F.concat(F.lit("q"), number)})
    known = prompts.where("conv_id % 3 <> 0").select("prompt", F.concat(F.lit("a"), number).alias("completion"), F.array(F.lit(-0.5), F.lit(-1.0)).alias("logprobs"))
    results = prompts.where("conv_id % 2 = 0").select("query", F.array(F.concat(F.lit("d"), number)).alias("documents"))
    done = protocols.rolled_out_with(protocols.TableCompleter(known).complete, prompts, ("completion", "logprobs"))
    done = done.withColumn("n_logprobs", F.when(F.col("completion").isNotNull(), F.size(protocols.TableCompleter.logprobs())).otherwise(0))
    return protocols.TableTool(results).invoke(done).select("conv_id", "completion", "n_logprobs", F.array_join("documents", ",").alias("found"))


@query("SELECT 'exact/accuracy' AS key, round(avg((doc_id % 3 = 0)::INT), 6) AS value FROM documents UNION ALL SELECT 'length/mean', round(avg(length(source)), 6) FROM documents")
def evaluators(t):
    """Several evaluators of one table of responses: a grader looked up by name, and a mean."""
    grader = protocols.lookup("millrace.functions.text:contains_answer")
    responses = t.documents.select(F.when(F.col("doc_id") % 3 == 0, F.upper("source")).otherwise("nothing").alias("said"), "source")
    exact = lambda r: protocols.graded_with(r, grader, "said", "source").agg(F.avg(F.col("correct").cast("int")).alias("value")).select(F.lit("accuracy").alias("key"), "value")
    length = lambda r: r.agg(F.avg(F.length("source")).alias("value")).select(F.lit("mean").alias("key"), "value")
    return protocols.evaluated(responses, {"exact": exact, "length": length}).withColumn("value", F.round("value", 6))


@query("""WITH g AS (SELECT conv_id AS group_id, CAST(conv_id % 13 AS BIGINT) AS s FROM (SELECT DISTINCT conv_id FROM conversations)) SELECT group_id, CASE WHEN 12 - s <= 5 THEN 'train' ELSE 'queue' END AS goes_to FROM g""")
def stale_and_fresh(t):
    groups = t.conversations.select(F.col("conv_id").alias("group_id")).distinct().withColumn("sampled_at_step", F.col("group_id") % 13)
    fresh, stale = streams.fresh_and_stale(groups, 12, 5)
    return fresh.select("group_id", F.lit("train").alias("goes_to")).union(stale.select("group_id", F.lit("queue")))


@query("SELECT batch_idx, 64 AS n, 64 AS distinct_items FROM (SELECT unnest(range(count(*) // 64)) AS batch_idx FROM events)")
def stream_shuffled_batches(t):
    """Batches of a stream, shuffled as they come; rows that fill no batch wait, and are dropped at the end."""
    from ..sources.readers import table_stream

    folder = scratch_folder(t.spark, "shuffled_batches")
    sink = streams.ShuffledBatches(folder, "event_id", 64, seed=3)
    source = table_stream(t.spark, f"{t.folder}/events.parquet*", t.events.schema).select("event_id")
    source.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return sink.batches(t.spark).groupBy("batch_idx").agg(F.count("*").cast("int").alias("n"), F.countDistinct("event_id").cast("int").alias("distinct_items"))


@query("""WITH e AS (SELECT ts, unnest([0, 30]) AS back FROM events), w AS (SELECT time_bucket(INTERVAL 30 minute, ts) - INTERVAL 1 minute * back AS start FROM e), m AS (SELECT max(ts) AS last FROM events)
SELECT start, count(*) AS n FROM w, m WHERE start + INTERVAL 60 minute <= last - INTERVAL 10 minute GROUP BY start""")
def stream_sliding(t):
    """An extension: windows of an hour every half hour. Windows that the watermark has not passed are not written."""
    out = _streamed(t, lambda s: streams.tumbling(s.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "value", "60 minutes", slide="30 minutes"), "sliding", None)
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 hour OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e), m AS (SELECT max(ts) AS last FROM events)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s, m GROUP BY user_id, k, last HAVING max(ts) + INTERVAL 6 hour <= last - INTERVAL 10 minute""")
def stream_sessions(t):
    """An extension: sessions that end after six hours without an event."""
    out = _streamed(t, lambda s: streams.sessions(s.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "6 hours", "user_id"), "sessions", None)
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")




@query("""WITH e AS (SELECT user_id AS pid, event_id AS tid, event_type AS name, epoch_us(ts) AS us FROM events)
SELECT pid, tid, name, 1 AS depth, us AS begin_ts, us + 100 AS end_ts FROM e UNION ALL SELECT pid, tid, 'part', 2, us + 10, us + 20 FROM e UNION ALL SELECT pid, tid, 'part', 2, us + 30, us + 45 FROM e""")
def nested_trace_spans(t):
    """Every event is a span with two parts of one name inside it."""
    e = t.events.select(F.col("user_id").alias("pid"), F.col("event_id").alias("tid"), "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    marks = [("B", 0, None), ("B", 10, "part"), ("E", 20, "part"), ("B", 30, "part"), ("E", 45, "part"), ("E", 100, None)]
    rows = F.array(*[F.struct(F.lit(ph).alias("ph"), (F.col("us") + at).alias("ts"), F.lit(i).alias("line_no"), (F.col("event_type") if n is None else F.lit(n)).alias("name")) for i, (ph, at, n) in enumerate(marks)])
    events = e.select("pid", "tid", F.inline(rows))
    return runlog.spans(events).select("pid", "tid", "name", "depth", "begin_ts", "end_ts")


@query("SELECT o_custkey, array_to_string(list(round(o_totalprice, 3) ORDER BY o_orderkey, o_totalprice), ' ') AS rewards, round(stddev_pop(o_totalprice), 4) AS std FROM orders GROUP BY o_custkey")
def rollout_rewards(t):
    out = evaluation.rollout_matrix(t.orders, "o_custkey", "o_orderkey", "o_totalprice")
    return out.select("o_custkey", F.array_join(F.transform("rewards", lambda r: r.cast("string")), " ").alias("rewards"), F.round("std", 4).alias("std"))


@query(r"""WITH t AS (SELECT conv_id, turn, turn = min(turn) OVER (PARTITION BY conv_id) AS fst, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS text FROM conversations)
SELECT conv_id, string_agg(CASE WHEN fst THEN 'user' ELSE 'assistant' END || ':' || text, '|' ORDER BY turn) AS prompt, 'assistant:yes' AS a, 'assistant:no' AS b, 'A' AS label FROM t GROUP BY conv_id""")
def hhh_turns(t):
    """Transcripts whose first turn is a person's and the others an assistant's, as messages; they differ in the last one."""
    said = t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda m: m["text"]), " Assistant: ").alias("s"))
    pairs = said.select("conv_id", F.concat(F.lit("Human: "), F.col("s"), F.lit(" Assistant: yes")).alias("chosen"), F.concat(F.lit("Human: "), F.col("s"), F.lit(" Assistant: no")).alias("rejected"))
    shown = lambda c: F.array_join(F.transform(c, lambda m: F.concat_ws(":", m["role"], m["content"])), "|")
    return preference.hhh_comparisons(pairs).select("conv_id", shown("prompt_conversation").alias("prompt"), shown("completion_a").alias("a"), shown("completion_b").alias("b"), "label")


@query("""SELECT conv_id, string_agg(role || ': ' || text, '|' ORDER BY turn) || '|system: ==== Completion A ====|assistant: yes|system: ==== Completion B ====|assistant: no, never|system: ==== Preference ====|assistant: ' || CASE conv_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'Tie' END AS shown FROM conversations GROUP BY conv_id""")
def comparison_shown(t):
    """A comparison as one conversation, with its label, in full."""
    m = _pairs(t).select("conv_id", preference.comparison_conversation(with_label=True).alias("m"))
    return m.select("conv_id", F.array_join(F.transform("m", lambda x: F.concat_ws(": ", x["role"], x["content"])), "|").alias("shown"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE 'no answer' END AS extracted, CASE WHEN n_nationkey % 2 = 0 THEN 'the ' || n_name ELSE 'x' END AS said, n_nationkey % 2 = 0 AS matches FROM nation")
def gold_matches(t):
    """Answers held against several gold ones: equal but for case, articles and punctuation, or different."""
    even = F.col("n_nationkey") % 2 == 0
    said = F.when(even, F.concat(F.lit("the "), "n_name")).otherwise("x")
    given = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("Answer: "), "n_name", F.lit("\n"))).otherwise("nothing")
    return t.nation.select(F.col("n_nationkey"), F.coalesce(text.single_answer(given), F.lit("no answer")).alias("extracted"), said.alias("said"), text.matches_any(said, F.array(F.lit("other"), F.concat(F.lower("n_name"), F.lit("!")))).alias("matches"))


@query("""WITH m AS (SELECT *, role || ': ' || text || chr(10) AS line FROM conversations), p AS (SELECT *, '#' || conv_id || chr(10) || coalesce(string_agg(line, '') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') || 'assistant: ' AS prompt FROM m)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS step, md5(prompt) AS prompt_md5, length(text) + 1 AS n_said, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1 AS done FROM p WHERE role = 'assistant'""")
def rolled_out_conversations(t):
    """Conversations rolled out turn by turn: each prompt is looked up among completions, what users say next is the observation."""
    line = lambda m: F.concat(m["role"], F.lit(": "), m["content"], F.lit("\n"))
    joined = lambda a, n: F.array_join(F.transform(F.slice("messages", a, n), line), "")
    c = render.conversations(t.conversations).withColumn("at", F.filter(F.sequence(F.lit(1), F.size("messages")), lambda i: F.element_at("messages", i)["role"] == "assistant")).where(F.size("at") > 0)
    each = c.select("*", F.posexplode("at").alias("turn", "i")).withColumn("following", F.try_element_at("at", F.col("turn") + 2))
    head = F.concat(F.lit("#"), F.col("conv_id").cast("string"), F.lit("\n"))
    known = each.select(F.concat(head, joined(F.lit(1), F.col("i") - 1), F.lit("assistant: ")).alias("prompt"), F.concat(F.element_at("messages", F.col("i"))["content"], F.lit("\n")).alias("completion"))
    replies = each.select("conv_id", "turn", F.concat(joined(F.col("i") + 1, F.col("following") - F.col("i") - 1), F.lit("assistant: ")).alias("observation"), F.col("following").isNull().alias("last"))
    episodes = c.select("conv_id", F.concat(head, joined(F.lit(1), F.col("at")[0] - 1), F.lit("assistant: ")).alias("prompt"))
    loop = rollout.TurnRollouts(scratch_folder(t.spark, "rolled_out"), rollout.completed_from(known, ["prompt"]), rollout.ConversationTurns(replies, ["conv_id"]))
    return loop.run(episodes).select("conv_id", F.col("turn").cast("long").alias("step"), F.md5("prompt").alias("prompt_md5"), F.length("completion").cast("long").alias("n_said"), "done")


@query(ORACLES["guessing_games"])
def guessing_rollouts(t):
    """The guessing games rolled out turn by turn: what the replay of whole logs gives, from a loop that sees one turn at a time."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    said = F.when(F.col("event_id") % 7 == 6, "no guess").otherwise(F.concat(F.lit("Guess: "), (F.col("event_id") % 7).cast("string")))
    known = t.events.select("user_id", (F.row_number().over(w) - 1).alias("turn"), said.alias("completion"))
    loop = rollout.TurnRollouts(scratch_folder(t.spark, "guessing"), rollout.completed_from(known, ["user_id", "turn"]), rollout.NumberGame())
    steps = loop.run(t.events.select("user_id").distinct().withColumn("gold", F.lit(3))).where("NOT unanswered")
    return steps.groupBy("user_id").agg(F.count("*").cast("int").alias("turns"), (F.max("reward") == 1.0).alias("won"), F.sum("reward").alias("reward"))


@query(ORACLES["search_replay"])
def search_rollouts(t):
    """The search episodes rolled out turn by turn: queries meet a table of results, and an episode ends with an answer or a failure."""
    k = F.col("o_custkey") % 5
    episodes = t.orders.select("o_custkey").distinct().withColumns({"question": F.concat(F.lit("q"), F.col("o_custkey").cast("string")), "gold": F.array(F.lit("x"), F.lit("tower"))})
    turns = episodes.select("o_custkey", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("turn"))
    answers = ((k == 0) & (F.col("turn") >= 2)) | ((k == 4) & (F.col("turn") >= 1))
    query_of = F.concat((k.cast("string")), F.lit("-"), F.col("turn").cast("string"))
    known = turns.withColumns({"completion": F.when(k == 0, "Answer: The Tower!").otherwise("I don't know"), "tools": F.when(~answers, F.when(k == 1, F.array(F.lit("other"))).otherwise(F.array(F.lit("search")))), "query": query_of, "parsed": F.lit(True)})
    results = known.select("query").distinct().withColumn("documents", F.array(F.when(F.col("query") == "3-1", F.repeat(F.lit("d"), 40_000)).otherwise("found")))
    loop = rollout.TurnRollouts(scratch_folder(t.spark, "searching"), rollout.completed_from(known, ["o_custkey", "turn"]), rollout.SearchTurns(results))
    steps = loop.run(episodes)
    own = steps.groupBy("o_custkey").agg(F.count("*").cast("int").alias("turns"), F.max("calls").alias("calls"), F.max("failed").alias("failed"), F.max("format").alias("format"), F.max("correct").alias("correct"), F.round(F.sum("reward"), 6).alias("reward"))
    return own
