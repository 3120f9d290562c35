"""Queries on rollouts, log-probabilities and evaluation, over tables that stand in for them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import accounting, evaluation, logprob, runlog, trajectory
from ..sources.readers import table_stream
from ..sources.scratch import scratch_folder
from ..streaming import buffers, streams
from .registry import query

_REWARD = "(CASE WHEN o_totalprice > 150000 THEN 1.0 ELSE 0.0 END)::DOUBLE"


def _orders(t):
    return t.orders.select(F.col("o_custkey").alias("group_id"), F.col("o_orderkey").alias("traj_idx"), F.when(F.col("o_totalprice") > 150000, 1.0).otherwise(0.0).alias("total_reward"), "o_totalprice")


@query(f"SELECT o_custkey AS group_id, o_orderkey AS traj_idx, round({_REWARD} - avg({_REWARD}) OVER (PARTITION BY o_custkey), 6) AS advantage FROM orders")
def group_advantages(t):
    return trajectory.advantages(_orders(t)).select("group_id", "traj_idx", F.round("advantage", 6).alias("advantage"))


@query(f"WITH g AS (SELECT o_custkey, min({_REWARD}) <> max({_REWARD}) AS mixed FROM orders GROUP BY o_custkey) SELECT o_custkey AS group_id, o_orderkey AS traj_idx FROM orders JOIN g USING (o_custkey) WHERE mixed OR (NOT (SELECT bool_or(mixed) FROM g) AND o_custkey = (SELECT min(o_custkey) FROM g))")
def constant_group_filter(t):
    return trajectory.without_constant_groups(_orders(t)).select("group_id", "traj_idx")


@query(f"WITH g AS (SELECT min({_REWARD}) lo, max({_REWARD}) hi FROM orders GROUP BY o_custkey) SELECT round(avg((lo <> hi)::INT), 6) AS frac_mixed, round(avg((lo = hi AND lo >= 0.5)::INT), 6) AS frac_all_good, round(avg((lo = hi AND lo < 0.5)::INT), 6) AS frac_all_bad FROM g")
def by_group_fractions(t):
    out = trajectory.group_fractions(_orders(t))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(f"SELECT round(avg(m), 6) AS reward_total FROM (SELECT avg({_REWARD}) AS m FROM orders GROUP BY o_custkey)")
def mean_of_group_means(t):
    return trajectory.group_mean_reward(_orders(t)).select(F.round("reward_total", 6).alias("reward_total"))


@query("SELECT o_custkey AS group_id, o_orderkey AS traj_idx, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) - 1 AS rank, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE n <= 4 OR rank IN (0, (n - 1) // 3, 2 * (n - 1) // 3, n - 1)")
def representative_pick(t):
    return trajectory.representatives(_orders(t), "o_totalprice", "traj_idx", "group_id").select("group_id", "traj_idx", "rank")


def _rollouts(t):
    """Users are groups, their event types trajectories, their events steps."""
    e = t.events.withColumn("cents", F.round(F.col("value") * 100).cast("bigint"))
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    n = lambda m: F.array_repeat(F.lit(1), (F.col("event_id") % m + 1).cast("int"))
    steps = e.select(F.col("user_id").alias("group_id"), F.col("event_type").alias("traj_idx"), (F.row_number().over(w) - 1).alias("step_idx"), n(7).alias("ob_tokens"), n(3).alias("ac_tokens"), (F.col("event_id") % 2).cast("double").alias("reward"))
    trajectories = steps.groupBy("group_id", "traj_idx").agg(F.lit(0.5).alias("final_reward"))
    groups = trajectories.select("group_id").distinct().withColumn("tags", F.array(F.when(F.col("group_id") % 2 == 0, "even").otherwise("odd")))
    return steps, trajectories, groups


_STEPS = "SELECT user_id AS g, event_type AS tr, count(*) AS turns, sum(event_id % 3 + 1) AS ac, sum(event_id % 7 + 1) AS ob, sum(event_id % 2) + 0.5 AS total FROM events GROUP BY ALL"


@query(f"""WITH s AS ({_STEPS}), t AS (SELECT *, unnest(['all', CASE WHEN g % 2 = 0 THEN 'even' ELSE 'odd' END]) AS tag FROM s),
 f AS (SELECT tag, avg((lo <> hi)::INT) AS mixed, avg((lo = hi AND lo >= 0.5)::INT) AS good, avg((lo = hi AND lo < 0.5)::INT) AS bad FROM (SELECT tag, g, min(total) AS lo, max(total) AS hi FROM t GROUP BY tag, g) GROUP BY tag)
SELECT tag, round(sum(ac) / sum(turns), 6) AS ac_tokens_per_turn, round(sum(ob) / sum(turns), 6) AS ob_tokens_per_turn, round(sum(turns) / count(*), 6) AS turns_per_episode, count(*) AS total_episodes, CAST(sum(turns) AS BIGINT) AS total_turns,
 CAST(sum(ac) AS BIGINT) AS total_ac_tokens, CAST(sum(ob) AS BIGINT) AS total_ob_tokens, round(avg(total)::DOUBLE, 6) AS reward_total, round(any_value(mixed), 6) AS frac_mixed, round(any_value(good), 6) AS frac_all_good, round(any_value(bad), 6) AS frac_all_bad FROM t JOIN f USING (tag) GROUP BY tag""")
def trajectory_metrics_by_tag(t):
    out = trajectory.trajectory_metrics(*_rollouts(t))
    return out.select("tag", *[F.round(c, 6).alias(c) if dict(out.dtypes)[c] == "double" else F.col(c) for c in out.columns if c != "tag"])


@query("SELECT user_id AS group_id, event_type AS traj_idx, step, round(reward::DOUBLE, 6) AS reward, round(running::DOUBLE, 6) AS running FROM (SELECT user_id, event_type, CAST(row_number() OVER w - 1 AS VARCHAR) AS step, event_id % 2 AS reward, sum(event_id % 2) OVER w AS running FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id) UNION ALL SELECT user_id, event_type, 'final', 0.5, sum(event_id % 2) + 0.5 FROM events GROUP BY ALL UNION ALL SELECT user_id, event_type, 'total', sum(event_id % 2) + 0.5, sum(event_id % 2) + 0.5 FROM events GROUP BY ALL)")
def reward_summary(t):
    steps, trajectories, _ = _rollouts(t)
    out = trajectory.reward_summary(steps, trajectories)
    return out.select("group_id", "traj_idx", "step", F.round("reward", 6).alias("reward"), F.round("running", 6).alias("running"))


@query("WITH k AS (SELECT 'k' AS key, CAST(json_extract(props, '$.k') AS DOUBLE) AS v FROM events WHERE json_extract(props, '$.k') IS NOT NULL UNION ALL SELECT event_type, value FROM events) SELECT key, round(avg(v), 6) AS value FROM k GROUP BY key")
def ragged_metric_means(t):
    e = t.events
    props = e.select(F.from_json("props", "map<string,double>").alias("metrics"))
    values = e.select(F.create_map("event_type", "value").alias("metrics"))
    return trajectory.metric_means(props, values).select("key", F.round("value", 6).alias("value"))


@query("""WITH e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)
SELECT a.user_id, CAST(a.k - 1 AS INT) AS step, round(sum(b.value * pow(0.9, b.k - a.k)) + 1e-9, 4) AS future FROM e a JOIN e b ON a.user_id = b.user_id AND b.k >= a.k GROUP BY a.user_id, a.k""")
def discounted_return(t):
    """Trajectories are all events of a user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = t.events.select("user_id", (F.row_number().over(w) - 1).alias("step"), "value")
    return trajectory.discounted_rows(e, "user_id", "step", "value", 0.9).select("user_id", "step", F.round(F.col("future") + 1e-9, 4).alias("future"))


@query("WITH w AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn FROM events) SELECT user_id, CAST(min(turn) FILTER (event_type = 'purchase') AS INT) AS won_at, CASE WHEN min(turn) FILTER (event_type = 'purchase') IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS reward, CAST(coalesce(min(turn) FILTER (event_type = 'purchase'), max(turn)) AS INT) AS turns FROM w WHERE turn <= 10 GROUP BY user_id")
def first_win(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return trajectory.first_win(t.events.withColumn("turn", F.row_number().over(w)), F.col("event_type") == "purchase", 10, ["user_id"])


def _tokens(t):
    """Line items as tokens: minus discount and minus tax are log-probabilities, a return flag is the mask."""
    return t.lineitem.select("l_orderkey", (-F.col("l_discount")).alias("lp"), (-F.col("l_tax")).alias("base"), F.when(F.col("l_returnflag") == "N", 1.0).otherwise(0.0).alias("mask"), "l_linestatus", "l_returnflag")


_TOK = "SELECT l_orderkey, -l_discount AS lp, -l_tax AS base, (CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END)::DOUBLE AS mask, l_linestatus, l_returnflag FROM lineitem"


@query(f"SELECT l_linestatus, round(-sum(lp * mask) / sum(mask), 6) AS nll FROM ({_TOK}) GROUP BY l_linestatus")
def nll_weighted(t):
    return _tokens(t).groupBy("l_linestatus").agg(F.round(logprob.weighted_nll("lp", "mask"), 6).alias("nll"))


@query(f"SELECT round(avg(lp - base), 6) AS kl_v1, round(0.5 * avg((lp - base) * (lp - base)), 6) AS kl_v2, round(-avg(lp), 6) AS entropy FROM ({_TOK}) WHERE mask > 0")
def kl_v1_v2_entropy(t):
    out = _tokens(t).where("mask > 0").agg(*logprob.kl_sample_train("lp", "base"))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(f"SELECT round(avg(abs(lp - base)), 6) AS mean_abs, round(max(abs(lp - base)), 6) AS max_abs, round(avg((lp - base) * (lp - base)), 6) AS mse FROM ({_TOK})")
def logprob_agreement(t):
    out = _tokens(t).agg(*logprob.agreement("lp", "base"))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(f"SELECT l_returnflag, round(sum((lp - base) * mask) / sum(mask), 6) AS kl FROM ({_TOK}) GROUP BY l_returnflag HAVING sum(mask) > 0 UNION ALL SELECT NULL, round(sum((lp - base) * mask) / sum(mask), 6) FROM ({_TOK})")
def kl_by_dataset(t):
    out = logprob.kl_by_group(_tokens(t).withColumn("d", F.col("lp") - F.col("base")), "d", "mask", "l_returnflag")
    return out.select("l_returnflag", F.round("kl", 6).alias("kl"))


def _sequences(t):
    """Orders as sequences of tokens; sums over them don't depend on the order of equal keys."""
    part = F.array_sort(F.collect_list(F.struct("lp", "base", "mask")))
    own = _tokens(t).groupBy("l_orderkey").agg(part.alias("p"))
    take = lambda c: F.transform("p", lambda x: x[c])
    return own.select("l_orderkey", take("lp").alias("logprobs"), take("base").alias("base_logprobs"), take("base").alias("teacher_logprobs"), take("mask").alias("mask"), F.transform("p", lambda x: F.lit(0.0)).alias("advantages"))


@query(f"WITH k AS ({_TOK}), m AS (SELECT sum((lp - base) * mask) / sum(mask) AS kl FROM k) SELECT l_orderkey, round(sum(0.1 * mask * (kl - (lp - base) * mask)), 6) AS added FROM k, m GROUP BY l_orderkey")
def kl_penalty_advantages(t):
    out = logprob.penalised_advantages(_sequences(t), 0.1, mean=logprob.mean_difference(_tokens(t), "lp", "base", "mask"))
    return out.select("l_orderkey", F.round(F.aggregate("advantages", F.lit(0.0), lambda s, x: s + x), 6).alias("added"))


@query(f"SELECT l_orderkey, round(sum((lp - base) * mask), 6) + 0.0 AS kl, round(sum(-0.5 * (lp - base) * mask), 6) + 0.0 AS added FROM ({_TOK}) GROUP BY l_orderkey")
def teacher_kl_advantages(t):
    out = logprob.teacher_advantages(_sequences(t), 0.5)
    return out.select("l_orderkey", (F.round("kl", 6) + 0.0).alias("kl"), (F.round(F.aggregate("advantages", F.lit(0.0), lambda s, x: s + x), 6) + 0.0).alias("added"))


@query(f"SELECT round(sum((lp - base) * mask) / greatest(sum(mask), 1), 6) AS self_distill_kl FROM ({_TOK})")
def self_distill_kl(t):
    return _tokens(t).agg(F.round(logprob.mean_kl((F.col("lp") - F.col("base")) * F.col("mask"), "mask"), 6).alias("self_distill_kl"))


@query("""WITH p AS (SELECT l_discount * 10 AS c, l_tax * 10 AS r FROM lineitem), x AS (SELECT c, r, 0.1 * (c - r) AS x FROM p)
SELECT round(avg(greatest(-x, 0) + ln(1 + exp(-abs(x)))), 6) AS dpo_loss, round(avg((c > r)::INT), 6) AS accuracy, round(0.1 * avg(0.1 * c - 0.1 * r), 6) AS margin, round(avg(0.1 * c), 6) AS chosen_reward, round(avg(0.1 * r), 6) AS rejected_reward FROM x""")
def dpo_metrics_double_beta_margin(t):
    pairs = t.lineitem.select((F.col("l_discount") * 10).alias("chosen"), (F.col("l_tax") * 10).alias("rejected"))
    out = logprob.dpo_metrics(pairs, 0.1)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


_PROBLEMS = "SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS c FROM events GROUP BY user_id"


@query(f"""WITH p AS ({_PROBLEMS}), k AS (SELECT *, unnest([1, 2, 4, 8]) AS k FROM p), q AS (SELECT k, CASE WHEN c = 0 THEN 0.0 WHEN n - c < k THEN 1.0 ELSE 1.0 - list_reduce(list_prepend(1.0::DOUBLE, [1.0::DOUBLE - k / i::DOUBLE FOR i IN range(n - c + 1, n + 1)]), lambda a, b: a * b) END AS v FROM k WHERE k <= n)
SELECT CAST(k AS INT) AS k, round(avg(v), 6) AS pass_at_k FROM q GROUP BY k""")
def pass_at_k(t):
    problems = t.events.groupBy("user_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("event_type") == "purchase", 1)).alias("c"))
    return evaluation.pass_rates(problems, [1, 2, 4, 8]).select("k", F.round("pass_at_k", 6).alias("pass_at_k"))


@query("SELECT source, CAST(sum(quality) AS BIGINT) AS num_correct, count(*) AS num_examples, round(sum(quality) / count(*), 6) AS accuracy FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (source)")
def accuracy_rollup(t):
    return evaluation.accuracy(t.documents.join(t.labels, "doc_id"), "quality", "source").withColumn("accuracy", F.round("accuracy", 6))


@query("SELECT o_custkey, round(avg(o_totalprice), 6) AS mean, round(stddev_pop(o_totalprice), 1) AS std, count(*) AS n FROM orders GROUP BY o_custkey")
def rollout_matrix(t):
    out = evaluation.rollout_matrix(t.orders, "o_custkey", "o_orderkey", "o_totalprice")
    return out.select("o_custkey", F.round("mean", 6).alias("mean"), F.round("std", 1).alias("std"), F.size("rewards").cast("bigint").alias("n"))


@query("SELECT CAST(user_id AS BIGINT) AS pid, epoch_us(ts) AS begin_ts, epoch_us(ts) + 10 AS end_ts, 1 AS depth FROM (SELECT user_id, ts, event_id FROM events)")
def trace_spans(t):
    """Every event is a span on a track of its own, of ten microseconds."""
    e = t.events.select(F.col("user_id").alias("pid"), F.col("event_id").alias("tid"), F.col("event_type").alias("name"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    both = F.array(F.struct(F.lit("B").alias("ph"), F.col("us").alias("ts"), F.lit(0).alias("line_no")), F.struct(F.lit("E").alias("ph"), (F.col("us") + 10).alias("ts"), F.lit(1).alias("line_no")))
    events = e.select("pid", "tid", "name", F.explode(both).alias("x")).select("pid", "tid", "name", "x.*")
    return runlog.spans(events).select("pid", "begin_ts", "end_ts", "depth")


@query("SELECT max(o_orderkey) FILTER (o_orderkey % 2 = 0) AS last, count(*) FILTER (o_orderkey % 2 = 0) AS n_valid FROM orders")
def last_checkpoint(t):
    rows = t.orders.select(F.col("o_orderkey").alias("line_no"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("s"), F.col("o_orderkey").cast("string"))).alias("state_path"))
    return runlog.last_checkpoint(rows).select(F.col("last.line_no").alias("last"), "n_valid")


@query("SELECT CAST(32 * sum((p_size + 10) * (p_partkey % 3 = 0)::INT) AS BIGINT) AS non_expert_params, CAST(32 * sum((p_size + CASE WHEN p_partkey = 2 OR p_partkey = 1 THEN 10 ELSE 0 END) * (p_partkey % 3 <> 0)::INT) AS BIGINT) AS expert_params FROM part")
def lora_parameters(t):
    """Parts as weights: a third plain, the rest experts whose number is their key but for the first two, which are number 0."""
    key = F.col("p_partkey")
    expert = F.concat(F.lit("m.experts."), F.when(key <= 2, "0").otherwise(key.cast("string")), F.lit(".up_proj.weight"))
    shapes = t.part.select(F.when(key % 3 == 0, F.concat(F.lit("m."), key.cast("string"), F.lit(".weight"))).otherwise(expert).alias("name"), F.array(F.col("p_size").cast("bigint"), F.lit(10).cast("bigint")).alias("shape"))
    return accounting.lora_parameters(shapes).select("non_expert_params", "expert_params")


@query("SELECT round(sum(p_size * 10.0)::DOUBLE, 3) AS params, round(1.0 / sqrt(sum(p_size * 10.0)::DOUBLE), 9) AS lr_multiplier FROM part")
def full_parameters(t):
    shapes = t.part.select(F.array(F.col("p_size").cast("bigint"), F.lit(10).cast("bigint")).alias("shape"))
    return accounting.full_parameters(shapes).select(F.round("params", 3).alias("params"), F.round("lr_multiplier", 9).alias("lr_multiplier"))


def _streamed(t, build, name, files: int | None = 1):
    """Run a streaming query over the table's files to their end, so many files a trigger or all in one, and return what it wrote."""
    where = scratch_folder(t.spark, name)
    source = table_stream(t.spark, f"{t.folder}/events.parquet*", t.events.schema, files)
    build(source).writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{where}/out")


def _minibatched(t, build):
    """A stream of the events in the order of their ids."""
    given = buffers.Stretches(t.events.select("event_id"), "event_id", scratch_folder(t.spark, "minibatch_events"))
    return given.run(build, scratch_folder(t.spark, "minibatch"))


_LANES = 4
_FILLED = "WITH v AS (SELECT event_id % {lanes} AS lane, event_id, row_number() OVER (PARTITION BY event_id % {lanes} ORDER BY event_id) - 1 AS k, count(*) OVER (PARTITION BY event_id % {lanes}) AS n FROM events WHERE {valid}) SELECT lane, k // 64 AS batch_idx, event_id AS item FROM v WHERE k // 64 < n // 64"


@query(_FILLED.format(lanes=_LANES, valid="TRUE"))
def stream_minibatch(t):
    """Four lanes of batches side by side."""
    return _minibatched(t, lambda s: streams.minibatches(s, "event_id", 64, lane=F.col("event_id") % _LANES))


@query(_FILLED.format(lanes=_LANES, valid="event_id % 5 <> 0"))
def stream_valid_minibatch(t):
    """A batch is full with so many valid items; the others don't count."""
    return _minibatched(t, lambda s: streams.minibatches(s.withColumn("ok", F.col("event_id") % 5 != 0), "event_id", 64, valid="ok", valid_only=True, lane=F.col("event_id") % _LANES))


@query("WITH e AS (SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, value, max(ts) OVER () AS last FROM events) SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM e WHERE start + INTERVAL 1 hour <= last - INTERVAL 10 minute GROUP BY start, event_type")
def stream_tumbling(t):
    """An extension: windows of event time. Windows that the watermark has not passed are not written.

    All files go in one trigger: in whatever order of time they are, no row of the table is late.
    """
    out = _streamed(t, lambda s: streams.tumbling(s.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "value", "1 hour", by=["event_type"]), "tumbling", None)
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
