"""Queries on sources and sinks: tables are written as a caller would find or leave them, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import accounting, dataset, evaluation, preference, render, runlog
from ..sources import datasets, readers, writers
from ..sources.scratch import scratch_folder
from ..streaming import streams
from .registry import query

_MESSAGES = "SELECT conv_id, count(*) AS n, string_agg(role || ':' || text, chr(10) ORDER BY turn) AS said FROM conversations GROUP BY conv_id"


def _conversations(t):
    return render.conversations(t.conversations).select("conv_id", F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


@query("SELECT count(*) AS n_conversations, CAST(sum(n) AS BIGINT) AS n_messages, CAST(sum(length(said)) AS BIGINT) AS n_chars FROM (SELECT conv_id, count(*) AS n, string_agg(role || text, '' ORDER BY turn) AS said FROM conversations GROUP BY conv_id)")
def conversation_files(t):
    folder = scratch_folder(t.spark, "conversation_files")
    _conversations(t).select("messages").write.json(folder)
    read = readers.read_conversations(t.spark, folder)
    said = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], m["content"])), "")
    return read.agg(F.count("*").alias("n_conversations"), F.sum(F.size("messages")).alias("n_messages"), F.sum(F.length(said)).alias("n_chars"))


@query("SELECT doc_id, source, lang FROM documents WHERE doc_id % 3 <> 0")
def strict_lines(t):
    folder = scratch_folder(t.spark, "strict_lines")
    t.documents.where("doc_id % 3 <> 0").select("doc_id", "source", "lang").write.json(folder)
    return readers.read_jsonl(t.spark, folder, "doc_id long, source string, lang string")


@query("SELECT doc_id, source, doc_id % 4 = 0 AS bad FROM documents")
def tolerant_lines(t):
    """A quarter of the lines is cut short; they are told from the others, none is lost."""
    folder = scratch_folder(t.spark, "tolerant_lines")
    line = F.to_json(F.struct("doc_id", "source"))
    t.documents.select(F.when(F.col("doc_id") % 4 == 0, F.expr("left(to_json(struct(doc_id, source)), length(to_json(struct(doc_id, source))) - 1)")).otherwise(line).alias("value")).write.text(folder)
    good, bad = readers.read_jsonl_tolerant(t.spark, folder, "doc_id long, source string")
    mended = bad.select(F.from_json(F.concat("value", F.lit("}")), "doc_id long, source string").alias("r")).select("r.*")
    return good.withColumn("bad", F.lit(False)).unionByName(mended.withColumn("bad", F.lit(True)))


@query("SELECT conv_id, label, 'q' || conv_id AS asked FROM (SELECT DISTINCT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'A' ELSE 'B' END AS label FROM conversations) WHERE conv_id % 5 <> 0")
def comparison_files(t):
    folder = scratch_folder(t.spark, "comparison_files")
    one = lambda role, text: F.array(preference.message(role, text))
    number = F.col("conv_id").cast("string")
    whole = F.struct(one("user", F.concat(F.lit("q"), number)).alias("prompt_conversation"), one("assistant", number).alias("completion_A"), one("assistant", F.lit("no")).alias("completion_B"))
    rows = t.conversations.select("conv_id").distinct().select(F.when(F.col("conv_id") % 10 != 0, whole).alias("comparison"), F.when(F.col("conv_id") % 10 != 5, F.when(F.col("conv_id") % 2 == 0, "A").otherwise("B")).alias("label"))
    rows.write.json(folder)
    read = readers.read_comparisons(t.spark, folder)
    return read.select(F.element_at("comparison.completion_A", 1)["content"].cast("bigint").alias("conv_id"), "label", F.element_at("comparison.prompt_conversation", 1)["content"].alias("asked"))


@query("SELECT value, count(*) AS n FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS value FROM documents) GROUP BY value")
def text_lines(t):
    folder = scratch_folder(t.spark, "text_lines")
    t.documents.select(F.when(F.col("doc_id") % 3 == 0, " \t").otherwise(F.concat(F.lit("  "), "source", F.lit(" "))).alias("value")).write.text(folder)
    return readers.read_lines(t.spark, folder).groupBy("value").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_partkey // 16 AS batch_idx, TRUE AS sound FROM part WHERE p_partkey // 16 < (SELECT count(*) FROM part) // 16")
def arithmetic_batches(t):
    """A generated problem for every part, in batches of 16; parts that fill no batch get none."""
    sums = readers.arithmetic_problems(t.spark, t.part.count() // 16, 16)
    ok = F.col("x").between(0, 100) & F.col("y").between(0, 100) & (F.col("answer") == (F.col("x") + F.col("y")).cast("string")) & F.col("question").startswith("What is ")
    own = sums.select((F.col("batch_idx") * 16 + F.col("pos")).alias("p_partkey"), "batch_idx", ok.alias("sound"))
    return t.part.select("p_partkey").join(own, "p_partkey")


@query("WITH n AS (SELECT number, CASE WHEN row_number() OVER (ORDER BY md5(CAST(number AS VARCHAR) || ':0'), number) <= 921 THEN 'train' ELSE 'test' END AS split FROM range(1024) r(number)) SELECT event_id, number, split FROM events JOIN n ON number = event_id % 1024")
def guess_number_split(t):
    """Every event's number to guess, and which split that number is in."""
    asked = t.events.select("event_id", (F.col("event_id") % 1024).alias("number"))
    return asked.join(F.broadcast(readers.guess_numbers(t.spark).select("number", "split")), "number").select("event_id", "number", "split")


@query("SELECT max(o_orderkey) AS name, count(*) AS n_valid, max(o_orderkey) % 7 AS epoch, max(o_orderkey) % 11 AS batch, 0 AS missing FROM orders WHERE o_orderkey % 2 = 0")
def checkpoint_log(t):
    """Checkpoints are appended in the order of their keys; every second has a state."""
    folder = scratch_folder(t.spark, "checkpoint_log")
    key = F.col("o_orderkey")
    rows = t.orders.select(key.cast("string").alias("name"), (key % 7).alias("epoch"), (key % 11).alias("batch"), F.when(key % 2 == 0, F.concat(F.lit("s"), key.cast("string"))).alias("state_path"), key.alias("at"))
    writers.write_checkpoints(rows.orderBy("at").coalesce(1).drop("at"), folder)
    read = readers.read_checkpoints(t.spark, folder)
    missing = readers.read_checkpoints(t.spark, f"{folder}-none").agg(F.count("*").cast("int").alias("missing"))
    last = runlog.last_checkpoint(read).select(F.col("last.name").cast("bigint").alias("name"), "n_valid")
    return last.join(streams.resume_point(read), F.lit(True)).join(missing, F.lit(True))


_RUNS = "SELECT 'run' || o_custkey % 5 AS run_id, o_orderkey % 40 AS step, max(o_totalprice) AS loss, count(*)::DOUBLE AS n FROM orders GROUP BY ALL"


def _metric_log(t):
    folder = scratch_folder(t.spark, "metric_log")
    own = t.orders.groupBy(F.concat(F.lit("run"), (F.col("o_custkey") % 5).cast("string")).alias("run_id"), (F.col("o_orderkey") % 40).alias("step")).agg(F.max("o_totalprice").alias("loss"), F.count("*").cast("double").alias("n"))
    long = own.select("run_id", "step", F.inline(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in ("loss", "n")])))
    writers.write_metrics(long, folder)
    return readers.read_metrics(t.spark, folder)


@query(f"SELECT run_id, step, key, round(value, 4) AS value FROM ({_RUNS}) UNPIVOT (value FOR key IN (loss, n))")
def metric_log(t):
    return _metric_log(t).select("run_id", "step", "key", F.round("value", 4).alias("value"))


@query(f"WITH r AS ({_RUNS}) SELECT a.step, round(abs(a.loss - b.loss) / greatest(abs(a.loss), abs(b.loss)), 6) AS difference FROM r a JOIN r b USING (step) WHERE a.run_id = 'run1' AND b.run_id = 'run2'")
def run_comparison(t):
    wide = _metric_log(t).where("key = 'loss'").withColumnRenamed("value", "loss")
    out = runlog.compare_runs(wide.where("run_id = 'run1'"), wide.where("run_id = 'run2'"), "loss")
    return out.select("step", F.round("difference", 6).alias("difference"))


@query("SELECT 'run' || i AS run_id, i::DOUBLE / 10 AS rate, b AS size FROM range(8) r(i), (VALUES (1), (2)) s(b) WHERE i >= 5")
def pending_runs(t):
    """A grid of planned runs without those that have logged something."""
    grid = dataset.parameter_grid(t.spark, i=list(range(8)), size=[1, 2])
    planned = grid.select(F.concat(F.lit("run"), F.col("i").cast("string")).alias("run_id"), (F.col("i") / 10).alias("rate"), "size")
    return runlog.pending_runs(planned, _metric_log(t))


@query("SELECT event_type AS key, CASE WHEN count(*) % 2 = 0 THEN CAST(count(*) AS VARCHAR) ELSE printf('%.6f', count(*) + 0.25) END AS text FROM events GROUP BY event_type")
def metric_table(t):
    n = F.count("*")
    return runlog.metric_table(t.events.groupBy(F.col("event_type").alias("key")).agg(F.when(n % 2 == 0, n.cast("double")).otherwise(n + F.lit(0.25)).alias("value")))


@query("SELECT key, value FROM (SELECT event_type AS key, user_id::DOUBLE AS value, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1")
def merged_metrics(t):
    return evaluation.merged_metrics(t.events.select(F.col("event_type").alias("key"), F.col("user_id").cast("double").alias("value"), F.col("event_id").alias("ord")))


_TRACE = "SELECT user_id * 10 AS pid, event_id % 3 AS tid, event_id, CASE event_id % 4 WHEN 0 THEN 'M' WHEN 1 THEN 'B' WHEN 2 THEN 'E' ELSE 'i' END AS ph, event_type AS name, epoch_us(ts)::DOUBLE AS ts FROM events"


def _trace(t):
    four = F.col("event_id") % 4
    ph = F.when(four == 0, "M").when(four == 1, "B").when(four == 2, "E").otherwise("i")
    return t.events.select((F.col("user_id") * 10).alias("pid"), (F.col("event_id") % 3).alias("tid"), F.col("event_id").alias("line_no"), ph.alias("ph"), F.col("event_type").alias("name"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("ts"))


@query(f"""WITH e AS ({_TRACE}), k AS (SELECT *, row_number() OVER (PARTITION BY pid, tid, ph = 'M' ORDER BY ts, event_id) AS nth, dense_rank() OVER (ORDER BY pid) - 1 AS small FROM e) SELECT small AS pid, tid, ph, count(*) AS n FROM k WHERE ph <> 'M' OR nth = 1 GROUP BY ALL""")
def trace_log(t):
    folder = scratch_folder(t.spark, "trace_log")
    writers.write_trace(_trace(t), folder)
    return readers.read_trace(t.spark, folder).groupBy("pid", "tid", "ph").agg(F.count("*").alias("n"))


@query(f"SELECT pid, tid, ph, name, ts, CAST(sum(CASE WHEN event_id % 5 = 0 OR event_id = 0 THEN 2 ELSE 1 END) AS BIGINT) AS n, CAST(1 AS BIGINT) AS opens, CAST(1 AS BIGINT) AS closes FROM ({_TRACE}) GROUP BY pid, tid, ph, name, ts")
def trace_document(t):
    """The log as one JSON array, a fifth of its events twice: every event is read back from its line, and the array opens and closes once."""
    events = _trace(t)
    lines = writers.trace_array(events.union(events.where("line_no % 5 = 0")))
    ends = lines.agg(F.sum(F.col("value").startswith("[").cast("long")).alias("opens"), F.sum(F.col("value").endswith("]").cast("long")).alias("closes"))
    kind = "ts double, ph string, name string, pid bigint, tid bigint"
    read = lines.where("value <> ']'").select(F.from_json(F.col("value").substr(F.lit(2), F.length("value")), kind, {"mode": "FAILFAST"}).alias("e")).select("e.*")
    return read.groupBy("pid", "tid", "ph", "name", "ts").agg(F.count("*").alias("n")).join(F.broadcast(ends), F.lit(True))


@query("SELECT 'user' AS first_role, source AS question, lang AS answer, count(*) AS n FROM documents WHERE doc_id % 3 <> 0 GROUP BY ALL")
def distilled_file(t):
    folder = scratch_folder(t.spark, "distilled_file")
    writers.write_distilled(t.documents.select(F.col("source").alias("question"), F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("answer")), folder)
    m = F.col("messages")
    read = readers.read_conversations(t.spark, folder).select(m[0]["role"].alias("first_role"), m[0]["content"].alias("question"), m[1]["content"].alias("answer"))
    return read.groupBy("first_role", "question", "answer").agg(F.count("*").alias("n"))


@query("SELECT 'doc' AS kind, CAST(doc_id AS VARCHAR) AS id, lang, NULL::VARCHAR AS name FROM documents UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR), NULL, n_name FROM nation")
def csv_table(t):
    """Tables of different columns in one CSV; what one lacks is empty."""
    folder = scratch_folder(t.spark, "csv_table")
    docs = t.documents.select(F.lit("doc").alias("kind"), F.col("doc_id").cast("string").alias("id"), "lang")
    nations = t.nation.select(F.lit("nation").alias("kind"), F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"))
    writers.write_table([docs, nations], ["kind", "id", "lang", "name"], folder)
    return t.spark.read.schema("kind string, id string, lang string, name string").option("header", True).csv(folder)


def _problem_root(t) -> datasets.Source:
    """Named datasets made from parts: their key is the problem, their size the answer."""
    root = scratch_folder(t.spark, "problem_registry")
    key, size = F.concat(F.lit("p"), F.col("p_partkey").cast("string")), F.col("p_size").cast("string")
    boxed = F.when(F.col("p_partkey") % 5 != 0, F.concat(F.lit("so \\boxed{"), size, F.lit("}"))).otherwise("no answer")
    parts = t.part.select("p_partkey", key.alias("problem"), boxed.alias("solution"), size.alias("answer"))
    places = [(c, s) for c in datasets.MATH_CONFIGS for s in ("train", "test")]
    for i, (c, s) in enumerate(places):
        parts.where(F.col("p_partkey") % len(places) == i).select("problem", "solution").write.parquet(f"{root}/math/{c}/{s}")
    parts.where("p_partkey % 9 = 0").select("problem", F.concat(F.lit("\\boxed{"), "answer", F.lit("}")).alias("solution"), "answer").write.parquet(f"{root}/math_held_out/default/test")
    parts.select("problem", F.when(F.col("p_partkey") % 7 != 0, F.col("answer")).otherwise("").alias("answer")).write.parquet(f"{root}/polaris/default/train")
    parts.select(F.col("problem").alias("question"), F.when(F.col("p_partkey") % 3 != 0, F.col("answer")).alias("final_answer")).write.parquet(f"{root}/deepmath/default/train")
    for s, kept in (("train", "p_partkey % 4 > 0"), ("test", "p_partkey % 4 = 0")):
        parts.where(kept).select(F.col("problem").alias("question"), F.concat(F.lit("steps\n#### 1,"), "answer").alias("answer")).write.parquet(f"{root}/gsm8k/main/{s}")
    for s, names in datasets.CODE_CONFIGS.items():
        for i, c in enumerate(names):
            own = parts.where(F.col("p_partkey") % len(names) == i)
            own = own.select("problem", F.lit("def f(): pass").alias("starter_code")) if i else own.select(F.when(F.col("p_partkey") % 2 == 0, F.col("problem")).otherwise(" ").alias("question"))
            own.write.parquet(f"{root}/deepcoder/{c}/{s}")
    return datasets.Source(t.spark, root)


@query("""WITH p AS (SELECT p_partkey AS k, 'p' || p_partkey AS problem, CAST(p_size AS VARCHAR) AS a FROM part)
SELECT problem, a AS answer, 'math' AS dataset, 'train' AS split FROM p WHERE k % 9 <> 0 AND k % 5 <> 0 UNION ALL SELECT problem, a, 'math', 'test' FROM p WHERE k % 9 = 0 UNION ALL SELECT problem, a, 'polaris', 'train' FROM p WHERE k % 7 <> 0
UNION ALL SELECT problem, a, 'deepmath', 'train' FROM p WHERE k % 3 <> 0 UNION ALL SELECT problem, '1' || a, 'gsm8k', CASE WHEN k % 4 > 0 THEN 'train' ELSE 'test' END FROM p""")
def problem_registry(t):
    source = _problem_root(t)
    parts = []
    for name in ("math", "polaris", "deepmath", "gsm8k"):
        train, test = datasets.problems(source, name)
        parts += [df.withColumn("split", F.lit(s)) for df, s in ((train, "train"), (test, "test")) if df is not None]
    return datasets.concatenated(*parts)


@query("""WITH p AS (SELECT p_partkey AS k, 'p' || p_partkey AS problem FROM part) SELECT 'train' AS split, problem AS question, k % 3 > 0 AS has_code FROM p WHERE k % 3 > 0 OR k % 2 = 0 UNION ALL SELECT 'test', problem, k % 2 > 0 FROM p WHERE k % 2 > 0 OR k % 2 = 0""")
def coding_registry(t):
    train, test = datasets.problems(_problem_root(t), "deepcoder")
    mark = lambda df, s: df.select(F.lit(s).alias("split"), "question", F.contains("prompt", F.lit("def f(): pass")).alias("has_code"))
    return mark(train, "train").union(mark(test, "test"))


def _comparison_root(t) -> datasets.Source:
    root = scratch_folder(t.spark, "comparison_registry")
    d = t.documents.select(F.col("doc_id").alias("id"), "source", "lang", "n_chars")
    text = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    said = lambda x: text("Human: q", F.col("id").cast("string"), " Assistant: ", x)
    other = F.when(F.col("id") % 6 == 0, F.col("lang")).otherwise("other")
    for s in ("train", "test"):
        d.select("id", said(F.col("lang")).alias("chosen"), said(other).alias("rejected")).write.parquet(f"{root}/hhh/default/{s}")
    plain = F.array(preference.message("user", text("q", F.col("id").cast("string"))))
    for s in ("train", "validation"):
        d.select("id", plain.alias("context"), F.lit("one").alias("response1"), F.lit("two").alias("response2"), (F.col("id") % 3 - 1).cast("int").alias("overall_preference")).write.parquet(f"{root}/helpsteer3/preference/{s}")
    q = text("q", F.col("id").cast("string"))
    d.select("id", q.alias("instruction"), F.lit("yes").alias("chosen_response"), F.lit("no").alias("rejected_response")).write.parquet(f"{root}/ultrafeedback/default/train")
    pair = lambda x: F.array(preference.message("user", q), preference.message("assistant", F.lit(x)))
    d.select("id", q.alias("prompt"), pair("yes").alias("chosen"), pair("no").alias("rejected")).write.parquet(f"{root}/tulu_preference/default/train")
    block = lambda x, kind="text": F.array(F.struct(F.lit(kind).alias("type"), F.lit(x).alias("text")))
    talk = lambda x: F.array(F.struct(F.lit("user").alias("role"), block("q").alias("content")), F.struct(F.lit("assistant").alias("role"), x.alias("content")))
    image = F.when(F.col("id") % 5 == 0, block("x", "image")).otherwise(block("yes"))
    d.select("id", F.when(F.col("id") % 3 == 0, "model_a").when(F.col("id") % 3 == 1, "model_b").otherwise("tie").alias("winner"), talk(image).alias("conversation_a"), talk(block("no")).alias("conversation_b")).write.parquet(f"{root}/arena/default/train")
    d.select("id", F.col("source").alias("prompt"), F.concat(F.lit("r"), F.col("id").cast("string")).alias("response"), (F.col("n_chars") % 5).cast("int").alias("helpfulness")).write.parquet(f"{root}/helpsteer2/default/train")
    return datasets.Source(t.spark, root)


@query("""WITH n AS (SELECT count(*) AS n FROM documents), d AS (SELECT doc_id AS i FROM documents), h AS (SELECT count(DISTINCT source) AS s FROM (SELECT source FROM documents GROUP BY source HAVING count(*) >= 2 AND max(n_chars % 5) > min(n_chars % 5)))
SELECT 'hhh' AS dataset, count(*) AS n_train, (SELECT count(*) FROM d WHERE i % 6 <> 0) AS n_test, count(*) AS n_first FROM d WHERE i % 6 <> 0
UNION ALL SELECT 'helpsteer3', count(*), count(*), count(*) FILTER (i % 3 = 0) FROM d WHERE i % 3 <> 1 UNION ALL SELECT 'ultrafeedback', n - least(n // 4, n), n // 4, n - n // 4 FROM n UNION ALL SELECT 'tulu', n - n // 4, n // 4, n - n // 4 FROM n
UNION ALL SELECT 'helpsteer2', s - s // 10, s // 10, s - s // 10 FROM h""")
def comparison_registry(t):
    """Labelled comparisons of each dataset: rows for training and test, and how many training rows prefer the first."""
    source, quarter = _comparison_root(t), t.documents.count() // 4
    # the splits that are shuffled hold out a quarter; the others are whole
    options = {"hhh": {"test": 1 << 30}, "helpsteer3": {"test": 1 << 30}, "ultrafeedback": {"test": quarter}, "tulu": {"test": quarter}, "helpsteer2": {}}
    out = []
    for name, own in options.items():
        train, test = datasets.comparisons(source, name, **own)
        out.append(train.agg(F.lit(name).alias("dataset"), F.count("*").alias("n_train"), F.count(F.when(F.col("label") == "A", 1)).alias("n_first")).join(test.agg(F.count("*").alias("n_test")), F.lit(True)))
    return datasets.concatenated(*out).select("dataset", "n_train", "n_test", "n_first")


@query("SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'A' ELSE 'B' END AS label, 'q' AS asked, 'yes' AS first FROM documents WHERE doc_id % 3 <> 2 AND doc_id % 5 <> 0")
def arena_registry(t):
    parts = datasets.comparisons(_comparison_root(t), "arena", test=0)
    said = lambda c: F.element_at(c, 1)["content"]
    return datasets.concatenated(*parts).select("id", "label", said("prompt_conversation").alias("asked"), said("completion_a").alias("first"))


@query("SELECT doc_id AS example_id, source AS prompt, 'math' AS task, CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END AS answer, CASE WHEN doc_id % 3 = 0 THEN lang END AS hint FROM documents")
def environment_rows(t):
    docs = t.documents.select(F.col("doc_id").alias("example_id"), F.col("source").alias("prompt"), F.lit("math").alias("task"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("answer"), F.when(F.col("doc_id") % 3 == 0, F.create_map(F.lit("hint"), F.col("lang"))).alias("info"))
    return datasets.environment_rows(docs).select("example_id", "prompt", "task", "answer", F.col("info")["hint"].alias("hint"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN source || '|' || lang ELSE lang END AS gold, CASE WHEN doc_id % 2 = 0 THEN source END AS problem FROM documents")
def gold_answers(t):
    """Gold answers from the reward model's target, else the listed ones; problems by the first pair of names there is."""
    strings = "array<string>"
    target = F.when(F.col("doc_id") % 3 == 1, F.array("source", "lang")).otherwise(F.lit(None).cast(strings))
    golden = F.when(F.col("doc_id") % 3 == 2, F.array("lang")).otherwise(F.lit(None).cast(strings))
    docs = t.documents.withColumns({"reward_model": F.struct(F.struct(target.alias("target")).alias("ground_truth")), "golden_answers": golden})
    named = readers.key_variant(docs.select(F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("Problem"), F.col("doc_id").alias("Answer")), [("problem_text", "answer_text"), ("Problem", "Answer")])
    return docs.select("doc_id", F.array_join(readers.ground_truth(docs), "|").alias("gold")).join(named.select(F.col("answer").alias("doc_id"), "problem"), "doc_id")


@query("SELECT vec_id, CAST(len(embedding) AS INT) AS size FROM embeddings WHERE vec_id % 3 <> 0")
def checked_embeddings(t):
    rows = t.embeddings.withColumn("text", F.when(F.col("vec_id") % 3 == 0, " \n").otherwise("words"))
    return datasets.checked_embeddings(rows, 64, of="text").select("vec_id", F.size("embedding").alias("size"))


_MODELS = ["Qwen/Qwen3-8B", "meta-llama/Llama-3.1-8B", "openai/gpt-oss-20b", "other/model"]


@query("SELECT doc_id, name, templates, size FROM documents JOIN (VALUES (0, 'Qwen/Qwen3-8B', 'qwen3,qwen3_disable_thinking', '8B'), (1, 'meta-llama/Llama-3.1-8B', 'role_colon', '8B'), (2, 'openai/gpt-oss-20b', 'gpt_oss_no_sysprompt,gpt_oss_medium_reasoning', '21B-A3.6B'), (3, 'other/model', NULL, NULL)) v(k, name, templates, size) ON doc_id % 4 = k")
def model_lookup(t):
    """Documents with the attributes of the model that each is meant for; a model that isn't known has none."""
    names = t.documents.select("doc_id", F.element_at(F.array(*map(F.lit, _MODELS)), (F.col("doc_id") % 4 + 1).cast("int")).alias("model_name"))
    return accounting.with_models(names).select("doc_id", F.col("model_name").alias("name"), F.array_join("templates", ",").alias("templates"), "size")


@query("SELECT n_name FROM nation WHERE NOT contains(n_name, '1') AND NOT contains(n_name, '03')")
def names_left(t):
    return dataset.without_names(t.nation.select("n_name"), "n_name", ["1", "03"])


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 25")
def first_rows(t):
    """The feature is the limit: the first rows by id."""
    return dataset.first_rows(t.documents.select("doc_id", "lang"), "doc_id", 25)


@query("SELECT doc_id, source || '/' || lang AS datum, 'one' AS kind FROM documents UNION ALL SELECT doc_id, unnest([source, lang]), 'many' FROM documents")
def mapped_rows(t):
    docs = t.documents.select("doc_id", "source", "lang")
    one = dataset.mapped(docs, one=F.concat_ws("/", "source", "lang")).select("doc_id", "datum", F.lit("one").alias("kind"))
    return one.union(dataset.mapped(docs, many=F.array("source", "lang")).select("doc_id", "datum", F.lit("many").alias("kind")))


@query("SELECT doc_id, CAST(epoch AS INT) AS epoch FROM documents, range(3) r(epoch)")
def repeated_epochs(t):
    return dataset.repeated(t.documents.select("doc_id"), 3)


@query("SELECT o_orderkey, o_totalprice, c_name FROM (SELECT o_orderkey, o_totalprice, o_custkey FROM orders) JOIN (SELECT c_custkey, c_name FROM customer) ON o_custkey = c_custkey WHERE FALSE OR o_orderkey IS NOT NULL")
def strict_join(t):
    """Every order with its customer's name, carried over by order key; a key that a side lacks would be an error."""
    names = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")
    own = t.orders.join(names.select("o_orderkey"), "o_orderkey", "left_semi").select("o_orderkey", "o_totalprice")
    return dataset.joined_strictly(own, names, ["o_orderkey"])


@query("SELECT n_nationkey AS job, CASE n_nationkey % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'completed' WHEN 2 THEN 'failed' ELSE 'unknown' END AS status, 'new' || n_nationkey AS label, n_nationkey + 1 AS runs FROM nation")
def job_states(t):
    """States of jobs, and their metadata merged: new labels win, counts are added, the old status stays."""
    four, key = F.col("n_nationkey") % 4, F.col("n_nationkey")
    jobs = t.nation.select(key.cast("int").alias("job"), (four != 0).alias("dead"), F.when(four == 1, "completed").when(four == 2, "failed").alias("marker"))
    states = runlog.job_status(jobs).select("job", "status")
    old = states.select("job", F.create_map(F.lit("label"), F.lit("old")).alias("labels"), F.lit(1).alias("count"), "status")
    new = jobs.select("job", F.create_map(F.lit("label"), F.concat(F.lit("new"), F.col("job").cast("string"))).alias("labels"), F.col("job").alias("count"), F.lit("later").alias("status"))
    return runlog.merged_metadata(old, new, "job").select("job", "status", F.col("labels")["label"].alias("label"), F.col("count").alias("runs"))


@query("SELECT 'w' || r_regionkey AS name, CAST(r_regionkey + 1 AS BIGINT) AS rows, 3 AS columns FROM region")
def tensor_headers(t):
    """Headers of tensor files, a file each: eight bytes of length, then JSON. The files here have nothing behind it."""
    folder = scratch_folder(t.spark, "tensor_headers")
    name = F.concat(F.lit("w"), F.col("r_regionkey").cast("string"))
    header = F.concat(F.lit('{"__metadata__":{},"'), name, F.lit('":{"dtype":"F32","shape":['), (F.col("r_regionkey") + 1).cast("string"), F.lit(",3]}}"))
    files = t.region.select(F.col("r_regionkey").alias("file"), F.concat(F.char(F.length(header)), F.lit("\0" * 7), header).alias("value"))
    files.write.partitionBy("file").text(folder)
    paths = [r["path"] for r in t.spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder).select("path").collect()]
    t.spark.dataSource.register(readers.TensorHeaders)
    read = t.spark.read.format("tensor_headers").option("path", ",".join(paths)).load()
    return read.select("name", F.element_at("shape", 1).alias("rows"), F.element_at("shape", 2).cast("int").alias("columns"))


@query("SELECT user_id, 'env/all/' || event_type AS key, count(*)::DOUBLE AS value FROM events GROUP BY ALL")
def prefixed_metrics(t):
    from ..functions.arrays import prefixed

    counts = t.events.groupBy("user_id", "event_type").agg(F.count("*").cast("double").alias("n")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return counts.select("user_id", F.explode(prefixed(prefixed("m", "all"), "env")).alias("key", "value"))


@query("SELECT doc_id, CAST(strlen(source) + 1 AS BIGINT) AS n_tokens, source || '<|end|>' AS text, left(source, 2) AS head FROM documents")
def byte_tokens(t):
    """Texts as byte tokens with a special token at their end, back again, and cut after two."""
    from ..functions import tokens

    specials = ("<|end|>",)
    rows = t.documents.select("doc_id", F.concat("source", F.lit("<|end|>")).alias("text"), "source")
    ids = rows.select("doc_id", "source", tokens.encoder(specials=specials)("text").alias("ids"))
    return ids.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), tokens.decoder(specials=specials)("ids").alias("text"), tokens.truncated(2)("source").alias("head"))
