"""Queries on scalar functions: arrays, numbers, texts, structured texts, answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import arrays, grade, numbers, structured, text
from ..operators import preference
from .registry import query


def _joined(x: Column) -> Column:
    return F.array_join(F.transform(x, lambda v: v.cast("string")), ",")


_LISTS = "WITH p AS (SELECT p_partkey, p_size % 6 + 1 AS n, p_partkey % 2 AS gap FROM part), l AS (SELECT *, range(1, n + 1) AS t, [i * 0.5::DOUBLE FOR i IN range(1, n + 1)] AS v, [i FOR i IN range(1, n + 1) IF i % 2 = 1] AS odd FROM p)"


def _lists(t):
    p = t.part.select("p_partkey", (F.col("p_size") % 6 + 1).cast("bigint").alias("n"), (F.col("p_partkey") % 2).alias("gap"))
    p = p.withColumn("t", F.sequence(F.lit(1).cast("bigint"), F.col("n")))
    return p.withColumns({"v": F.transform("t", lambda i: i * F.lit(0.5)), "mask": F.transform("t", lambda i: (i % 2).cast("double"))})


@query(f"""{_LISTS} SELECT p_partkey, n >= 2 AS begins, array_to_string(t[1:n-1], ',') AS inputs, array_to_string(t[2:n], ',') AS targets, CASE WHEN n > 1 THEN array_to_string(t, ',') ELSE '' END AS whole,
 array_to_string(t[1:least(n, 3)], ',') AS head, CASE WHEN n >= 3 THEN '1,2,3' END AS cut, array_to_string(odd, ',') AS trained, '7,' || array_to_string(odd, ',') AS regenerated, array_to_string(list_sort(list_intersect(t, [2, 3, 9])), ',') AS common, array_to_string(list_concat(t, [0]), ',') AS flat FROM l""")
def token_arrays(t):
    p = _lists(t)
    a = lambda *x: F.array(*[F.lit(v).cast("bigint") for v in x])
    ins, outs = arrays.inputs("t"), arrays.targets("t")
    return p.select(
        "p_partkey", arrays.is_prefix(a(1, 2), "t").alias("begins"), _joined(ins).alias("inputs"), _joined(outs).alias("targets"), _joined(arrays.whole_sequence(ins, outs)).alias("whole"),
        _joined(arrays.head("t", 3)).alias("head"), _joined(arrays.cut_after_first_one("t", F.transform("t", lambda i: (i == 3).cast("int")))).alias("cut"), _joined(arrays.where_mask("t", "mask")).alias("trained"),
        _joined(arrays.regenerated(a(7), "t", "mask")).alias("regenerated"), _joined(arrays.common_elements("t", a(3, 9, 2))).alias("common"), _joined(arrays.flattened(F.array(F.col("t"), a(0)))).alias("flat"),
    )


@query(f"""{_LISTS}, d AS (SELECT p_partkey, n, gap, v, len(odd) AS k, list_sum([x / 2.0 FOR x IN odd]) AS dot, list_sum([0.5::DOUBLE * i * pow(0.5, i - 1) FOR i IN t]) AS future, list_sum([0.5::DOUBLE * i FOR i IN t]) AS total FROM l)
SELECT p_partkey, round(dot, 6) AS dot, round(total, 6) AS total, round(future, 6) AS future, round(0.5::DOUBLE * n, 6) AS last_future, '0.0,0.0,' || array_to_string([x::DOUBLE FOR x IN v], ',') AS padded,
 array_to_string([CASE WHEN gap = 0 AND i % 2 = 1 THEN -(i + 1) / 2.0::DOUBLE ELSE 0.0::DOUBLE END FOR i IN range(1, n + 1)], ',') AS spread FROM d""")
def value_arrays(t):
    p = _lists(t).withColumn("k", F.size(arrays.where_mask("t", "mask")))
    # one value too few where gap is 1: then nothing is spread
    p = p.withColumn("values", F.transform(F.sequence(F.lit(1), F.col("k")), lambda j: -j.cast("double")))
    p = p.withColumn("values", F.slice("values", F.lit(1), F.col("k") - F.col("gap").cast("int")))
    future = arrays.discounted("v", 0.5)
    return p.select(
        "p_partkey", F.round(arrays.dot("v", "mask"), 6).alias("dot"), F.round(arrays.total("v"), 6).alias("total"), F.round(F.element_at(future, 1), 6).alias("future"), F.round(F.element_at(future, -1), 6).alias("last_future"),
        _joined(arrays.padded(F.lit(2), "v")).alias("padded"), _joined(arrays.scattered("values", "mask")).alias("spread"),
    )


@query("""WITH p AS (SELECT p_partkey, p_size::DOUBLE AS s, p_size % 2 = 0 AS correct, p_size % 3 = 0 AS formed FROM part)
SELECT p_partkey, round(correct::INT + 0.1 * (formed::INT - 1), 6)::DOUBLE AS reward, round(1 - s / 50, 6) AS linear, round(greatest(1 - s / 25, 0), 6) AS floored, 1.0::DOUBLE AS constant, round((s + 1) / 50, 6) AS progress,
 round(5e-5 * 10 * pow(2000 / s, 0.781) * 1000, 6) AS llama_rate, round(5e-5 * pow(2000 / s, 0.0775) * 1000, 6) AS qwen_rate, CASE p_partkey % 3 WHEN 0 THEN -1.0 WHEN 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS preferred,
 round(abs(s - 10) / greatest(s, 10), 6) AS apart, round(greatest(-(s - 25), 0) + ln(1 + exp(-abs(s - 25))), 6) AS surprise FROM p""")
def number_functions(t):
    s, right, formed = F.col("p_size").cast("double"), F.col("p_size") % 2 == 0, F.col("p_size") % 3 == 0
    said = F.when(F.col("p_partkey") % 3 == 0, " A ").when(F.col("p_partkey") % 3 == 1, "B\n").otherwise("Tie")
    return t.part.select(
        "p_partkey", F.round(numbers.shaped_reward(right, formed), 6).alias("reward"), F.round(numbers.learning_rate(s, F.lit(50.0)), 6).alias("linear"), F.round(numbers.learning_rate(s, F.lit(25.0), floor=0.0), 6).alias("floored"),
        numbers.learning_rate(s, F.lit(50), "constant").alias("constant"), F.round(numbers.progress(s, F.lit(50)), 6).alias("progress"), F.round(numbers.recommended_lr(F.lit("meta-llama/x"), s) * 1000, 6).alias("llama_rate"),
        F.round(numbers.recommended_lr(F.lit("Qwen/x"), s, lora=False) * 1000, 6).alias("qwen_rate"), numbers.preference_value(said).alias("preferred"), F.round(numbers.relative_difference(s, F.lit(10.0)), 6).alias("apart"), F.round(numbers.neg_log_sigmoid(s - 25), 6).alias("surprise"),
    )


#: The coding prompt as the SQL expects it. Fixed values.
_PROMPT = "You are an expert Python programmer. You will be given a question (problem specification) and will generate a correct Python program that matches the specification and passes all tests."
_STARTER = "You will use the following starter code to write the solution to the problem and enclose your code within delimiters."
_NO_STARTER = "Read the inputs from stdin solve the problem and write the answer to stdout (do not directly test on the sample inputs). Enclose your code within delimiters as follows. Ensure that when the python program runs, it reads the inputs, runs the algorithm and writes output to STDOUT."


@query(f"""SELECT doc_id, contains(lower(text), lower(source)) AS has_source, doc_id AS first_number, '<' || source || '>{{x}}{{lang}}' AS filled, TRUE AS same_output, doc_id % 2 = 0 AS other_output,
 CASE WHEN length(text) > 200 THEN left(text, 100) || '...' || right(text, 50) ELSE text END AS preview, CASE WHEN doc_id % 2 = 0 THEN source END AS first_word,
 CASE WHEN doc_id % 3 = 0 THEN 'Correct' WHEN doc_id % 3 = 1 THEN 'Too low' END AS feedback, source || ' ' || lang AS parts, 'user: ' || lang AS inspected,
 '{_PROMPT}' || chr(10) || chr(10) || source || '### Format: ' || CASE WHEN doc_id % 2 = 0 THEN '{_STARTER}' ELSE '{_NO_STARTER}' END || chr(10) || '```python' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'def f(): pass' ELSE '# YOUR CODE HERE' END || chr(10) || '```' || chr(10) || chr(10) || '### Answer: (use the provided format with backticks)' || chr(10) || chr(10) AS prompt FROM documents""")
def text_functions(t):
    d, even = F.col("doc_id"), F.col("doc_id") % 2 == 0
    number = d.cast("string")
    parts = F.array(*[F.struct(F.lit("text").alias("type"), F.col(c).alias("text")) for c in ("source", "lang")])
    said = F.concat(F.lit("Guess: "), F.when(d % 3 == 0, number).when(d % 3 == 1, (d - 1).cast("string")).otherwise("none"))
    message = F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit("\n "), "lang", F.lit(" ")).alias("content")))
    seen = F.element_at(text.inspect_messages(message), 1)
    return t.documents.select(
        "doc_id", text.contains_answer("text", "source").alias("has_source"), text.first_integer(F.concat(F.lit(" \n"), number, F.lit(" apples"))).alias("first_number"),
        text.fill("<{a}>{b}", a="source", b=F.lit("{x}{lang}")).alias("filled"), text.stdout_equal(F.array(F.col("source"), F.lit(" ")), F.concat(F.lit("\n"), F.col("source"))).alias("same_output"),
        text.stdout_equal(F.array(number), F.when(even, number).otherwise("-")).alias("other_output"), text.preview("text").alias("preview"), text.first_filled(F.when(even, F.col("source")), F.lit("  ")).alias("first_word"),
        text.guess_feedback(said, d).alias("feedback"), preference.plain_parts(parts).alias("parts"), F.concat_ws(": ", seen["role"], seen["content"]).alias("inspected"),
        text.code_prompt("source", F.when(even, "def f(): pass").otherwise(" ")).alias("prompt"),
    )


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'runs/exp_a/' ELSE 'runs/' END AS shared, CASE WHEN p_partkey % 3 = 0 THEN 'lr=3/bs-' || p_size WHEN p_partkey % 3 = 1 THEN '...-long-enough-name' ELSE '...long_folder_name' || right('000000' || p_size, 1) END AS short FROM (SELECT p_partkey, p_size % 10 AS p_size FROM part)""")
def path_names(t):
    n = F.col("p_size") % 10
    path = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("learning_rate=3/batch_size-"), n.cast("string"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("a_long_b/long/"), n.cast("string"), F.lit("-long-enough-name"))).otherwise(F.concat(F.lit("one_very_long_folder_name"), n.cast("string")))
    other = F.when(F.col("p_partkey") % 2 == 0, "runs/exp_a/y").otherwise("runs/other")
    short = text.abbreviated_path(path)
    return t.part.select("p_partkey", text.boundary_prefix(F.least(F.lit("runs/exp_a/x"), other), F.greatest(F.lit("runs/exp_a/x"), other)).alias("shared"), short.alias("short"))


@query("""SELECT p_partkey, p_partkey % 2 = 0 AS is_call, CASE WHEN p_partkey % 2 = 0 THEN 'f' || p_size END AS called, CASE WHEN p_partkey % 2 = 0 THEN '{"q":' || p_size || '}' END AS args,
 CASE p_partkey % 3 WHEN 0 THEN 'q' || p_size END AS queries, CASE p_partkey % 3 WHEN 1 THEN 'Error invoking search tool: query_list is required' WHEN 2 THEN 'Error invoking search tool: Invalid JSON in arguments - Expecting value: line 1 column 1 (char 0)' END AS error,
 'Query: q' || chr(10) || 'Document 1:' || chr(10) || 'a' || p_size || chr(10) || 'Document 2:' || chr(10) || 'b' || chr(10) AS message, CASE WHEN p_partkey % 2 = 0 THEN 'Student solution 2: s' || p_size ELSE '(No valid summaries available - students did not complete their responses)' END AS summaries,
 'v' || p_size AS from_map, 'aé' AS cut, CASE WHEN p_partkey % 2 = 0 THEN '1,2' ELSE '1,2,9' END AS second, '<tool_call>' || chr(10) || '{"name": "f", "args": {"q": ' || p_size || '}}' || chr(10) || '</tool_call>' AS block FROM part""")
def structured_texts(t):
    even, three, n = F.col("p_partkey") % 2 == 0, F.col("p_partkey") % 3, F.col("p_size").cast("string")
    call = text.tool_call(F.when(even, F.concat(F.lit('so <tool_call>{"name": "f'), n, F.lit('", "args": {"q": '), n, F.lit("}}</tool_call>"))).otherwise('<tool_call>{"name": 1}</tool_call>'))
    found = structured.search_queries(F.when(three == 0, F.concat(F.lit('{"query_list": ["q'), n, F.lit('"]}'))).when(three == 1, "{}").otherwise("oops"))
    results = F.array(F.struct(F.lit("q").alias("query"), F.array(F.concat(F.lit("a"), n), F.lit("b")).alias("documents")))
    steps = structured.second_prompt(F.array(F.lit(1)), F.array(F.lit(2)), F.when(even, "x</think>").otherwise("x"), F.array(F.lit(9)))
    calls = F.array(F.struct(F.struct(F.lit("f").alias("name"), F.concat(F.lit('{"q":'), n, F.lit("}")).alias("arguments")).alias("function")))
    return t.part.select(
        "p_partkey", call["ok"].alias("is_call"), call["name"].alias("called"), call["args"].alias("args"), F.element_at(found["queries"], 1).alias("queries"), found["error"].alias("error"), structured.search_message(results).alias("message"),
        structured.numbered_summaries(F.array(F.lit(""), F.when(even, F.concat(F.lit("s"), n)))).alias("summaries"), structured.as_map(F.concat(F.lit('{"k": "v'), n, F.lit('"}')))["k"].alias("from_map"), structured.cut_bytes(F.lit("aé日"), 5).alias("cut"),
        _joined(steps["prompt"]).alias("second"), structured.tool_call_blocks(calls).alias("block"),
    )


@query("""SELECT p_partkey, CAST(CASE p_partkey % 4 WHEN 3 THEN 0 WHEN 0 THEN 2 ELSE 1 END AS BIGINT) AS n_tests, CASE p_partkey % 4 WHEN 0 THEN '1|2' WHEN 1 THEN 'in' || p_size WHEN 2 THEN 'x' ELSE '' END AS inputs, CASE p_partkey % 4 WHEN 0 THEN 'a|a' WHEN 1 THEN 'out' WHEN 2 THEN '' ELSE '' END AS outputs,
 CASE p_partkey % 4 WHEN 1 THEN 'functional' WHEN 3 THEN NULL ELSE 'stdin_stdout' END AS kind, CASE p_partkey % 4 WHEN 1 THEN 'main' END AS called, CASE p_partkey % 4 WHEN 1 THEN '{"inputs":["in' || p_size || '"],"outputs":["out"],"fn_name":"main"}' END AS as_columns FROM part""")
def code_tests(t):
    """Tests in their shapes: parallel columns, one functional test, a list, and unreadable text."""
    four, n = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    raw = (
        F.when(four == 0, '{"inputs": ["1", "2"], "outputs": ["a"]}').when(four == 1, F.concat(F.lit('{"input": "in'), n, F.lit('", "output": "out", "testtype": "functional"}')))
        .when(four == 2, '[{"input": "x"}]').otherwise("oops")
    )
    rows = t.part.select("p_partkey", four.alias("four"), structured.normalized_tests(raw, F.lit("main")).alias("tests"))
    each = lambda c: F.array_join(F.transform("tests", lambda x: x[c]), "|")
    first = F.try_element_at("tests", F.lit(1))
    return rows.select("p_partkey", F.size("tests").cast("bigint").alias("n_tests"), each("input").alias("inputs"), each("output").alias("outputs"), first["testtype"].alias("kind"), first["metadata"]["func_name"].alias("called"), F.when(F.col("four") == 1, structured.tests_to_columns("tests")).alias("as_columns"))


#: Answers with their competition and lenient forms, worked out by hand.
_FORMS = [
    ("0.5", r"\frac{1}{2}", "0.5"), ("1/2", r"\frac{1}{2}", "1/2"), ("x=5", "5", "x=5"), (r"\sqrt3", r"\sqrt{3}", "sqrt3"), (r"\frac12", r"\frac{1}{2}", "12"), (r"\text{yes}", "yes", "yes"),
    (r"\frac{1}{2}", r"\frac{1}{2}", "1/2"), ("1,000", "1,000", "1000"), (r"50\%", "50", "50"), ("3 million", "3million", "3*10^6"), ("5 cm", "5cm", "5"), ("7.0", "7.0", "7"), ("Yes", "Yes", "yes"), (r"\frac", r"\frac", ""), ("01/2", "01/2", "01/2"),
]
_GRADES = [("1,000", "1000", True), (r"50\%", "50", True), ("2+2", "4", False), ("x+1", "1+x", False), ("(1,2)", "(1, 2)", True), ("[1,2)", "(1,2)", False), ("(1/2,3/4)", "(1/2, 3/4)", True), ("2/4", "1/2", False), ("", "1", False)]
_sql = lambda rows: ", ".join("(" + ", ".join(str(v).upper() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" for v in r) + ")" for r in rows)


@query(f"SELECT p_partkey, f.answer, f.competition, f.lenient FROM part JOIN (SELECT *, row_number() OVER () - 1 AS k FROM (VALUES {_sql(_FORMS)}) v(answer, competition, lenient)) f ON p_partkey % {len(_FORMS)} = k")
def answer_forms(t):
    """Answers of all kinds, one for each part, in either normal form."""
    answers = F.array(*[F.lit(a) for a, _, _ in _FORMS])
    rows = t.part.select("p_partkey", F.element_at(answers, (F.col("p_partkey") % len(_FORMS) + 1).cast("int")).alias("answer"))
    return rows.select("p_partkey", "answer", grade.normal_form("answer").alias("competition"), grade.lenient_answer("answer").alias("lenient"))


@query(f"SELECT p_partkey, f.given, f.truth, f.correct FROM part JOIN (SELECT *, row_number() OVER () - 1 AS k FROM (VALUES {_sql(_GRADES)}) v(given, truth, correct)) f ON p_partkey % {len(_GRADES)} = k")
def graded_pairs(t):
    """A given answer and the truth for each part, graded."""
    pairs = F.array(*[F.struct(F.lit(a).alias("given"), F.lit(b).alias("truth")) for a, b, _ in _GRADES])
    rows = t.part.select("p_partkey", F.element_at(pairs, (F.col("p_partkey") % len(_GRADES) + 1).cast("int")).alias("p"))
    return rows.select("p_partkey", "p.given", "p.truth", grade.grade_answer("p.given", "p.truth").alias("correct"))


@query("SELECT p_partkey, CAST(k AS INT) AS spelling, k <> 3 AS same, k = 5 AS gated FROM part, range(6) r(k)")
def algebra_grade(t):
    """Expressions in each part's size, told equal by algebra: expanded squares, fractions, roots, products in another order; one is another number, one is spelled alike."""
    n = F.col("p_size").cast("string")
    two, square, next_n = (x.cast("string") for x in (F.col("p_size") * 2, F.col("p_size") * F.col("p_size"), F.col("p_size") + 1))
    pair = lambda *parts: F.struct(F.concat(*parts[0]).alias("given"), F.concat(*parts[1]).alias("truth"))
    lit = F.lit
    pairs = F.array(
        pair([lit("(x+"), n, lit(")^2")], [lit("x^2+"), two, lit("x+"), square]), pair([lit("\\frac{"), n, lit("}{2}x")], [n, lit("x/2")]), pair([lit("\\sqrt{"), square, lit("}+y")], [lit("y+"), n]),
        pair([next_n, lit("x")], [n, lit("x")]), pair([n, lit("ab")], [lit("b"), n, lit("a")]), pair([n], [n, lit(".0")]),
    )
    rows = t.part.select("p_partkey", F.posexplode(pairs).alias("spelling", "p"))
    return rows.select("p_partkey", "spelling", grade.grade_answer_by_algebra("p.given", "p.truth").alias("same"), grade.grade_answer("p.given", "p.truth").alias("gated"))


_N = "CAST(p_size AS VARCHAR)"


@query(f"""WITH s(spelling) AS (VALUES (0), (1), (2), (3), (4)) SELECT p_partkey, CAST(spelling AS INT) AS spelling, CASE spelling WHEN 0 THEN {_N} WHEN 1 THEN '\\text{{' || {_N} || '}}' WHEN 2 THEN {_N} || '.0' WHEN 3 THEN {_N} || '+1' END AS given, {_N} AS truth, spelling < 3 AS correct FROM part, s""")
def boxed_grade(t):
    """Answers in several spellings, graded against the plain one."""
    n = F.col("p_size").cast("string")
    said = F.array(F.concat(F.lit("\\boxed{"), n, F.lit("}")), F.concat(F.lit("\\boxed{\\text{"), n, F.lit("}}")), F.concat(F.lit("x \\boxed{0} \\boxed{"), n, F.lit(".0}")), F.concat(F.lit("\\boxed{"), n, F.lit("+1}")), F.lit("} \\boxed{1}"))
    rows = t.part.select("p_partkey", n.alias("truth"), F.posexplode(said).alias("spelling", "said"))
    rows = rows.withColumn("given", grade.extract_boxed("said"))
    return rows.select("p_partkey", "spelling", "given", "truth", grade.grade_answer("given", "truth").alias("correct"))
