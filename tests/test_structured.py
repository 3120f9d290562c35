import json

import pytest
from pyspark.sql import functions as F

from millrace.functions import structured as s
from millrace.functions import tokens


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def arr(*x):
    return F.array(*[F.lit(v) for v in x])


def test_parallel_columns_go_on_with_their_first_element(spark):
    none = F.lit(None).cast("string")
    get = lambda a, b, f=none: [(t.input, t.output, t.testtype) for t in one(spark, s.columns_to_tests(a, b, f))]
    assert get(arr("1", "2"), arr("x")) == [("1", "x", "stdin_stdout"), ("2", "x", "stdin_stdout")]
    empty = F.array().cast("array<string>")
    assert get(empty, empty) == [] and get(empty, arr("x"), F.lit("f")) == [("", "x", "functional")]


def test_tests_in_any_shape(spark):
    def get(raw):
        return [(t.input, t.output, t.testtype, t.metadata) for t in one(spark, s.normalized_tests(F.lit(raw), F.lit("main")))]

    assert get("oops") == [] and get("[]") == []
    assert get('{"inputs": ["1", "2"], "outputs": [["a", "b"], ["c"]]}') == [("1", "a", "stdin_stdout", {"func_name": None}), ("2", "c", "stdin_stdout", {"func_name": None})]
    assert get('[{"input": "1", "output": "2", "testtype": "functional", "metadata": {"func_name": "g"}}, {"input": "3"}]') == [("1", "2", "functional", {"func_name": "g"}), ("3", "", "stdin_stdout", {"func_name": None})]
    assert get('{"input": 1, "output": "x", "testtype": "functional"}') == [("1", "x", "functional", {"func_name": "main"})]


def test_columns_need_a_function_name(spark):
    row = lambda name: F.array(F.struct(F.lit("1").alias("input"), F.lit("2").alias("output"), F.lit("functional").alias("testtype"), F.create_map(F.lit("func_name"), F.lit(name).cast("string")).alias("metadata")))
    assert json.loads(one(spark, s.tests_to_columns(row("f")))) == {"inputs": ["1"], "outputs": ["2"], "fn_name": "f"}
    with pytest.raises(Exception, match="function name missing"):
        one(spark, s.tests_to_columns(row(None)))


def test_search_arguments(spark):
    get = lambda x: one(spark, s.search_queries(F.lit(x)))
    assert get('{"query_list": ["a", "b"]}').queries == ["a", "b"]
    said = [get(x).error for x in ("{", "{}", '{"query_list": "a"}', '{"query_list": []}', '{"query_list": [" "]}', '{"query_list": [1]}')]
    assert [e.split(": ")[1][:12] for e in said] == ["Invalid JSON", "query_list i", "query_list i", "query_list m", "query_list m", "query_list m"]
    results = F.array(F.struct(F.lit("q").alias("query"), arr("x", "y").alias("documents")))
    assert one(spark, s.search_message(results)) == "Query: q\nDocument 1:\nx\nDocument 2:\ny\n"


def test_summaries_and_prompts(spark):
    assert one(spark, s.numbered_summaries(F.array(F.lit(""), F.lit("b"), F.lit(None)))) == "Student solution 2: b"
    assert one(spark, s.numbered_summaries(F.array(F.lit("")))) == s.NO_SUMMARIES
    r = one(spark, s.second_prompt(arr(1), arr(2), F.lit("no end"), arr(9)))
    assert (r.prompt, r.first) == ([1, 2, 9], [2, 9])
    assert [one(spark, s.cut_bytes(F.lit("aé日"), k)) for k in (1, 2, 3, 5, 6)] == ["a", "a", "aé", "aé", "aé日"]
    assert one(spark, s.as_map(F.lit("[1]"))) == {} and one(spark, s.as_map(F.lit('{"a": 1}'))) == {"a": "1"}


def test_tool_calls_as_text(spark):
    calls = F.array(F.struct(F.struct(F.lit("f").alias("name"), F.lit('{"x":[1,2]}').alias("arguments")).alias("function")))
    assert one(spark, s.tool_call_blocks(calls)) == '<tool_call>\n{"name": "f", "args": {"x": [1, 2]}}\n</tool_call>'


def test_codecs(spark):
    specials = ("<|a|>", "<|b|>")
    ids = one(spark, tokens.encoder(specials=specials)(F.lit("é<|b|>x")))
    assert ids == [195, 169, 257, 120]
    assert one(spark, tokens.decoder(specials=specials)(arr(*ids))) == "é<|b|>x"
