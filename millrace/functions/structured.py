"""Tool calls, code tests and other structured text as column expressions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import _col, strip

# The shape of a test, and the sentences that tools and prompts say.
TEST = "struct<input:string,output:string,testtype:string,metadata:map<string,string>>"
NO_SUMMARIES = "(No valid summaries available - students did not complete their responses)"
BAD_JSON, NO_QUERIES, BAD_QUERIES = "Invalid JSON in arguments", "query_list is required", "query_list must be a list of non-empty strings"
SEARCH_FAILED = "Error invoking search tool: "


def as_map(x: Column | str) -> Column:
    """A JSON object as a map of strings; empty if it is none."""
    return F.coalesce(F.from_json(_col(x), "map<string,string>"), F.create_map().cast("map<string,string>"))


def columns_to_tests(inputs: Column | str, outputs: Column | str, function: Column | str) -> Column:
    """Parallel inputs and outputs as tests; the shorter side goes on with its first element, or ''."""
    a, b, name = _col(inputs), _col(outputs), _col(function)
    n = F.greatest(F.coalesce(F.size(a), F.lit(0)), F.coalesce(F.size(b), F.lit(0)))
    at = lambda x, i: F.coalesce(F.try_element_at(x, i + 1), F.try_element_at(x, F.lit(1)), F.lit(""))
    metadata = F.when(name.isNotNull(), F.create_map(F.lit("func_name"), name)).otherwise(F.create_map().cast("map<string,string>"))

    def test(i: Column) -> Column:
        return F.struct(at(a, i).alias("input"), at(b, i).alias("output"), F.when(name.isNotNull(), "functional").otherwise("stdin_stdout").alias("testtype"), metadata.alias("metadata")).cast(TEST)

    # sequence() would count down for n = 0
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), test)).otherwise(F.array().cast(f"array<{TEST}>"))


def normalized_tests(raw: Column | str, default_function: Column | str) -> Column:
    """Tests of a JSON text in any of its shapes: parallel columns, one test, or a list; none if it can't be read.

    The type defaults to stdin_stdout. A functional test has a func_name, its own or the default; metadata without
    entries is func_name null.
    """
    raw, function = _col(raw), _col(default_function)
    v = F.try_parse_json(raw)
    has = lambda path: F.try_variant_get(v, path, "variant").isNotNull()
    # outputs that are lists count with their first element
    texts = lambda path: F.transform(F.try_variant_get(v, path, "array<variant>"), lambda x: F.coalesce(F.try_variant_get(x, "$[0]", "string"), F.try_variant_get(x, "$", "string")))
    listed = F.from_json(F.when(F.startswith(F.ltrim(raw), F.lit("[")), raw).otherwise(F.concat(F.lit("["), raw, F.lit("]"))), "array<struct<input:string,output:string,testtype:string,metadata:string>>")

    def one(t: Column) -> Column:
        kind = F.coalesce(F.nullif(t["testtype"], F.lit("")), F.lit("stdin_stdout"))
        own = as_map(t["metadata"])
        name = F.coalesce(F.nullif(own["func_name"], F.lit("")), function)
        # map_concat would refuse the key twice
        named = F.map_concat(F.map_filter(own, lambda k, _: k != "func_name"), F.create_map(F.lit("func_name"), name))
        full = F.when((kind == "functional") & name.isNotNull(), named).otherwise(own)
        metadata = F.when(F.size(full) == 0, F.create_map(F.lit("func_name"), F.lit(None).cast("string"))).otherwise(full)
        return F.struct(F.coalesce(t["input"], F.lit("")).alias("input"), F.coalesce(t["output"], F.lit("")).alias("output"), kind.alias("testtype"), metadata.alias("metadata")).cast(TEST)

    wide = columns_to_tests(texts("$.inputs"), texts("$.outputs"), F.try_variant_get(v, "$.fn_name", "string"))
    wide = F.transform(wide, lambda t: F.struct(t["input"], t["output"], t["testtype"], F.when(F.size(t["metadata"]) == 0, F.create_map(F.lit("func_name"), F.lit(None).cast("string"))).otherwise(t["metadata"]).alias("metadata")).cast(TEST))
    none = F.array().cast(f"array<{TEST}>")
    return F.when(v.isNull(), none).when(has("$.inputs") & has("$.outputs"), wide).otherwise(F.coalesce(F.transform(F.filter(listed, lambda t: t.isNotNull()), one), none))


def tests_to_columns(tests: Column | str) -> Column:
    """Tests as a JSON object of inputs, outputs and, for functions, fn_name; a function test without one is an error."""
    t = _col(tests)
    first = F.element_at(t, 1)
    name = F.when(first["testtype"] == "functional", F.coalesce(first["metadata"]["func_name"], F.raise_error(F.lit("function name missing")).cast("string")))
    return F.to_json(F.struct(F.transform(t, lambda x: x["input"]).alias("inputs"), F.transform(t, lambda x: x["output"]).alias("outputs"), name.alias("fn_name")))


def search_queries(arguments: Column | str) -> Column:
    """struct<queries, error> of a search tool's arguments; one of the two is null."""
    v = F.try_parse_json(_col(arguments))
    listed = F.try_variant_get(v, "$.query_list", "array<variant>")
    each = F.transform(listed, lambda q: F.when(F.schema_of_variant(q) == "STRING", F.try_variant_get(q, "$", "string")))
    bad = (F.size(listed) == 0) | F.exists(each, lambda q: F.coalesce(strip(q), F.lit("")) == "")
    say = lambda s: F.lit(SEARCH_FAILED + s)
    why = F.concat(say(BAD_JSON), F.lit(" - "), json_error(arguments))
    error = F.when(v.isNull(), F.coalesce(why, say(BAD_JSON))).when(listed.isNull(), say(NO_QUERIES)).when(bad, say(BAD_QUERIES))
    return F.struct(F.when(error.isNull(), each).alias("queries"), error.alias("error"))


def search_message(results: Column | str) -> Column:
    """Text of array<struct<query, documents>>: queries, each with its numbered documents."""

    def block(r: Column) -> Column:
        docs = F.transform(r["documents"], lambda d, i: F.concat(F.lit("Document "), (i + 1).cast("string"), F.lit(":\n"), d, F.lit("\n")))
        return F.concat(F.lit("Query: "), r["query"], F.lit("\n"), F.array_join(docs, ""))

    return F.array_join(F.transform(_col(results), block), "")


def numbered_summaries(summaries: Column | str) -> Column:
    """Non-empty summaries numbered by their place among all, a line each; a fixed sentence if there are none."""
    lines = F.transform(_col(summaries), lambda s, i: F.when(F.coalesce(s, F.lit("")) != "", F.concat(F.lit("Student solution "), (i + 1).cast("string"), F.lit(": "), s)))
    lines = F.filter(lines, lambda x: x.isNotNull())
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(F.lit(NO_SUMMARIES))


def second_prompt(prompt: Column | str, first: Column | str, first_text: Column | str, continuation: Column | str) -> Column:
    """struct<prompt, first>: the prompt for the answer after a first step of thinking; a step without </think> gets the continuation."""
    own = F.when(F.contains(_col(first_text), F.lit("</think>")), _col(first)).otherwise(F.concat(_col(first), _col(continuation)))
    return F.struct(F.concat(_col(prompt), own).alias("prompt"), own.alias("first"))


def cut_bytes(x: Column | str, most: int) -> Column:
    """At most so many byte tokens of a text; characters that the cut splits go."""
    b = F.substring(F.encode(_col(x), "UTF-8"), 1, most)
    text = F.when(F.octet_length(_col(x)) <= most, _col(x)).otherwise(F.try_validate_utf8(b.cast("string")))
    shorter = [F.try_validate_utf8(F.substring(F.encode(_col(x), "UTF-8"), 1, max(0, most - k)).cast("string")) for k in (1, 2, 3)]
    return F.coalesce(text, *shorter)


def _blocks(calls: pd.Series) -> pd.Series:
    def text(own) -> str | None:
        if own is None:
            return None
        return "\n".join("<tool_call>\n" + json.dumps({"name": c["function"]["name"], "args": json.loads(c["function"]["arguments"])}) + "\n</tool_call>" for c in own)

    return calls.map(text)


def _decoding_errors(texts: pd.Series) -> pd.Series:
    def error(text) -> str | None:
        try:
            json.loads(text or "")
        except json.JSONDecodeError as e:
            return str(e)
        return None

    return texts.map(error)


#: Why a text isn't JSON, in the decoder's words; null if it is.
json_error = F.pandas_udf(_decoding_errors, StringType())
#: tool_text of a message's tool_calls: array<struct<function:struct<name, arguments>>>. JSON spacing is Python's, hence a UDF.
tool_call_blocks = F.pandas_udf(_blocks, StringType())
