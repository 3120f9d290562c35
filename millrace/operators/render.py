"""Conversations as rendered, weighted text (and tokens), one template per model family.

A conversation is an array of message structs (role, content, and optionally
thinking, tool_text, trainable). A message becomes an observed part, an action
part, and a tail that only the last message's action gets. Everything is a column
expression; strings are built before they are tokenised.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import _col, capitalize, strip

TRAIN_ON = ("last_assistant_message", "all_assistant_messages", "all_messages", "all_tokens", "all_user_and_system_messages", "customized")
# Control tokens of one model family.
_DEEP = {"User": "<｜User｜>", "Assistant": "<｜Assistant｜>", "begin": "<｜begin▁of▁sentence｜>", "end": "<｜end▁of▁sentence｜>"}
_DEEP_BEGIN, _DEEP_END = _DEEP["begin"], _DEEP["end"]
# Fixed value: the system message of this template.
_GPT_SYSTEM = "<|start|>system<|message|>You are ChatGPT, a large language model trained by OpenAI.\nKnowledge cutoff: 2024-06\nCurrent date: {date}\n\nReasoning: {effort}\n\n# Valid channels: analysis, commentary, final. Channel must be included for every message.<|end|>"

Part = tuple[Column, Column, Column]


def _has(fields: set[str], m: Column, name: str) -> Column:
    return m[name] if name in fields else F.lit(None).cast("string")


def _content(m: Column, fields: set[str]) -> Column:
    return F.concat(m["content"], F.coalesce(_has(fields, m, "tool_text"), F.lit("")))


def _role_colon(m, i, last, fields) -> Part:
    return F.concat(capitalize(m["role"]), F.lit(":")), F.concat(F.lit(" "), m["content"], F.lit("\n\n")), F.when(m["role"] == "assistant", "User:").otherwise("<UNUSED>")


def _llama3(m, i, last, fields) -> Part:
    return F.concat(F.lit("<|start_header_id|>"), m["role"], F.lit("<|end_header_id|>\n\n")), F.concat(m["content"], F.lit("<|eot_id|>")), F.lit("")


def _chatml(m, i, last, fields, think: bool) -> Part:
    begin = F.concat(F.when(i > 0, "\n").otherwise(""), F.lit("<|im_start|>"), m["role"], F.lit("\n"))
    if think:
        silent = (m["role"] == "assistant") & ~m["content"].contains("</think>") & ~m["content"].contains("<think>")
        begin = F.concat(begin, F.when(silent, "<think>").otherwise(""))
    return begin, F.concat(_content(m, fields), F.lit("<|im_end|>")), F.lit("")


def _deepseek(m, i, last, fields, system_as_user: bool, close_thinking: bool) -> Part:
    users = ["user", "system"] if system_as_user else ["user"]
    begin = F.when(m["role"].isin(users), _DEEP["User"]).when(m["role"] == "assistant", _DEEP["Assistant"]).otherwise(F.raise_error(F.concat(F.lit("unsupported role: "), m["role"])).cast("string"))
    text = m["content"]
    if close_thinking:
        text = F.when((m["role"] == "assistant") & ~text.startswith("<think>") & ~text.startswith("</think>"), F.concat(F.lit("</think>"), text)).otherwise(text)
    return begin, F.concat(text, F.when(m["role"] == "assistant", _DEEP_END).otherwise("")), F.lit("")


def _gpt_oss(m, i, last, fields) -> Part:
    thinking = F.coalesce(_has(fields, m, "thinking"), F.lit(""))
    thought = F.when(last & (thinking != ""), F.concat(F.lit("<|channel|>analysis<|message|>"), thinking, F.lit("<|end|><|start|>assistant"))).otherwise("")
    said = F.when(m["role"] == "assistant", F.concat(thought, F.lit("<|channel|>final<|message|>"), m["content"])).otherwise(F.concat(F.lit("<|message|>"), m["content"]))
    return F.concat(F.lit("<|start|>"), m["role"]), F.concat(said, F.when(last, "<|return|>").otherwise("<|end|>")), F.lit("")


class Template:
    """How one model family writes conversations."""

    def __init__(self, message: Callable[..., Part], start: str = "", prefill: str = "", stop: str = "", specials: tuple[str, ...] = ()):
        self.message, self.start, self.prefill, self.stop, self.specials = message, start, prefill, stop, specials


_CHATML = ("<|im_start|>", "<|im_end|>")
_GPT = ("<|start|>", "<|message|>", "<|channel|>", "<|end|>", "<|return|>")


def template(name: str, date: str = "2025-01-01", bos: str = "") -> Template:
    """A template by name; ``date`` is what gpt_oss system messages say, ``bos`` what role_colon starts with."""
    if name.startswith("gpt_oss_"):
        effort = name.removeprefix("gpt_oss_").removesuffix("_reasoning")
        if name == "gpt_oss_no_sysprompt":
            return Template(_gpt_oss, stop="<|return|>", specials=_GPT)
        if effort in ("low", "medium", "high"):
            return Template(_gpt_oss, _GPT_SYSTEM.format(date=date, effort=effort), stop="<|return|>", specials=_GPT)
    known = {
        "role_colon": lambda: Template(_role_colon, bos, stop="\n\nUser:"),
        "llama3": lambda: Template(_llama3, "<|begin_of_text|>", stop="<|eot_id|>", specials=("<|begin_of_text|>", "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>")),
        "qwen3": lambda: Template(lambda *a: _chatml(*a, think=True), stop="<|im_end|>", specials=_CHATML),
        "qwen3_disable_thinking": lambda: Template(lambda *a: _chatml(*a, think=True), prefill="\n</think>\n\n", stop="<|im_end|>", specials=_CHATML),
        "qwen3_instruct": lambda: Template(lambda *a: _chatml(*a, think=False), stop="<|im_end|>", specials=_CHATML),
        "deepseekv3": lambda: Template(lambda *a: _deepseek(*a, system_as_user=False, close_thinking=False), _DEEP_BEGIN, stop=_DEEP_END, specials=tuple(_DEEP.values())),
        "deepseekv3_system_as_user": lambda: Template(lambda *a: _deepseek(*a, system_as_user=True, close_thinking=False), _DEEP_BEGIN, stop=_DEEP_END, specials=tuple(_DEEP.values())),
        "deepseekv3_disable_thinking": lambda: Template(lambda *a: _deepseek(*a, system_as_user=False, close_thinking=True), _DEEP_BEGIN, prefill="</think>", stop=_DEEP_END, specials=tuple(_DEEP.values())),
    }
    if name not in known:
        raise ValueError(f"unknown template: {name}")
    return known[name]()


def conversations(turns: DataFrame, key: str = "conv_id", text: str = "text") -> DataFrame:
    """(key, messages): long-form turns gathered in the order of turn."""
    m = F.struct("turn", "role", F.col(text).alias("content"))
    return turns.groupBy(key).agg(F.array_sort(F.collect_list(m)).alias("messages"))


def _fields(df: DataFrame, messages: str) -> set[str]:
    return set(df.schema[messages].dataType.elementType.names)


def pieces(df: DataFrame, name: str, train_on: str = "last_assistant_message", messages: str = "messages", **options) -> Column:
    """array<struct<text, w>>: the start, then each message's observed and action part with their weights."""
    if train_on not in TRAIN_ON:
        raise ValueError(f"unknown train_on: {train_on}")
    t, fields, all_of = template(name, **options), _fields(df, messages), F.col(messages)
    if (train_on == "customized") != ("trainable" in fields):
        raise ValueError("messages have a trainable field if, and only if, train_on is customized")

    def weight(m: Column, last: Column) -> Column:
        trained = {
            "last_assistant_message": lambda: last & (m["role"] == "assistant"),
            "all_assistant_messages": lambda: m["role"] == "assistant",
            "all_messages": lambda: F.lit(True),
            "all_tokens": lambda: F.lit(True),
            "all_user_and_system_messages": lambda: m["role"].isin("user", "system"),
            "customized": lambda: F.coalesce(m["trainable"], F.raise_error(F.lit("message without trainable")).cast("boolean")),
        }[train_on]()
        return trained.cast("int")

    def both(m: Column, i: Column) -> Column:
        last = i == F.size(all_of) - 1
        observed, action, tail = t.message(m, i, last, fields)
        return F.array(F.struct(observed.alias("text"), F.lit(int(train_on == "all_tokens")).alias("w")), F.struct(F.concat(action, F.when(last, tail).otherwise("")).alias("text"), weight(m, last).alias("w")))

    start = F.array(F.struct(F.lit(t.start).alias("text"), F.lit(0).alias("w")))
    return F.concat(start, F.flatten(F.transform(all_of, both)))


def rendered(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: p["text"]), "")


def generation_prompt(df: DataFrame, name: str, role: str = "assistant", prefill: str = "", messages: str = "messages", **options) -> Column:
    """The conversation without tails, then the header of a new message and the prefill."""
    t, fields, all_of = template(name, **options), _fields(df, messages), F.col(messages)
    no = F.lit(False)
    past = F.array_join(F.transform(all_of, lambda m, i: F.concat(*t.message(m, i, no, fields)[:2])), "")
    new = F.struct(F.lit(role).alias("role"), F.lit("").alias("content"))
    head = t.message(new, F.size(all_of), no, set())[0]
    return F.concat(F.lit(t.start), past, head, F.lit(t.prefill + prefill))


def byte_stats(parts: Column, max_length: int | None = None) -> Column:
    """struct<n_tokens, n_loss_tokens> after cutting to max_length and shifting by one, a byte being a token."""
    end = F.lit(max_length if max_length is not None else 2**31 - 1)
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("loss"))

    def add(s: Column, p: Column) -> Column:
        upto = s["at"] + F.octet_length(p["text"])
        own = F.greatest(F.least(upto, end) - F.greatest(s["at"], F.lit(1)), F.lit(0))
        return F.struct(upto.alias("at"), (s["loss"] + own * p["w"]).alias("loss"))

    s = F.aggregate(parts, start, add)
    return F.struct(F.greatest(F.least(s["at"], end) - 1, F.lit(0)).cast("long").alias("n_tokens"), s["loss"].cast("long").alias("n_loss_tokens"))


def byte_tokens(text: Column | str) -> Column:
    """UTF-8 bytes as token ids 0 to 255."""
    h = F.hex(F.encode(_col(text), "UTF-8"))
    each = F.filter(F.split(h, "(?<=\\G..)"), lambda x: x != "")
    return F.transform(each, lambda x: F.conv(x, 16, 10).cast("int"))


def byte_example(parts: Column) -> Column:
    """struct<tokens, weights>: parallel arrays, a byte being a token."""
    tokens = F.flatten(F.transform(parts, lambda p: byte_tokens(p["text"])))
    weights = F.flatten(F.transform(parts, lambda p: F.array_repeat(p["w"].cast("float"), F.octet_length(p["text"]))))
    return F.struct(tokens.alias("tokens"), weights.alias("weights"))


def parse_stop(tokens: Column | str, stop: int) -> Column:
    """struct<tokens, ok>: what stands before the stop token; not ok without one; two are an error."""
    tokens = _col(tokens)
    n = F.size(F.filter(tokens, lambda t: t == stop))
    before = F.slice(tokens, F.lit(1), F.array_position(tokens, F.lit(stop)).cast("int") - 1)
    content = F.when(n == 0, tokens).when(n == 1, before).otherwise(F.raise_error(F.lit("more than one stop token")).cast("array<int>"))
    return F.struct(content.alias("tokens"), (n == 1).alias("ok"))


def parse_stop_text(text: Column | str, stop: str) -> Column:
    """struct<content, ok> of a response as text, with the same rule."""
    text = _col(text)
    parts = F.split(text, F.regexp_replace(F.lit(stop), r"([\\|<>\[\](){}.*+?^$])", r"\\$1"), -1)
    content = F.when(F.size(parts) <= 2, F.element_at(parts, 1)).otherwise(F.raise_error(F.lit("more than one stop token")).cast("string"))
    if stop == "\n\nUser:":
        content = strip(content)
    return F.struct(content.alias("content"), (F.size(parts) == 2).alias("ok"))


def weight_runs(weights: Column | str) -> Column:
    """array<struct<start, length, w>>: stretches of equal weight sign."""
    weights = _col(weights)
    sign = F.transform(weights, lambda w: F.signum(w.cast("double")).cast("int"))
    starts = F.filter(F.transform(sign, lambda s, i: F.when((i == 0) | (s != F.try_element_at(sign, i)), i)), lambda i: i.isNotNull())
    return F.transform(starts, lambda a, k: F.struct(a.alias("start"), (F.coalesce(F.try_element_at(starts, k + 2), F.size(weights)) - a).alias("length"), F.element_at(sign, a + 1).alias("w")))


#: Terminal colours of weight signs: trained, not trained, negative. Fixed values.
COLOURS = {1: "\x1b[32m", 0: "\x1b[33m", -1: "\x1b[31m"}
RESET = "\x1b[0m"


def coloured(parts: Column) -> Column:
    """The text of ``pieces`` with each stretch of equal weight in its colour."""
    colour = lambda w: F.when(w > 0, COLOURS[1]).when(w < 0, COLOURS[-1]).otherwise(COLOURS[0])
    return F.array_join(F.transform(F.filter(parts, lambda p: p["text"] != ""), lambda p: F.concat(colour(p["w"]), p["text"], F.lit(RESET))), "")


def previewed(df: DataFrame, name: str, key: str, train_on: str = "last_assistant_message", rows: int = 100) -> DataFrame:
    """(key, preview): the first rows by key, rendered in colour."""
    return df.orderBy(key).limit(rows).select(key, coloured(pieces(df, name, train_on)).alias("preview"))


def counters(examples: DataFrame) -> DataFrame:
    """num_sequences, num_tokens and num_loss_tokens of a batch of ``byte_stats`` (n_tokens, n_loss_tokens)."""
    return examples.agg(F.count("*").alias("num_sequences"), F.sum("n_tokens").alias("num_tokens"), F.sum("n_loss_tokens").alias("num_loss_tokens"))
