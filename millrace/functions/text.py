"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII punctuation that answer normalisation drops. Fixed value.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Without leading and trailing white space of any script, which trim() would leave."""
    return F.regexp_replace(_col(x), r"^(?U:\s|[\x1c-\x1f])+|(?U:\s|[\x1c-\x1f])+$", "")


def capitalize(x: Column | str) -> Column:
    """First character in upper case, the rest in lower case."""
    x = _col(x)
    return F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 2147483647)))


def after(x: Column | str, mark: str) -> Column:
    """What follows the first ``mark``; null if there is none."""
    x = _col(x)
    at = F.locate(mark, x)
    return F.when(at > 0, F.substring(x, at + len(mark), F.length(x)))


def gsm8k_answer(x: Column | str) -> Column:
    """The answer on the last line that begins with ####, commas dropped; else the rest after the last such mark; else null."""
    x = _col(x)
    lines = F.transform(F.split(x, r"\r\n|[\n\r]"), strip)
    marked = F.filter(lines, lambda s: s.startswith("####"))
    last = strip(F.substring(F.try_element_at(marked, F.lit(-1)), 5, 2147483647))
    own = F.replace(F.when(last.startswith(":"), strip(F.substring(last, 2, 2147483647))).otherwise(last), F.lit(","), F.lit(""))
    loose = strip(F.try_element_at(F.regexp_extract_all(x, F.lit(r"####\s*(.+)"), F.lit(1)), F.lit(-1)))
    return F.coalesce(F.when(F.size(marked) > 0, strip(own)), loose)


def summary_after_thinking(x: Column | str, whole_if_none: bool = False) -> Column:
    """Text after the first </think>, stripped; null if it is empty. Without the mark: null, or the whole text."""
    x = _col(x)
    rest = F.nullif(strip(after(x, "</think>")), F.lit(""))
    return F.when(x.contains("</think>"), rest).otherwise(x if whole_if_none else F.lit(None))


def between_marks(x: Column | str, start: str, end: str) -> Column:
    """Text between the first start and end marks; the whole text without a start, the rest without an end, '' if the end comes first."""
    x = _col(x)
    a, b = F.locate(start, x), F.locate(end, x)
    begin = a + len(start)
    return F.when(a == 0, x).when(b == 0, F.substring(x, begin, F.length(x))).when(b < begin, F.lit("")).otherwise(F.substring(x, begin, b - begin))


def final_answer_word(x: Column | str) -> Column:
    """The word after 'Final Answer: ', or null."""
    return F.nullif(F.regexp_extract(_col(x), r"(?U)Final Answer: (\w+)", 1), F.lit(""))


def single_answer(x: Column | str, mark: str = "Answer:") -> Column:
    """Text after the mark if the text has it exactly once, stripped; else null."""
    parts = F.split(_col(x), F.lit(mark), -1)
    return F.when(F.size(parts) == 2, strip(F.element_at(parts, 2)))


def normalize_qa(x: Column | str) -> Column:
    """Lower case without ASCII punctuation and articles, white space collapsed."""
    bare = F.translate(F.lower(_col(x)), PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " "), r"(?U)\s+", " "))


def matches_any(x: Column | str, gold: Column | str) -> Column:
    """Whether the normalised text equals a normalised gold answer; false without any."""
    own = normalize_qa(x)
    return F.coalesce(F.exists(_col(gold), lambda g: normalize_qa(g) == own), F.lit(False))


def contains_answer(x: Column | str, answer: Column | str) -> Column:
    """Whether the text contains the answer, ignoring case."""
    return F.contains(F.lower(_col(x)), F.lower(_col(answer)))


def last_code_block(x: Column | str) -> Column:
    """The last fenced code block, stripped; null if there is none."""
    return strip(F.try_element_at(F.regexp_extract_all(_col(x), F.lit(r"(?s)```(?:(?U:\w)+)?\n(.*?)```"), F.lit(1)), F.lit(-1)))


def guess(x: Column | str) -> Column:
    """What follows 'Guess: ' at the start, up to the line's end; null otherwise."""
    return F.when(_col(x).startswith("Guess: "), F.regexp_extract(_col(x), r"^Guess: ([^\n]*)", 1))


def guess_number(x: Column | str) -> Column:
    return strip(guess(x)).try_cast("bigint")


def guess_feedback(x: Column | str, gold: Column | str) -> Column:
    """Correct, Too low or Too high; null where no number was guessed."""
    n, gold = guess_number(x), _col(gold)
    return F.when(n == gold, "Correct").when(n < gold, "Too low").when(n > gold, "Too high")


def first_integer(x: Column | str) -> Column:
    """The first white-space separated token as a number, or null."""
    return F.try_element_at(F.split(strip(x), r"(?U)\s+"), F.lit(1)).try_cast("bigint")


def stdout_equal(lines: Column | str, expected: Column | str) -> Column:
    return strip(F.array_join(_col(lines), "\n")) == strip(expected)


def preview(x: Column | str, limit: int = 200, head: int = 100, tail: int = 50) -> Column:
    """A long text as its head and tail."""
    x = _col(x)
    return F.when(F.length(x) > limit, F.concat(F.left(x, F.lit(head)), F.lit("..."), F.right(x, F.lit(tail)))).otherwise(x)


def human_assistant_turns(x: Column | str) -> Column:
    """Messages of a text whose turns begin with 'Human:' or 'Assistant:'; none if other text comes first."""
    x = _col(x)
    part = r"(?s)(Human:|Assistant:)(.*?)(?=Human:|Assistant:|\z)"
    roles, texts = (F.regexp_extract_all(x, F.lit(part), F.lit(k)) for k in (1, 2))
    turns = F.zip_with(roles, texts, lambda r, t: F.struct(F.when(r == "Human:", "user").otherwise("assistant").alias("role"), strip(t).alias("content")))
    lead = strip(F.regexp_extract(x, r"(?s)^(.*?)(?:Human:|Assistant:|\z)", 1))
    return F.when(lead == "", turns).otherwise(F.slice(turns, 1, 0))


def fill(template: str, **values: Column | str) -> Column:
    """A template with {name} fields; braces in values are not expanded again."""
    parts, at = [], 0
    while (a := template.find("{", at)) >= 0:
        b = template.index("}", a)
        parts += [F.lit(template[at:a]), _col(values[template[a + 1 : b]])]
        at = b + 1
    return F.concat(*parts, F.lit(template[at:]))


# The coding prompt's wording.
CODE_SYSTEM = "You are an expert Python programmer. You will be given a question (problem specification) and will generate a correct Python program that matches the specification and passes all tests."
CODE_WITH_STARTER = "You will use the following starter code to write the solution to the problem and enclose your code within delimiters."
CODE_WITHOUT_STARTER = "Read the inputs from stdin solve the problem and write the answer to stdout (do not directly test on the sample inputs). Enclose your code within delimiters as follows. Ensure that when the python program runs, it reads the inputs, runs the algorithm and writes output to STDOUT."
CODE_EMPTY = "# YOUR CODE HERE"
CODE_ANSWER = "### Answer: (use the provided format with backticks)\n\n"


def code_prompt(question: Column | str, starter: Column | str) -> Column:
    """A coding question as a prompt, with its starter code if that isn't blank."""
    code = F.coalesce(_col(starter), F.lit(""))
    given = strip(code) != ""
    say = F.when(given, CODE_WITH_STARTER).otherwise(CODE_WITHOUT_STARTER)
    return F.concat(F.lit(CODE_SYSTEM + "\n\n"), _col(question), F.lit("### Format: "), say, F.lit("\n```python\n"), F.when(given, code).otherwise(CODE_EMPTY), F.lit("\n```\n\n" + CODE_ANSWER))


def first_filled(*columns: Column | str) -> Column:
    """The first column that isn't null or blank."""
    return F.coalesce(*[F.when(strip(c) != "", _col(c)) for c in columns])


def tool_call(x: Column | str) -> Column:
    """The first <tool_call> as struct(name, args, id); null fields where it is not a call. ok tells a sound one."""
    body = F.regexp_extract(_col(x), r"(?s)<tool_call>(.*?)</tool_call>", 1)
    v = F.try_parse_json(body)
    name, call_id = F.try_variant_get(v, "$.name", "string"), F.try_variant_get(v, "$.id", "string")
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    ok = F.coalesce((kind("$.name") == "STRING") & kind("$.args").startswith("OBJECT"), F.lit(False))
    args = F.to_json(F.try_variant_get(v, "$.args", "variant"))
    return F.struct(ok.alias("ok"), F.when(ok, name).alias("name"), F.when(ok, args).alias("args"), F.when(ok & (kind("$.id") == "STRING"), call_id).alias("id"))


def inspect_messages(messages: Column | str) -> Column:
    """array<struct<role, content>> with stripped content, as an evaluation library takes them; a message without content is an error."""
    missing = F.raise_error(F.lit("message content must be text")).cast("string")
    return F.transform(_col(messages), lambda m: F.struct(m["role"].alias("role"), strip(F.coalesce(m["content"], missing)).alias("content")))


#: Separators at which a common prefix may end, in the order they are looked for; and what long words of paths become. Fixed values.
BOUNDARIES = ("/", "_", "-")
ABBREVIATIONS = {"learning_rate": "lr", "batch_size": "bs", "num_epochs": "ep", "model": "m", "experiment": "exp", "checkpoint": "ckpt", "validation": "val", "training": "train"}


def boundary_prefix(least: Column | str, greatest: Column | str) -> Column:
    """Longest common prefix of two texts that ends at a boundary; of many texts, give the least and the greatest."""
    a, b = _col(least), _col(greatest)
    # the first place where they differ, looked up once for all places
    differ = F.filter(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))
    whole = F.left(a, F.coalesce(F.try_element_at(differ, F.lit(1)) - 1, F.length(a)))
    ends = whole == ""
    for sep in BOUNDARIES:
        ends = ends | whole.endswith(sep)
    cut = F.lit("")
    for sep in reversed(BOUNDARIES):
        last = F.length(whole) - F.locate(sep, F.reverse(whole)) + 1
        cut = F.when(whole.contains(sep), F.left(whole, last)).otherwise(cut)
    return F.when(ends, whole).otherwise(cut)


def abbreviated_path(x: Column | str, most: int = 20) -> Column:
    """A path with shorter words; if it is still longer than ``most``, with its folders shortened, then cut at the front."""
    path = _col(x)
    for long, short in ABBREVIATIONS.items():
        path = F.replace(path, F.lit(long), F.lit(short))
    parts = F.split(path, "/")
    initials = lambda p, sep: F.array_join(F.transform(F.split(p, sep), lambda w: F.left(w, F.lit(1))), "")
    short = lambda p: F.when(F.length(p) <= 3, p).when(p.contains("_"), initials(p, "_")).when(p.contains("-"), initials(p, "-")).otherwise(F.left(p, F.lit(3)))
    folders = F.concat(F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), short), F.slice(parts, F.lit(-1), F.lit(1)))
    fitted = F.when((F.length(path) > most) & (F.size(parts) > 1), F.array_join(folders, "/")).otherwise(path)
    return F.when(F.length(fitted) > most, F.concat(F.lit("..."), F.right(fitted, F.lit(most - 3)))).otherwise(fitted)
