import math

import pytest
from pyspark.sql import functions as F

from millrace.functions import arrays, grade, numbers, text


def one(spark, *columns):
    row = spark.range(1).select(*columns).first()
    return row[0] if len(columns) == 1 else tuple(row)


@pytest.mark.parametrize(
    ("said", "content"),
    [(r"\boxed{1} \boxed{2}", "2"), (r"\boxed{a \boxed{b}}", r"a \boxed{b}"), (r"\boxed 7", "7"), (r"} \boxed{1}", None), ("x", None), (r"\boxed{1} }", None), ("", None), (None, None)],
)
def test_boxed(spark, said, content):
    assert one(spark, grade.extract_boxed(F.lit(said).cast("string"))) == content


@pytest.mark.parametrize(("given", "form"), [("0.5", r"\frac{1}{2}"), ("1/2", r"\frac{1}{2}"), ("x=5", "5"), (r"\sqrt3", r"\sqrt{3}"), (r"\frac12", r"\frac{1}{2}"), (r"\text{yes}", "yes"), (r"\frac1{72}", r"\frac{1}{72}"), (r"\frac", r"\frac"), (r"5\text{ cm}", "5"), (".5", r"\frac{1}{2}"), (r"\dfrac34", r"\frac{3}{4}"), ("", ""), ("a/b", "a/b"), ("01/2", "01/2")])
def test_competition_form(given, form):
    assert grade.competition_form(given) == form


@pytest.mark.parametrize(
    ("given", "truth", "right"),
    [("1,000", "1000", True), (r"50\%", "50", True), ("2+2", "4", False), ("x+1", "1+x", False), ("(1,2)", "(1, 2)", True), ("[1,2)", "(1,2)", False), ("5 cm", "5", True), ("3.0", "3", True), (None, "1", False), ("", "1", False), ("2/4", "1/2", False), ("Yes", "yes", True), ("(1/2,3/4)", "(1/2, 3/4)", True)],
)
def test_grade(given, truth, right):
    assert grade.grade(given, truth) is right


def test_text(spark):
    lit = F.lit
    assert one(spark, text.strip(lit("\n  a\t\n"))) == "a"
    assert one(spark, text.capitalize(lit("uSER"))) == "User"
    assert [one(spark, text.gsm8k_answer(lit(s))) for s in ("x\n#### 1,234", "#### : 5", "x", "a #### 1,2")] == ["1234", "5", None, "1,2"]
    assert [one(spark, text.summary_after_thinking(lit(s))) for s in ("t</think> s ", "t</think>", "t")] == ["s", None, None]
    assert one(spark, text.summary_after_thinking(lit("t"), True)) == "t"
    assert [one(spark, text.single_answer(lit(s))) for s in ("a Answer: b", "Answer: a Answer: b", "b")] == ["b", None, None]
    assert one(spark, text.normalize_qa(lit("The  Eiffel-Tower!"))) == "eiffeltower"
    assert one(spark, text.between_marks(lit("</f> <f>x"), "<f>", "</f>")) == ""
    assert one(spark, text.first_integer(lit(" 12 apples"))) == 12 and one(spark, text.first_integer(lit("no"))) is None
    assert [one(spark, text.guess_feedback(lit(s), lit(5))) for s in ("Guess: 5", "Guess: 3", "Guess: 9", "guess: 5", "Guess: five")] == ["Correct", "Too low", "Too high", None, None]
    turns = one(spark, text.human_assistant_turns(lit("Human: hi Assistant: yo")))
    assert [(t.role, t.content) for t in turns] == [("user", "hi"), ("assistant", "yo")]
    assert one(spark, text.human_assistant_turns(lit("lead Human: hi"))) == []
    assert one(spark, text.fill("{a} and {b}", a=lit("{b}"), b=lit("x"))) == "{b} and x"
    long = "a" * 300
    assert one(spark, text.preview(lit(long))) == "a" * 100 + "..." + "a" * 50
    assert one(spark, text.last_code_block(lit("none"))) is None


def test_tool_call(spark):
    call = lambda s: one(spark, text.tool_call(F.lit(f"x <tool_call>{s}</tool_call>")))
    good = call('{"name": "find", "args": {"q": 1}, "id": "7"}')
    assert (good.ok, good.name, good.args, good.id) == (True, "find", '{"q":1}', "7")
    assert [call(s).ok for s in ('{"name": 1, "args": {}}', '{"name": "x", "args": []}', "not json", '"x"')] == [False] * 4


def test_arrays(spark):
    a = lambda *x: F.array(*[F.lit(v) for v in x])
    empty = F.array().cast("array<int>")
    assert one(spark, arrays.is_prefix(a(1, 2), a(1, 2, 3))) and not one(spark, arrays.is_prefix(a(2), a(1, 2))) and one(spark, arrays.is_prefix(empty, a(1)))
    assert one(spark, arrays.discounted(a(1.0, 0.0, 2.0), 0.5)) == [1.5, 1.0, 2.0]
    assert one(spark, arrays.cut_after_first_one(a(5, 6, 7), a(0, 1, 1))) == [5, 6] and one(spark, arrays.cut_after_first_one(a(5), a(0))) is None
    assert one(spark, arrays.scattered(a(-1.0, -2.0), a(0.0, 1.0, 1.0))) == [0.0, -1.0, -2.0]
    assert one(spark, arrays.scattered(a(-1.0), a(0.0, 1.0, 1.0))) == [0.0, 0.0, 0.0]
    assert one(spark, arrays.whole_sequence(a(1, 2), a(2, 3))) == [1, 2, 3]
    assert one(spark, arrays.inputs(empty)) == [] and one(spark, arrays.targets(a(1))) == []
    assert one(spark, arrays.padded(F.lit(2), a(1.0))) == [0.0, 0.0, 1.0]


def test_numbers(spark):
    assert [round(one(spark, numbers.pass_at_k(F.lit(4), F.lit(c), 2)), 6) for c in range(5)] == [0, 0.5, 0.833333, 1, 1]
    assert one(spark, numbers.pass_at_k(F.lit(1), F.lit(1), 2)) is None
    assert one(spark, numbers.neg_log_sigmoid(F.lit(-800.0))) == 800.0
    assert [one(spark, numbers.preference_value(F.lit(s))) for s in (" A", "B", "Tie")] == [-1.0, 1.0, 0.0]
    assert one(spark, numbers.edge(F.lit(11), F.lit(30), 22)) == 14
    assert math.isclose(one(spark, numbers.shaped_reward(F.lit(True), F.lit(False))), 0.9)
    with pytest.raises(ValueError):
        numbers.learning_rate(F.lit(1), F.lit(2), "cosine")
