import pytest

from millrace.functions import grade
from millrace.functions.algebra import expressions_equal, parsed, same_expression

SAME = [
    ("2+2", "4"), ("x+1", "1+x"), ("2x", "x+x"), ("x^2-1", "(x-1)(x+1)"), ("\\frac{1}{2}", "0.5"), ("\\frac12", "1/2"), ("\\dfrac{3}{6}", "\\tfrac{1}{2}"), ("1,000", "1000"), ("50\\%", "0.5"), ("\\sqrt{12}", "2\\sqrt{3}"),
    ("\\frac{1}{\\sqrt{2}}", "\\frac{\\sqrt{2}}{2}"), ("\\sqrt{2}\\sqrt{3}", "\\sqrt{6}"), ("\\sqrt{\\frac{1}{4}}", "\\frac{1}{2}"), ("(a+b)^2", "a^2+2ab+b^2"), ("2^{10}", "1024"), ("x^{-1}", "\\frac{1}{x}"), ("-3", "-(3)"), ("\\pi r^2", "r^2\\pi"),
    ("3\\cdot 4", "12"), ("6\\div 4", "1.5"), ("1\\frac{1}{2}", "\\frac{3}{2}"), ("-1\\frac12", "-1.5"), ("\\left(x+y\\right)z", "xz+yz"), ("\\frac{x^2-1}{x-1}", "x+1"), ("x**2", "x^2"), ("2\\times 10^3", "2000"), ("90^\\circ", "90^{\\circ}"), ("9^{1/2}", "3"),
    ("x_1+x_2", "x_2+x_1"), ("\\sin x", "\\sin(x)"), ("(1+\\sqrt{5})(1-\\sqrt{5})", "-4"), ("\\frac{2}{4}x", "x/2"), ("0.25", ".25"), ("5.", "5"), ("\\$7", "7"), ("2a b", "2ba"), ("\\frac{a}{b}+\\frac{c}{d}", "\\frac{ad+bc}{bd}"), ("[1+2]3", "9"),
]
OTHER = [
    ("x+1", "x+2"), ("1/2", "1/3"), ("x^2", "x"), ("\\sqrt{2}", "1.414"), ("ab", "a+b"), ("2+2", "5"), ("-x", "x"), ("x-y", "y-x"), ("\\pi", "3.14"), ("x_1", "x_2"), ("\\sin x", "\\cos x"), ("(1,2)", "(1,2)"), ("", ""), ("1/0", "1/0"), ("x+", "x+"), ("(x", "x"), ("2^x", "x^2"), ("\\text{yes}+", "\\text{yes}+"), ("x=1", "x=1"), ("\\sqrt{x}", "x"),
    ("10^{100}", "10^{101}"), ("x^{99}", "x^{98}"),
]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same(a, b):
    assert same_expression(a, b) and same_expression(b, a)


@pytest.mark.parametrize(("a", "b"), OTHER)
def test_different_or_not_understood(a, b):
    assert not same_expression(a, b)


def test_long_expressions_end():
    assert parsed("(" * 5000) is None
    assert not same_expression("(a+b+c+d+e+f)^{60}", "1")
    assert same_expression("+".join(["x"] * 3000), "3000x")


def test_flag_of_the_grader(spark):
    rows = spark.createDataFrame([("x+1", "1+x"), ("2+2", "4"), ("\\frac{2}{4}", "\\frac{1}{2}"), ("(1, 1+1)", "(1,2)"), ("(1,2)", "[1,2]"), (None, "1"), ("3", None), ("4", "5")], "given string, truth string")
    out = rows.select(grade.grade_answer("given", "truth").alias("gated"), grade.grade_answer_by_algebra("given", "truth").alias("algebra")).collect()
    assert [r.gated for r in out] == [False] * 8
    assert [r.algebra for r in out] == [True, True, True, True, False, False, False, False]
    assert [r.x for r in rows.select(expressions_equal("given", "truth").alias("x")).collect()] == [True, True, True, False, False, False, False, False]
