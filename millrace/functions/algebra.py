"""Whether two answers are the same expression: sums, products, quotients, powers and roots over exact fractions.

An expression becomes a quotient of polynomials in its symbols; two are equal if their cross products are. What isn't understood is equal to nothing.
"""

from __future__ import annotations

import re
from fractions import Fraction

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

#: Larger powers and longer polynomials are not worked out.
MOST_POWER, MOST_TERMS, MOST_ROOT = 64, 400, 10**12

Monomial = tuple[tuple[str, int], ...]
Polynomial = dict[Monomial, Fraction]
Quotient = tuple[Polynomial, Polynomial]

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*|\.\d+)|\\(left|right|,|;|!|:|quad|displaystyle|limits)(?![a-z])|(\\[A-Za-z]+|\\%)|([A-Za-z])|(\*\*|.))", re.S)
_GROUPED = re.compile(r"(?<![\d.])\d{1,3}(?:\{?,\}?\\?!?\d{3})+(?![\d])")
#: Commands that stand for an operator, and functions whose value is a symbol of its own. Fixed values.
_OPERATORS = {"\\cdot": "*", "\\times": "*", "\\div": "/", "**": "^", "\\lbrace": "(", "\\rbrace": ")", "{": "(", "}": ")", "[": "(", "]": ")"}
_FUNCTIONS = ("\\sin", "\\cos", "\\tan", "\\cot", "\\sec", "\\csc", "\\log", "\\ln", "\\exp", "\\arcsin", "\\arccos", "\\arctan")
_ONE: Polynomial = {(): Fraction(1)}


class NotUnderstood(ValueError):
    """The text is no expression of the kind that is compared here."""


def _times(a: Polynomial, b: Polynomial) -> Polynomial:
    if len(a) * len(b) > MOST_TERMS**2:
        raise NotUnderstood("too many terms")
    out: Polynomial = {}
    for x, p in a.items():
        for y, q in b.items():
            powers: dict[str, int] = dict(x)
            for atom, n in y:
                powers[atom] = powers.get(atom, 0) + n
            value = p * q
            for atom in [k for k in powers if k.startswith("root ") and powers[k] > 1]:  # a root's square is its number
                value *= int(atom[5:]) ** (powers[atom] // 2)
                powers[atom] %= 2
            key = tuple(sorted((k, n) for k, n in powers.items() if n))
            out[key] = out.get(key, Fraction(0)) + value
    return {k: v for k, v in out.items() if v}


def _plus(a: Polynomial, b: Polynomial) -> Polynomial:
    out = dict(a)
    for k, v in b.items():
        out[k] = out.get(k, Fraction(0)) + v
    return {k: v for k, v in out.items() if v}


def _sum(a: Quotient, b: Quotient) -> Quotient:
    return _plus(_times(a[0], b[1]), _times(b[0], a[1])), _times(a[1], b[1])


def _product(a: Quotient, b: Quotient) -> Quotient:
    return _times(a[0], b[0]), _times(a[1], b[1])


def _inverse(a: Quotient) -> Quotient:
    if not a[0]:
        raise NotUnderstood("division by zero")
    return a[1], a[0]


def _number(a: Quotient) -> Fraction | None:
    if set(a[0]) <= {()} and set(a[1]) == {()}:
        return a[0].get((), Fraction(0)) / a[1][()]
    return None


def _constant(v: Fraction | int) -> Quotient:
    return ({(): Fraction(v)} if v else {}), _ONE


def _symbol(name: str) -> Quotient:
    return {((name, 1),): Fraction(1)}, _ONE


def _text(a: Quotient) -> str:
    """A name for an expression: equal for equal polynomials; of a quotient, for equal numerators and denominators."""
    part = lambda p: "+".join(f"{v}*{k}" for k, v in sorted(p.items()))
    lead = a[1][max(a[1])]
    scaled = [{k: v / lead for k, v in p.items()} for p in a]
    return f"{part(scaled[0])}/{part(scaled[1])}"


def _root(a: Quotient) -> Quotient:
    """The square root: of a number, a rational part times roots of different primes; of anything else, a symbol."""
    v = _number(a)
    if v is None or v < 0 or v.numerator * v.denominator > MOST_ROOT:
        return _symbol(f"sqrt({_text(a)})")
    n, out, d = v.numerator * v.denominator, Fraction(1, v.denominator), 2
    atoms: list[str] = []
    while n > 1 and d * d <= n:
        while n % (d * d) == 0:
            n, out = n // (d * d), out * d
        if n % d == 0:
            n, atoms = n // d, [*atoms, f"root {d}"]
        d += 1
    atoms += [f"root {n}"] if n > 1 else []
    return ({tuple(sorted((k, 1) for k in atoms)): out} if v else {}), _ONE


def _power(a: Quotient, b: Quotient) -> Quotient:
    n = _number(b)
    if n is not None and n.denominator == 1 and abs(n) <= MOST_POWER:
        out, base = _constant(1), a if n >= 0 else _inverse(a)
        for _ in range(abs(int(n))):
            out = _product(out, base)
        return out
    if n is not None and n.denominator == 2 and abs(n) <= MOST_POWER:
        return _power(_root(a), _constant(n.numerator))
    return _symbol(f"({_text(a)})^({_text(b)})")


class _Parser:
    """Precedence: sums, products (a factor may follow without a sign), signs, powers."""

    def __init__(self, text: str):
        text = _GROUPED.sub(lambda m: re.sub(r"[^\d]", "", m[0]), text.replace("\\dfrac", "\\frac").replace("\\tfrac", "\\frac").replace("\\$", "").replace("$", ""))
        self.tokens: list[str] = []
        for m in _TOKEN.finditer(text.strip()):
            number, skipped, command, letter, other = m.groups()
            token = number or command or letter or other
            if skipped or not token or not token.strip():
                continue
            self.tokens.append(_OPERATORS.get(token, token))
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self, *wanted: str) -> str | None:
        if self.peek() is not None and (not wanted or self.peek() in wanted):
            self.at += 1
            return self.tokens[self.at - 1]
        return None

    def whole(self) -> Quotient:
        if not self.tokens:
            raise NotUnderstood("nothing")
        out = self.total()
        if self.peek() is not None:
            raise NotUnderstood(f"left over: {self.peek()}")
        return out

    def total(self) -> Quotient:
        out = self.product()
        while sign := self.take("+", "-"):
            right = self.product()
            out = _sum(out, right if sign == "+" else _product(_constant(-1), right))
        return out

    def product(self) -> Quotient:
        out = self.signed()
        while True:
            if sign := self.take("*", "/"):
                right = self.signed()
                out = _product(out, right if sign == "*" else _inverse(right))
            elif (seen := self.peek()) is not None and (seen == "(" or seen[0].isalnum() or seen[0] == "\\" and len(seen) > 2):
                # a number right before a fraction of numbers is mixed: 1 \frac{1}{2}
                whole = _number(out)
                mixed = seen == "\\frac" and self.tokens[self.at - 1][0].isdigit() and whole is not None
                right = self.power()
                part = _number(right)
                out = _sum(out, right if whole >= 0 else _product(_constant(-1), right)) if mixed and part is not None and 0 < part < 1 else _product(out, right)
            else:
                return out

    def signed(self) -> Quotient:
        if sign := self.take("+", "-"):
            inner = self.signed()
            return inner if sign == "+" else _product(_constant(-1), inner)
        return self.power()

    def power(self) -> Quotient:
        out = self.atom()
        while self.take("\\%", "%"):
            out = _product(out, _constant(Fraction(1, 100)))
        if self.take("^"):
            if self.take("\\circ") or (self.peek() == "(" and self.tokens[self.at + 1 : self.at + 3] == ["\\circ", ")"]):
                if self.peek() == "(":
                    self.at += 3
                return _product(out, _symbol("degree"))
            out = _power(out, self.argument() if self.peek() not in ("+", "-") else self.signed())
        return out

    def argument(self) -> Quotient:
        """What a command or a power applies to: a group, or one digit or letter."""
        token = self.peek()
        if token is not None and token[0].isdigit() and len(token) > 1 and self.at and self.tokens[self.at - 1] in ("\\frac", "\\sqrt", "^"):
            self.tokens[self.at : self.at + 1] = [token[0], token[1:]]
        return self.atom()

    def atom(self) -> Quotient:
        token = self.take()
        if token is None:
            raise NotUnderstood("it breaks off")
        if token == "(":
            out = self.total()
            if not self.take(")"):
                raise NotUnderstood("a bracket stays open")
            return out
        if token[0].isdigit() or token[0] == ".":
            return _constant(Fraction(token.rstrip(".")))
        if token == "\\frac":
            top = self.argument()
            if (under := self.peek()) is not None and under[0].isdigit() and len(under) > 1:
                self.tokens[self.at : self.at + 1] = [under[0], under[1:]]
            return _product(top, _inverse(self.atom()))
        if token == "\\sqrt":
            return _root(self.argument())
        if token in _FUNCTIONS:
            return _symbol(f"{token}({_text(self.power())})")
        if token.isalpha() or token[0] == "\\" and token[1:].isalpha():
            name = token
            if self.take("_"):
                name += f"_{_text(self.atom())}"
            return _symbol(name)
        raise NotUnderstood(f"unexpected: {token}")


def parsed(text: str) -> Quotient | None:
    """An expression as a quotient of polynomials; None if it isn't understood."""
    try:
        return _Parser(text).whole()
    except (NotUnderstood, RecursionError):
        return None


def same_expression(a: str | None, b: str | None) -> bool:
    """Whether two texts are the same expression. A text that isn't understood is the same as none; so is null."""
    if a is None or b is None:
        return False
    x, y = parsed(a), parsed(b)
    if x is None or y is None:
        return False
    try:
        return _times(x[0], y[1]) == _times(y[0], x[1])
    except NotUnderstood:
        return False


def _same_all(a: pd.Series, b: pd.Series) -> pd.Series:
    pairs = list(zip(a, b, strict=True))
    known = {p: same_expression(*p) for p in set(pairs)}
    return pd.Series([known[p] for p in pairs], dtype=bool)


#: Whether two columns hold the same expression; every different pair of a batch is worked out once.
expressions_equal = F.pandas_udf(_same_all, BooleanType())
