"""Equality of formulas without a computer algebra system: LaTeX or plain arithmetic, compared at sample points.

An expression is parsed once into a tree and evaluated; closed ones are compared as numbers, others at fixed points for
their letters. Parsing is linear in the length and evaluation in the size of the tree, so no call runs away.
"""

from __future__ import annotations

import cmath
import math
import re
from collections.abc import Callable

_TOKEN = re.compile(r"\s*(?:(\d+(?:\.\d*)?|\.\d+)|(\\[a-zA-Z]+|\\.)|([a-zA-Z]+)|(\*\*|.))", re.S)
_NAMES: dict[str, complex] = {"pi": math.pi, "infty": math.inf}
_CALLS: dict[str, Callable] = {
    "sqrt": cmath.sqrt, "sin": cmath.sin, "cos": cmath.cos, "tan": cmath.tan, "exp": cmath.exp, "ln": cmath.log,
    "log": cmath.log, "arcsin": cmath.asin, "arccos": cmath.acos, "arctan": cmath.atan, "abs": abs,
}
_IGNORED = {"\\left", "\\right", "\\,", "\\!", "\\;", "$"}
_BRACKETS = {"(": ")", "[": "]", "{": "}"}
#: Expressions beyond this depth of brackets are not formulas but accidents.
DEEPEST = 60
_POINTS = (0.7316, 1.3791, 2.2173)


class _Parser:
    def __init__(self, text: str):
        self.tokens = [t for m in _TOKEN.finditer(text) if (t := next(filter(None, m.groups()), "").strip()) and t not in _IGNORED]
        self.at, self.depth = 0, 0
        self.letters: set[str] = set()

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, want: str | None = None) -> str:
        t = self.peek()
        if not t or (want is not None and t != want):
            raise ValueError(f"{want} expected")
        self.at += 1
        return t

    def whole(self) -> tuple:
        tree = self.total()
        if self.peek():
            raise ValueError("rest")
        return tree

    def total(self) -> tuple:
        self.depth += 1
        if self.depth > DEEPEST:
            raise ValueError("too deep")
        sign = self.take() if self.peek() in ("+", "-") else "+"
        tree = self.product()
        tree = ("neg", tree) if sign == "-" else tree
        while self.peek() in ("+", "-"):
            tree = (self.take(), tree, self.product())
        self.depth -= 1
        return tree

    def product(self) -> tuple:
        tree = self.power()
        while True:
            t = self.peek()
            if t in ("*", "\\cdot", "\\times"):
                self.take()
                tree = ("*", tree, self.signed())
            elif t in ("/", "\\div"):
                self.take()
                tree = ("/", tree, self.signed())
            elif t and (t[0].isalnum() or t in _BRACKETS or (t[0] == "\\" and len(t) > 1)) and t not in ("]", ")", "}"):
                tree = ("*", tree, self.power())
            else:
                return tree

    def signed(self) -> tuple:
        if self.peek() in ("+", "-"):
            return ("neg", self.signed()) if self.take() == "-" else self.signed()
        return self.power()

    def power(self) -> tuple:
        base = self.atom()
        while self.peek() in ("^", "**"):
            self.take()
            base = ("^", base, self.signed())
        return ("/", base, ("num", 100.0)) if self.peek() in ("%", "\\%") and self.take() else base

    def group(self) -> tuple:
        if self.peek() in _BRACKETS:
            closing = _BRACKETS[self.take()]
            tree = self.total()
            self.take(closing)
            return tree
        t = self.peek()
        # \frac12 takes a digit for each part
        if t and t[0].isdigit() and len(t) > 1:
            self.tokens[self.at] = t[1:]
            return ("num", float(t[0]))
        return self.atom()

    def atom(self) -> tuple:
        t = self.take()
        if t[0].isdigit() or (t[0] == "." and len(t) > 1):
            return ("num", float(t))
        if t in _BRACKETS:
            self.at -= 1
            return self.group()
        name = t.lstrip("\\")
        if name in ("frac", "dfrac", "tfrac", "cfrac"):
            return ("/", self.group(), self.group())
        if name in _CALLS:
            root = None
            if name == "sqrt" and self.peek() == "[":
                root = self.group()
            arg = self.group()
            return ("^", arg, ("/", ("num", 1.0), root)) if root else ("call", name, arg)
        if name in _NAMES:
            return ("num", _NAMES[name])
        if t[0] == "\\":
            raise ValueError(t)
        if name.isalpha():
            # letters side by side are a product
            self.letters.update(name)
            tree = ("var", name[0])
            for c in name[1:]:
                tree = ("*", tree, ("var", c))
            return tree
        raise ValueError(t)


def _value(tree: tuple, at: dict[str, complex]) -> complex:
    kind = tree[0]
    if kind == "num":
        return tree[1]
    if kind == "var":
        return at[tree[1]]
    if kind == "neg":
        return -_value(tree[1], at)
    if kind == "call":
        return _CALLS[tree[1]](_value(tree[2], at))
    a, b = _value(tree[1], at), _value(tree[2], at)
    if kind == "+":
        return a + b
    if kind == "-":
        return a - b
    if kind == "*":
        return a * b
    if kind == "/":
        return a / b
    return a**b


def parse(text: str) -> tuple[tuple, set[str]] | None:
    """The tree of an expression and its letters, null if it is none."""
    try:
        parser = _Parser(text)
        return parser.whole(), parser.letters
    except (ValueError, RecursionError):
        return None


def number(text: str) -> float | None:
    """The value of a closed real expression."""
    got = parse(text)
    if got is None or got[1]:
        return None
    try:
        v = complex(_value(got[0], {}))
    except (ArithmeticError, ValueError, RecursionError):
        return None
    return v.real if abs(v.imag) < 1e-9 else None


def symbolic_equal(a: str, b: str, tolerance: float = 1e-3) -> bool:
    """Whether two formulas have the same value, closed ones within a tolerance, others at every sample point."""
    x, y = parse(a), parse(b)
    if x is None or y is None:
        return False
    letters = sorted(x[1] | y[1])
    points = [{c: p + 0.1931 * i for i, c in enumerate(letters)} for p in _POINTS] if letters else [{}]
    try:
        pairs = [(complex(_value(x[0], at)), complex(_value(y[0], at))) for at in points]
    except (ArithmeticError, ValueError, TypeError, RecursionError):
        return False
    if not letters:
        return all(abs(p - q) <= max(tolerance, 1e-9 * max(abs(p), abs(q))) for p, q in pairs)
    return all(abs(p - q) <= 1e-9 * max(1.0, abs(p), abs(q)) for p, q in pairs)
