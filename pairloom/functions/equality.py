"""Graders: when two answers are the same, from text equality through numbers, tuples and matrices to formulas."""

from __future__ import annotations

import re
import signal
import threading
from collections.abc import Callable
from math import isclose

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType

from .symbolic import number, symbolic_equal

#: How close numbers must be; a percentage counts as its hundredth, and the other way round.
CLOSE = 1e-3
Symbolic = Callable[[str, str], bool]


def digits(text: str) -> float | None:
    """A number with thousands commas, or a percentage as a fraction."""
    bare = text.replace(",", "")
    for form, scale in ((bare, 1.0), (bare.removesuffix("%").removesuffix("\\"), 100.0)):
        if scale == 1.0 or bare.endswith("%"):
            try:
                return float(form) / scale
            except ValueError:
                continue
    return None


def _sides(text: str) -> list[str] | None:
    """The two sides of an equation."""
    return [x.strip() for x in text.split("=")] if text.count("=") == 1 else None


def _enclosed(text: str) -> bool:
    return len(text) > 2 and text[0] in "([" and text[-1] in ")]"


_MATRIX = re.compile(r"\\begin\{[pb]matrix\}(.*)\\end\{[pb]matrix\}", re.S)


def _cells(text: str) -> list[list[str]] | None:
    m = _MATRIX.fullmatch(text)
    return [row.strip().split("&") for row in m[1].split("\\\\") if row.strip()] if m else None


def same_math(prediction: str, reference: str, percentage: bool = True, symbolic: Symbolic = symbolic_equal) -> bool:
    """Whether two answers are the same piece of mathematics.

    Equal text; else, where both are numbers, one within CLOSE of the other, its hundredth or a hundred times it; else
    tuples and intervals part by part, matrices cell by cell, equations by their difference, and formulas symbolically.
    """
    if prediction == reference:
        return True
    if "^{216}" in prediction:
        return False
    p, r = digits(prediction), digits(reference)
    if p is not None and r is not None:
        return any(isclose(x, p, abs_tol=CLOSE) for x in ((r / 100, r, r * 100) if percentage else (r,)))
    if not prediction:
        return False
    p_text, r_text = prediction.strip(), reference.strip()
    alike = lambda a, b: same_math(a, b, percentage, symbolic)
    every = lambda a, b: len(a) == len(b) and all(map(alike, a, b))
    if _enclosed(p_text) and _enclosed(r_text) and every(p_text[1:-1].split(","), r_text[1:-1].split(",")):
        return True
    p_rows, r_rows = _cells(p_text), _cells(r_text)
    if p_rows is not None and r_rows is not None and len(p_rows) == len(r_rows) and all(map(every, p_rows, r_rows)):
        return True
    p_sides, r_sides = _sides(p_text), _sides(r_text)
    if p_sides and r_sides:
        a, b = (f"{x} - ({y})" for x, y in (p_sides, r_sides))
        if symbolic(a, b) or symbolic(f"-({a})", b):
            return True
    elif p_sides and "=" not in r_text and len(p_sides[0]) <= 2:
        if alike(p_text.split("=")[1], r_text):
            return True
    elif r_sides and "=" not in p_text and len(r_sides[0]) <= 2:
        if alike(p_text, r_text.split("=")[1]):
            return True
    return symbolic(p_text, r_text)


def same_answer(prediction: str, reference: str, tolerance: float = CLOSE) -> bool:
    """One answer against one: numbers less than the tolerance apart, equal texts, the same mathematics; unions as sets."""
    if "\\cup" in prediction and "\\cup" in reference:
        return same_lists(prediction.split("\\cup"), reference.split("\\cup"), tolerance)
    try:
        if abs(float(prediction.replace(",", "")) - float(reference.replace(",", ""))) < tolerance:
            return True
    except ValueError:
        pass
    return (bool(reference) and prediction == reference) or same_math(prediction, reference)


def same_lists(predictions: list[str], references: list[str], tolerance: float = CLOSE) -> bool:
    """Every prediction is some reference and every reference some prediction."""
    table = [[same_answer(p, r, tolerance) for r in references] for p in predictions]
    return all(map(any, table)) and all(map(any, zip(*table))) and (bool(table) or not references)


def same_math_lists(predictions: list[str], references: list[str], tolerance: float = CLOSE) -> bool:
    """same_lists of the distinct references and as many of the last distinct predictions."""
    wanted = list(dict.fromkeys(references))
    return same_lists(list(dict.fromkeys(predictions))[-len(wanted) :], wanted, tolerance)


def split_outside(text: str) -> list[str]:
    """Parts between semicolons, and between commas that no bracket encloses; brackets are counted anew in each part."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        if c == ";" or (c == "," and not depth):
            out.append(text[start:i].strip())
            start, depth = i + 1, 0
        else:
            depth += (c in "([{") - (c in ")]}")
    return [*out, text[start:].strip()]


def cloze(predictions: list[str], references: list[str]) -> bool:
    """The last distinct parts of the predictions against the references, one by one."""
    parts = list(dict.fromkeys(x for p in predictions for x in (split_outside(p) if p else [])))[-len(references) :]
    return len(parts) == len(references) and all(map(same_answer, parts, references))


def choice(predictions: list[str], references: list[str]) -> bool:
    """Of A to D the one whose first occurrence comes last."""
    text = " ".join(predictions)
    found = [(text.index(c), c) for c in "ABCD" if c in text]
    return bool(found) and [max(found)[1]] == references


# ---- course answers: numbers with units, equations, TeX

#: Units that a course answer may carry, in the order in which they are taken off.
COURSE_UNITS = (
    "eV", " \\mathrm{~kg} \\cdot \\mathrm{m} / \\mathrm{s}", " kg m/s", "kg*m/s", "kg", "m/s", "m / s", "m s^{-1}", "\\text{ m/s}", " \\mathrm{m/s}",
    " \\text{ m/s}", "g/mole", "g/mol", "\\mathrm{~g}", "\\mathrm{~g} / \\mathrm{mol}", "W", "erg/s", "years", "year", "cm",
)
COURSE_SYMBOLS = ("m", "s", "cm")


def course_number(text: str | None) -> float | None:
    """The value of a course answer without units; null if it is no closed expression. Nothing is executed."""
    if text is None:
        return None
    for unit in COURSE_UNITS:
        text = text.replace(unit, "").strip()
    for unit in COURSE_SYMBOLS:
        text = text.replace("\\mathrm{" + unit + "}", "").replace("\\mathrm{~" + unit + "}", "").strip()
    text = text.strip("$")
    try:
        return float(text)
    except ValueError:
        # a power written with an e or a times sign is a closed expression
        return number(re.sub(r"(?<=\d)[eE]([+-]?\d+)", r"*10^{\1}", text))


def numbers_equal(a: float | None, b: float | None, threshold: float = 0.01) -> bool:
    """Relatively close; where one is about zero, or both about alike, closer than a share of their mean."""
    if a is None or b is None:
        return False
    about = lambda x, y: abs(x - y) <= 1e-8 + 1e-5 * abs(y)
    if about(a, 0) or about(b, 0) or about(a - b, 0):
        return abs(a - b) < threshold * (a + b) / 2
    return about(a, b)


#: Literal rewrites of a TeX answer, then words and signs that are taken out, in their order.
TEX_LITERALS = (("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"), (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}"))
TEX_REMOVED = (
    "square", "ways", "integers", "dollars", "mph", "inches", "ft", "hours", "km", "units", "\\ldots", "sue", "points", "feet", "minutes", "digits", "cents", "degrees",
    "cm", "gm", "pounds", "meters", "meals", "edges", "students", "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3",
    "\\text{\n}", "\\text{}", "\\mathrm{th}", "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots",
)
TEX_PATTERNS = (
    (r"(.*?)(\$)(.*?)(\$)(.*)", r"$\3$"), (r"(\\text\{)(.*?)(\})", r"\2"), (r"(\\textbf\{)(.*?)(\})", r"\2"), (r"(\\overline\{)(.*?)(\})", r"\2"),
    (r"(\\boxed\{)(.*)(\})", r"\2"), (r"(frac)([^{])(.)", r"frac{\2}{\3}"), (r"(sqrt)([^{])", r"sqrt{\2}"), (r"\$", ""),
)


def plain_tex(text: str) -> str:
    text = text.split("=")[-1]
    for a, b in (*TEX_LITERALS, *((x, "") for x in TEX_REMOVED)):
        text = text.replace(a, b)
    for pattern, to in TEX_PATTERNS:
        text = re.sub(pattern, to, text)
    return text.replace(",", "") if text.replace(",", "").isdigit() else text


def _equation(text: str) -> list[str] | None:
    """The sides of an equation in display or dollar marks, brackets of one size; null for anything else."""
    bare = text.removeprefix("\\[").removesuffix("\\]").replace("\\left(", "(").replace("\\right)", ")").replace("\\\\", "\\").strip("$")
    sides = _sides(bare)
    return [re.sub(r"\s+", "", x) for x in sides] if sides and all(sides) else None


def course_answer(predictions: list[str], references: list[str]) -> bool:
    """Numbers by value, equations by their sides, anything else by plain TeX, as the reference is."""
    prediction, reference = predictions[-1] if predictions else "", references[0]
    if not prediction:
        return False
    try:
        float(reference)
    except ValueError:
        if "=" in reference:
            own = _equation(prediction)
            return own is not None and own == _equation(reference)
        return plain_tex(prediction) == plain_tex(reference)
    return numbers_equal(course_number(prediction), course_number(reference))


#: Graders by name: (predictions, references) to a verdict.
GRADERS: dict[str, Callable[[list[str], list[str]], bool]] = {
    "math": same_math_lists,
    "last_single": lambda p, r: same_answer(p[-1] if p else "", r[0]),
    "cloze": cloze,
    "choice": choice,
    "sat": lambda p, r: (p[-1] if p else "").lower() == r[0].lower(),
    "course": course_answer,
    "minif2f": lambda p, r: True,
}


def within(f: Symbolic, seconds: float = 1.0) -> Symbolic:
    """f, or False where it takes longer. A worker runs it in its main thread, which an alarm interrupts; other threads
    have no alarm and run it to its end."""

    def limited(a: str, b: str) -> bool:
        if threading.current_thread() is not threading.main_thread():
            return f(a, b)

        def stop(number: int, frame: object) -> None:
            raise TimeoutError

        before = signal.signal(signal.SIGALRM, stop)
        signal.setitimer(signal.ITIMER_REAL, seconds)
        try:
            return f(a, b)
        except TimeoutError:
            return False
        finally:
            signal.setitimer(signal.ITIMER_REAL, 0)
            signal.signal(signal.SIGALRM, before)

    return limited


def on_text(f: Callable[[str], float | None]):
    """f as a pandas UDF of one column to numbers; null in, null out."""

    @F.pandas_udf(DoubleType())
    def value(a: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else f(x) for x in a], dtype="float64")

    return value


def on_pairs(f: Callable):
    """f as a pandas UDF of two columns; a null on either side is False."""

    @F.pandas_udf(BooleanType())
    def verdict(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([x is not None and y is not None and bool(f(x, y)) for x, y in zip(a, b)], dtype=bool)

    return verdict


def math_equal_full(prediction: Column, reference: Column, symbolic: Symbolic = symbolic_equal, seconds: float = 1.0) -> Column:
    """same_math as a column: equal texts and plain numbers are settled by columns, the rest goes to Python in batches.

    symbolic: the step that compares formulas, e.g. a computer algebra system; it has so many seconds for each pair.
    """
    symbolic = within(symbolic, seconds)
    plain = r"\A[+-]?[0-9]+(?:\.[0-9]+)?\z"
    both = prediction.rlike(plain) & reference.rlike(plain)
    p, r = prediction.try_cast("double"), reference.try_cast("double")
    near = lambda x: F.abs(p - x) <= F.greatest(F.lit(CLOSE), 1e-9 * F.greatest(F.abs(p), F.abs(x)))
    cheap = F.when(prediction == reference, F.lit(True)).when(both, near(r) | near(r / 100) | near(r * 100))
    rest = F.when(cheap.isNull(), prediction)
    return F.coalesce(cheap, on_pairs(lambda a, b: same_math(a, b, symbolic=symbolic))(rest, reference))


def graded(predictions: Column, references: Column, grader: str) -> Column:
    """The verdict of a grader on two arrays of answers."""
    f = GRADERS[grader]
    return on_pairs(lambda p, r: len(r) > 0 and f([x or "" for x in p], [x or "" for x in r]))(predictions, references)


def peel(text: str) -> str:
    """A prediction in its normal form: numbers to six places, other answers without brackets and braces."""
    try:
        return str(round(float(text.replace(",", "")), 6))
    except ValueError:
        text = text.strip()
    pairs = 0
    while 2 * pairs + 1 < len(text) and text[pairs] + text[-1 - pairs] in ("[]", "()"):
        pairs += 1
    return re.sub(r"[{}()]", "", text[pairs : len(text) - pairs])


@F.pandas_udf(StringType())
def peeled(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else peel(t))
