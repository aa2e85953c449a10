"""The answer that a generation states: the cascade of forms, LaTeX normal forms, extractors by dataset."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, StringType

from .text import python_pattern as py, strip_all


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once, however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _each(x: Column, *pairs: tuple[str, str]) -> Column:
    for a, b in pairs:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def _subs(x: Column, *pairs: tuple[str, str]) -> Column:
    for pattern, to in pairs:
        x = F.regexp_replace(x, py(pattern), to)
    return x


#: The rewrites of a LaTeX answer, in their order. A literal is replaced as it stands, a pattern by regular
#: expression, and "strip" takes white space off both ends.
FRACTIONS = (("tfrac", "frac"), ("dfrac", "frac"), ("cfrac", "frac"))
SIZES = (("\\left", ""), ("\\right", ""))
DEGREES = (("^{\\circ}", ""), ("^\\circ", ""))
UNITS = ((r"\{(?:c|m)?m\}(?:\^[23])?", ""), (r"p\.m\.\Z", ""), (r"(\d)\s*t\Z", "$1"))
SIGNS = (("\\$", ""), ("$", ""), ("x\\in", ""), ("\\%", "%"), (" .", " 0."), ("{.", "{0."), ("\\cdot", ""))
FONTS = (("\\mathbf", ""), ("\\mathrm", ""))
ZEROS = ((r"(\d+)\.0+([^\d])", "$1$2"), (r"(\d+)\.0+\Z", "$1"))
BRACES = (
    (r"\\sqrt(-?[0-9.a-zA-Z]+)", r"\\sqrt{$1}"), (r"\\sqrt\s+(\w+)\Z", r"\\sqrt{$1}"),
    (r"\\tan(-?[0-9.a-zA-Z]+)", r"\\tan{$1}"), (r"\\tan\s+(\w+)\Z", r"\\tan{$1}"),
)


def braced_fractions(x: Column) -> Column:
    """\\frac12 as \\frac{1}{2}; a fraction without two parts leaves the text as it is."""
    broken = lambda v: v.rlike(r"(?s)\\frac(?=\\frac|\z)|\\frac[^{](?=\\frac|\z)")
    fixed = lambda v: _subs(v, (r"\\frac([^{])([^{])", r"\\frac{$1}{$2}"), (r"\\frac([^{])\{", r"\\frac{$1}{"))
    return let(x, lambda v: F.when(broken(v), v).otherwise(fixed(v)))


def slash_fraction(x: Column) -> Column:
    """a/b of whole numbers in plain form, or of roots, as \\frac{a}{b}."""
    part = r"((?:0|-?[1-9][0-9]*)|[^/]*sqrt[^/]*)"
    return F.regexp_replace(x, r"(?s)\A" + part + "/" + part + r"\z", r"\\frac{$1}{$2}")


def plain_answer(x: Column) -> Column:
    """A LaTeX answer in its plain form: no sizes, units, degrees, dollars or fonts, numbers and fractions written alike."""
    t = F.replace(strip_all(x), F.lit("\n"), F.lit(""))
    t = _each(F.regexp_replace(t, r"\.+\z", ""), ("\\!", ""))
    t = F.regexp_replace(t, r"(?s)\A\\text\{(.*)\}\z", "$1")
    t = _each(t, *FRACTIONS, *SIZES)
    # a text at the end is a unit if anything stands before it
    t = F.regexp_replace(t, r"(?s)\A((?:(?!\\text\{).)*?\S(?:(?!\\text\{).)*?)\s*\\text\{.*\}\z", "$1")
    for a, b in DEGREES:
        t = strip_all(_each(t, (a, b)))
    for pattern, to in UNITS:
        t = strip_all(_subs(t, (pattern, to)))
    t = _each(t, *SIGNS, ("infinity", "\\infty"))
    t = let(t, lambda v: F.when(F.contains(v, F.lit("\\infty")), v).otherwise(F.replace(v, F.lit("inf"), F.lit("\\infty"))))
    t = _subs(_each(t, ("+\\inity", "\\infty"), *FONTS), (r"\\mbox\{.*?\}", ""))
    t = let(t, lambda v: F.when(F.contains(v, F.lit("i")), v).otherwise(F.replace(v, F.lit("j"), F.lit("i"))))
    t = F.regexp_replace(_subs(t, *ZEROS), r"\A\.", "0.")
    t = F.replace(_subs(t, *BRACES), F.lit(" "), F.lit(""))
    return F.regexp_replace(slash_fraction(braced_fractions(t)), r"[\\,.]+\z", "")


def boxed_of(text: str) -> list[str]:
    """What stands in each box, to any depth of braces; a percent sign behind the box keeps its closing brace."""
    out = []
    for piece in text.split("boxed{")[1:]:
        depth = 0
        for i, c in enumerate(piece):
            depth += (c == "{") - (c == "}")
            if depth < 0:
                out.append(piece[: i + (piece[i + 1 : i + 2] == "%")])
                break
    return out


@F.pandas_udf(ArrayType(StringType()))
def all_boxed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: boxed_of(t) if t else None)


def split_first(x: Column, mark: str) -> Column:
    """What stands before the first mark."""
    return F.substring_index(x, mark, 1)


def after_last(x: Column, mark: str) -> Column:
    return F.substring_index(x, mark, -1)


def after_first(x: Column, mark: str) -> Column:
    return F.regexp_replace(x, r"(?s)\A.*?\Q" + mark + r"\E", "")


def program_output(text: Column) -> Column:
    """The last fenced output, empty if there is none."""
    found = strip_all(split_first(after_last(text, "```output"), "```"))
    return F.when(F.contains(text, F.lit("```output")), found).otherwise(F.lit(""))


def last_figure(text: Column) -> Column:
    """The last number, commas not counted; null if there is none."""
    return F.try_element_at(F.regexp_extract_all(F.replace(text, F.lit(","), F.lit("")), F.lit(r"(?U)(-?\d*\.?\d+)"), F.lit(1)), F.lit(-1))


def raw_answers(text: Column) -> Column:
    """The answers of the first form that a text has: a final answer in dollars, boxes, 'he answer is', output, a number."""
    has = lambda mark: F.contains(text, F.lit(mark))
    final = strip_all(split_first(after_first(text, "final answer is $"), "$. I hope"))
    # only texts with a box reach Python
    boxes = all_boxed(F.when(has("boxed"), text))
    output, figure = program_output(text), last_figure(text)
    rest = F.when(output != "", F.array(output)).when(figure.isNotNull(), F.array(figure)).otherwise(F.array().cast("array<string>"))
    return (
        F.when(has("final answer is $") & has("$. I hope"), F.array(final))
        .when(has("boxed"), boxes)
        .when(has("he answer is"), F.array(strip_all(after_last(text, "he answer is"))))
        .otherwise(rest)
    )


def tidy(x: Column) -> Column:
    return plain_answer(F.regexp_replace(F.regexp_replace(F.regexp_replace(strip_all(x), r"\A:+", ""), r"\.+\z", ""), r"/+\z", ""))


def stated_answers(text: Column) -> Column:
    """All answers of a text in plain form."""
    return F.transform(raw_answers(text), tidy)


def stated_answer(text: Column) -> Column:
    """The last answer of a text in plain form, empty if it states none."""
    return F.when(text.isNotNull(), F.coalesce(tidy(F.try_element_at(raw_answers(text), F.lit(-1))), F.lit("")))


def _parts(x: Column, separator: str) -> Column:
    return F.transform(F.split(x, separator), strip_all)


def math_answers(question: Column, text: Column) -> Column:
    """stated_answers, one answer a part where the question asks for commas or the answer joins two by 'and'."""
    many = F.contains(question, F.lit("separated by commas"))

    def split(a: Column) -> Column:
        both = a.rlike(r"(?U)\\text\{\s*and\s*\}")
        return F.when(many & ~a.rlike(r"[()\[\]]"), _parts(a, ",")).when(both, _parts(a, r"(?U)\\text\{\s*and\s*\}")).otherwise(F.array(strip_all(a)))

    return F.flatten(F.transform(stated_answers(text), split))


_FIGURES = r"(?U)(-?\d+\.?\d*)"
INVALID, PLACEHOLDER = "[invalid]", "placeholder"


def _cloze(text: Column) -> Column:
    """The line after the Chinese answer trigger."""
    line = strip_all(split_first(strip_all(after_first(text, "答案是")), "\n"))
    return F.when(F.contains(text, F.lit("答案是")), line)


def _last_of(x: Column, pattern: str) -> Column:
    return F.try_element_at(F.regexp_extract_all(x, F.lit(pattern), F.lit(1)), F.lit(-1))


def _sat(text: Column) -> Column:
    found = F.regexp_extract(F.lower(split_first(text, "Problem:")), r"the final answer is \(?([abcd])\)?", 1)
    return F.coalesce(F.upper(F.nullif(found, F.lit(""))), F.lit(PLACEHOLDER))


def _cmath(text: Column) -> Column:
    head = split_first(text, "问题：")
    line = F.btrim(F.btrim(split_first(strip_all(after_first(head, "答案是")), "\n"), F.lit("：")), F.lit("。"))
    return F.when(F.contains(head, F.lit("答案是")), F.coalesce(_last_of(line, _FIGURES), F.lit(INVALID))).otherwise(stated_answer(head))


#: Extractors of each dataset: (question, text) to an array of answers.
EXTRACTORS: dict[str, Callable[[Column, Column], Column]] = {
    "math_few_shot": lambda q, t: math_answers(q, split_first(t, "Problem:")),
    "last_single": lambda q, t: F.array(stated_answer(t)),
    "gsm_few_shot": lambda q, t: F.array(F.coalesce(_last_of(split_first(t, "Q: "), _FIGURES), F.lit(INVALID))),
    "gaokao_cloze": lambda q, t: F.array(F.coalesce(F.btrim(_cloze(split_first(t, "问题 ")), F.lit("$")), F.lit(PLACEHOLDER))),
    "gaokao_mathqa": lambda q, t: F.array(F.coalesce(_cloze(split_first(t, "问题 ")), F.lit(PLACEHOLDER))),
    "sat": lambda q, t: F.array(_sat(t)),
    "ocw": lambda q, t: F.array(
        F.coalesce(F.nullif(F.regexp_extract(split_first(t, "Problem:"), py(r"final answer is (.*)\. I hope it is correct."), 1), F.lit("")), F.lit(INVALID))
    ),
    "mmlu_stem": lambda q, t: F.array(_sat(split_first(t, "Problem:"))),
    "minif2f": lambda q, t: F.array(strip_all(split_first(t, "Informal:"))),
    "cmath": lambda q, t: F.array(_cmath(t)),
}


def rewritten_answer(text: Column, trigger: str = "The answer is:") -> Column:
    """text with all that follows the first trigger in a box of doubled braces; null where there is none, or nothing after."""
    found = F.regexp_extract(text, py(r"(?s)\Q" + trigger + r"\E\s*(.+)"), 1)
    head = split_first(text, trigger)
    return F.when(text.rlike(py(r"(?s)\Q" + trigger + r"\E\s*.+")), F.concat(head, F.lit(trigger + " \\boxed{{"), strip_all(found), F.lit("}}")))


def split_answer(text: Column, trigger: str = "The answer is: ") -> Column:
    """The whole number between the first trigger and the next blank; null where there is none."""
    return F.try_element_at(F.split(F.try_element_at(F.split(text, r"\Q" + trigger + r"\E"), F.lit(2)), " "), F.lit(1)).try_cast("bigint")


_DOCSTRING = r'(?m)^[^\S\n]*"""(?![^\n]*"""[^\S\n]*$)[^\n]*(?:\n[^\n]*?)*?(?:"""[^\S\n]*$|\z)'
_ONE_LINE = r'(?m)^([^\S\n]*)"""[^\n]*"""[^\S\n]*$'


def without_comments(code: Column) -> Column:
    """Code whose comment lines and one-line docstrings are marks, and whose longer docstrings are empty lines."""
    code = F.regexp_replace(code, _DOCSTRING, "")
    code = F.regexp_replace(code, _ONE_LINE, '$1"""comments"""')
    return F.regexp_replace(code, r"(?m)^([^\S\n]*)#[^\n]*$", "$1# comments")
