"""Answers in free text: extraction, normal forms, equality."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, StringType


def python_pattern(pattern: str) -> str:
    """A Python regular expression for Java: Unicode classes, \\n as the only line end, \\Z at the very end."""
    return "(?dU)" + pattern.replace(r"\Z", r"\z")


def strip_all(x: Column) -> Column:
    """Python's str.strip: all Unicode white space at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+\z", "")


BOXED = r"\\boxed\s*\{((?:[^{}]|\{[^{}]*\})+)\}"


def _trigger(trigger: str) -> str:
    return python_pattern(r"\Q" + trigger + r"\E\s*['\"]?([^\n.]+?)['\"]?(?:[\n.]|$)")


def _unwrap(x: Column) -> Column:
    return F.when(x.rlike(r"(?s)^\{.*\}$"), F.regexp_extract(x, r"(?s)^\{(.*)\}$", 1)).otherwise(x)


def answers_after(text: Column, trigger: str = "The answer is:") -> Column:
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(_trigger(trigger)), F.lit(1)), strip_all), lambda found: F.length(found) > 0)


def boxed(text: Column) -> Column:
    """What stands in each box, with one level of braces inside; an outer pair of braces comes off."""
    return F.transform(F.regexp_extract_all(text, F.lit("(?U)" + BOXED), F.lit(1)), lambda found: strip_all(_unwrap(strip_all(found))))


def last_answer(text: Column, trigger: str = "The answer is:") -> Column:
    """The last answer after the trigger, up to a point or line end; if there is none or it is blank, the last boxed one."""
    found = F.transform(F.regexp_extract_all(text, F.lit(_trigger(trigger)), F.lit(1)), strip_all)
    return F.coalesce(F.nullif(F.try_element_at(found, F.lit(-1)), F.lit("")), F.try_element_at(boxed(text), F.lit(-1)))


def all_answers(text: Column, trigger: str = "The answer is:", with_boxed: bool = True) -> Column:
    """Distinct answers in order, those after the trigger first; null if there is none."""
    filled = F.filter(boxed(text), lambda found: found != "")
    found = F.array_distinct(F.concat(answers_after(text, trigger), filled) if with_boxed else answers_after(text, trigger))
    return F.when(F.size(found) > 0, found)


def last_number(text: Column, trigger: str = "The answer is:") -> Column:
    """The number after the last trigger."""
    pattern = python_pattern(r"\Q" + trigger + r"\E\s*([-+]?\d+(?:\.\d+)?)")
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(-1)).try_cast("double")


def first_number(text: Column) -> Column:
    """The first number, without a sign, of the earlier of a box in \\( \\) and a text after 'Therefore, the answer is: '.

    The text ends at a point or line end. Null where neither stands, or the earlier one has no number.
    """
    forms = (python_pattern(r"\\\(\\boxed\{(.*?)\}\\\)"), python_pattern(r"Therefore, the answer is: ([^\.\n]+)"))
    found = F.array(*[F.struct(F.nullif(F.regexp_instr(text, F.lit(p)), F.lit(0)).alias("at"), F.regexp_extract(text, p, 1).alias("answer")) for p in forms])
    first = F.array_min(F.filter(found, lambda x: x["at"].isNotNull()))
    return F.nullif(F.regexp_extract(first["answer"], r"\d+(?:\.\d+)?", 0), F.lit("")).try_cast("double")


def squeeze(x: Column) -> Column:
    """No white space at all and no quotes at the ends."""
    return F.btrim(F.regexp_replace(x, r"(?U)\s+", ""), F.lit("'\""))


_FLOAT = r"^[+-]?(?:\d+(?:_\d+)*(?:\.(?:\d+(?:_\d+)*)?)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+)?$"


def python_float(x: Column) -> Column:
    """A number by Python's grammar: underscores between digits, no type suffix; inf and nan too. Else null."""
    t = strip_all(x)
    return F.when(t.rlike(_FLOAT), F.replace(t, F.lit("_"), F.lit("")).try_cast("double")).when(F.lower(t).rlike(r"^[+-]?(inf|infinity|nan)$"), F.lower(t).try_cast("double"))


def answer_equal(a: Column, b: Column, rel: float = 1e-6) -> Column:
    """Numbers within a relative tolerance, other answers by their squeezed text. Null equals nothing."""
    x, y = python_float(a), python_float(b)
    near = F.abs(x - y) <= rel * F.greatest(F.abs(x), F.abs(y))
    return F.coalesce(F.when(x.isNotNull() & y.isNotNull(), near).otherwise(squeeze(a) == squeeze(b)), F.lit(False))


def digits_value(x: Column) -> Column:
    """A number with thousands commas, or a percentage as a fraction."""
    t = F.replace(strip_all(x), F.lit(","), F.lit(""))
    pct = F.regexp_replace(t, r"\\?%$", "")
    return F.when(t.rlike(r"%$"), F.try_divide(python_float(pct), F.lit(100.0))).otherwise(python_float(t))


def math_equal(prediction: Column, reference: Column, tolerance: float = 1e-3) -> Column:
    """Same text, or numbers within a tolerance of the reference, a hundredth or a hundred times of it."""
    p, r = digits_value(prediction), digits_value(reference)
    near = lambda v: F.abs(p - v) <= tolerance
    return F.coalesce((F.lower(strip_all(prediction)) == F.lower(strip_all(reference))) | near(r) | near(r / 100) | near(r * 100), F.lower(strip_all(prediction)) == F.lower(strip_all(reference)), F.lit(False))


@F.pandas_udf(ArrayType(StringType()))
def balanced_boxed(text: pd.Series) -> pd.Series:
    """All boxed answers with braces balanced to any depth, which no regular expression reaches."""

    def one(t: str | None) -> list[str] | None:
        if t is None:
            return None
        out, at = [], 0
        while (at := t.find("\\boxed{", at)) >= 0:
            depth, i = 1, at + 7
            while i < len(t) and depth:
                depth += (t[i] == "{") - (t[i] == "}")
                i += 1
            if not depth:
                out.append(t[at + 7 : i - 1])
            at = i
        return out

    return text.map(one)


@F.pandas_udf(ArrayType(StringType()))
def split_outside_brackets(text: pd.Series) -> pd.Series:
    """Parts between commas and semicolons that no bracket encloses."""

    def one(t: str | None) -> list[str] | None:
        if t is None:
            return None
        out, depth, part = [], 0, ""
        for c in t:
            depth += (c in "([{") - (c in ")]}")
            if c in ",;" and depth <= 0:
                out.append(part.strip())
                part = ""
            else:
                part += c
        return [x for x in [*out, part.strip()] if x]

    return text.map(one)


def choice(text: Column) -> Column:
    """Of A to D the one whose first occurrence comes last."""
    found = F.array(*[F.struct(F.locate(c, text).alias("at"), F.lit(c).alias("c")) for c in "ABCD"])
    best = F.array_max(found)
    return F.when(best["at"] > 0, best["c"])


def program_output(text: Column) -> Column:
    """The last fenced output block."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(r"(?s)```output\n(.*?)```"), F.lit(1)), F.lit(-1))


def program(text: Column) -> Column:
    """The last fenced python block."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(r"(?s)```python\n(.*?)```"), F.lit(1)), F.lit(-1))


def rating_of(block: Column) -> Column:
    """The first rating in a block: 'Rating: 4.5', 'Rating: 3/5'; N/A is null; half to even, held to 1..5."""
    raw = F.regexp_extract(block, r"(?i)rating:\s*\**\s*([0-9]+(?:\.[0-9]+)?|N/A)", 1)
    x = raw.try_cast("double")
    return F.when(x.isNotNull(), F.rint(F.least(F.lit(5.0), F.greatest(F.lit(1.0), x)))).cast("int")


def ratings(text: Column) -> Column:
    """A rating for each block that opens with '#### Output for Text n'."""
    parts = F.split(text, r"#### Output for Text \d+")
    blocks = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.transform(blocks, rating_of)


def user_turn(text: Column) -> Column:
    """The body of the ChatML user turn, else the text itself."""
    return F.coalesce(F.nullif(strip_all(F.regexp_extract(text, r"(?s)<\|im_start\|>user\n(.*?)<\|im_end\|>", 1)), F.lit("")), text)


def retemplated(text: Column, prefix: str, suffix: str, template: str) -> Column:
    """The body between prefix and suffix put into another template ({input}); any other text is an error."""
    body = F.regexp_extract(text, r"(?s)^\Q" + prefix + r"\E(.*)\Q" + suffix + r"\E$", 1)
    fits = F.startswith(text, F.lit(prefix)) & F.endswith(text, F.lit(suffix))
    return F.when(fits, F.replace(F.lit(template), F.lit("{input}"), body)).otherwise(F.raise_error(F.lit("a prompt doesn't fit its template")))


def with_eos(text: Column, eos: str = "</s>") -> Column:
    """text with eos if it ends in an answer or has a boxed one."""
    done = text.rlike(r"(?dU)The answer is: .+$") | text.rlike(r"\\boxed\{[^{}]*\}")
    return F.when(done, F.concat(F.regexp_replace(text, r"(?U)\s+\z", ""), F.lit(" " + eos))).otherwise(text)


def strip_tokens(text: Column, token: str) -> Column:
    """text without repeats of a token at both ends."""
    q = r"\Q" + token + r"\E"
    return F.regexp_replace(text, f"^(?:{q})+|(?:{q})+$", "")


def step_pieces(text: Column, separator: str = "\n") -> Column:
    """Steps, each but the last keeping its separator."""
    parts = F.split(text, re.escape(separator))
    return F.transform(parts, lambda part, at: F.when(at < F.size(parts) - 1, F.concat(part, F.lit(separator))).otherwise(part))


@F.pandas_udf(StringType())
def fixed_text(x: pd.Series, places: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) else f"{v:.{p}f}" for v, p in zip(x, places)], dtype=object)


def fixed(x: Column, places: int) -> Column:
    """A number with so many places, rounded as its binary value lies; JVM formatting rounds the decimal form instead."""
    return fixed_text(x, F.lit(places))
