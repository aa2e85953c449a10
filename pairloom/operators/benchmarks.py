"""Benchmarks of several forms as user and assistant turns, and their stated answers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions.answers import let
from ..functions.text import python_float, strip_all


def _turns(user: Column, assistant: Column | None = None) -> Column:
    return F.struct(user.alias("user"), (assistant if assistant is not None else F.lit("")).alias("assistant"))


def plain(question: str) -> Column:
    return _turns(strip_all(F.col(question)))


def choices(question: str, options: str, label: str) -> Column:
    """A question with options 'A) x B) y', whose letters get an opening bracket each."""
    marked = F.concat(F.lit("("), F.regexp_replace(strip_all(F.col(options)), r" ([B-G])\) ", " ($1) "))
    return _turns(F.concat_ws("\n", strip_all(F.col(question)), F.lit("What of the following is the right choice? Explain your answer."), marked), F.col(label))


def tables(question: str, grid: str, title: str | None = None) -> Column:
    """A question on a table, with its title where it has one."""
    named = F.concat(F.lit('regarding "'), F.nullif(F.col(title), F.lit("")), F.lit('" ')) if title else F.lit(None).cast("string")
    head = F.concat(F.lit("Read the following table "), F.coalesce(named, F.lit("")), F.lit("and answer a question:"))
    return _turns(F.concat_ws("\n", head, F.col(grid), strip_all(F.col(question))))


def worded(body: str, question: str, reasoning: str, answer: str) -> Column:
    """A body that ends in a stop and a question; the reasoning without calculator marks, closed by the boxed answer."""
    text = let(strip_all(F.col(body)), lambda v: F.when(F.endswith(v, F.lit(".")), v).otherwise(F.concat(v, F.lit("."))))
    shown = F.regexp_replace(F.col(reasoning), "<<[^<>]*>>", "")
    return _turns(F.concat_ws(" ", text, strip_all(F.col(question))), F.concat(shown, F.lit("\nSo the answer is $\\boxed{"), strip_all(F.col(answer)), F.lit("}$.")))


def adapted(kind: Column, adapters: dict[str, Column], other: Column) -> Column:
    """The turns of the adapter of each kind, of any other kind by other."""
    out = other
    for name, turns in adapters.items():
        out = F.when(kind == name, turns).otherwise(out)
    return out


def after_mark(raw: Column, mark: str = "####") -> Column:
    return strip_all(F.try_element_at(F.split(raw, mark), F.lit(2)))


def table_number(raw: Column) -> Column:
    """A share a/b, a number with thousands, a percentage or a plain number as the text of its value."""
    parts = F.transform(F.split(raw, "/"), lambda v: python_float(v))
    share = F.try_divide(F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))
    value = (
        F.when(F.contains(raw, F.lit("/")), share)
        .when(F.contains(raw, F.lit(",")), python_float(F.replace(raw, F.lit(","), F.lit(""))))
        .when(F.contains(raw, F.lit("%")), python_float(F.substring_index(raw, "%", 1)) / 100)
        .otherwise(python_float(raw))
    )
    whole = let(value, lambda v: F.when(v == F.floor(v), v.cast("bigint").cast("string")).otherwise(v.cast("string")))
    return whole


def without_brackets(raw: Column) -> Column:
    return strip_all(F.regexp_replace(raw, r"\(.*?\)", ""))
