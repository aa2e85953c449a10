"""Fixtures of the graders, worked out by hand from their specification."""

import time

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pairloom.functions import answers as N, arrays as A, equality as E, symbolic as S, templates


@pytest.mark.parametrize(
    "a,b,same",
    [
        ("\\frac{1}{2}", "0.5", True), ("\\frac12", "1/2", True), ("2\\pi", "2 \\cdot \\pi", True), ("\\sqrt[3]{8}", "2", True), ("x(x+1)", "x^2+x", True), ("x^2", "x^3", False),
        ("\\sin(x)^2+\\cos(x)^2", "1", True), ("a+b", "b+a", True), ("ab", "ba", True), ("3!", "6", False), ("", "", False), ("(((", "1", False), ("\\unknown{1}", "1", False), ("1/0", "1/0", False), ("50\\%", "0.5", True),
    ],
)
def test_symbolic(a, b, same):
    assert S.symbolic_equal(a, b) is same


def test_deep_and_long_formulas_end():
    assert S.symbolic_equal("(" * 5000 + "1" + ")" * 5000, "1") is False
    assert S.symbolic_equal("+".join(["1"] * 3000), "3000") in (True, False)
    assert S.number("2^{10}") == 1024 and S.number("x") is None and S.number("\\sqrt{-1}") is None


@given(st.text(max_size=30), st.text(max_size=30))
@settings(max_examples=300, deadline=None)
def test_graders_never_fail(a, b):
    assert E.same_math(a, b) in (True, False) and E.same_answer(a, b) in (True, False) and isinstance(E.peel(a), str)
    assert E.same_math(a, a) is True
    for f in E.GRADERS.values():
        assert f([a, b], [b]) in (True, False) and f([], [a]) in (True, False)


@pytest.mark.parametrize(
    "a,b,same",
    [
        ("50", "0.5", True), ("7", "7.0005", True), ("(1, 2)", "(1,2)", True), ("(1,2)", "(1,2,3)", False), ("\\begin{pmatrix}1 & 2\\\\3 & 4\\end{pmatrix}", "\\begin{pmatrix}1&2\\\\3&5\\end{pmatrix}", False),
        ("x=5", "5", True), ("5", "y=5", True), ("abc=5", "5", False), ("x+y=1", "1=x+y", True), ("1,000", "1000", True), ("2^{216}", "2^{216}", True), ("2^{216}+1", "1", False), ("", "0", False),
    ],
)
def test_same_math(a, b, same):
    assert E.same_math(a, b) is same


def test_lists_unions_and_cloze():
    assert E.same_lists(["1", "2"], ["2.0", "1"]) and not E.same_lists(["1"], ["1", "2"]) and E.same_lists([], [])
    assert E.same_answer("(0,1)\\cup(2,3)", "(2,3)\\cup(0,1)") and not E.same_answer("(0,1)\\cup(2,3)", "(0,1)\\cup(2,4)")
    assert E.same_math_lists(["9", "1", "1", "2"], ["2", "1", "2"])
    assert E.split_outside("a, (b, c); d") == ["a", "(b, c)", "d"] and E.cloze(["1, 2"], ["1", "2"]) and not E.cloze(["1"], ["1", "2"])


def test_course_answers():
    assert E.course_number("5 kg m/s") == 5 and E.course_number("1.5e2") == 150 and E.course_number("x") is None and E.course_number(None) is None
    assert E.numbers_equal(1.0, 1.000001) and not E.numbers_equal(1.0, 1.1) and not E.numbers_equal(0.0, 0.0) and not E.numbers_equal(None, 1.0)
    assert E.plain_tex("the \\text{square} of 5,000") == "theof5,000" and E.plain_tex("5,000") == "5000" and E.plain_tex("\\frac12") == "\\frac{1}{2}"


def test_a_slow_step_is_cut_off():
    began = time.time()
    assert E.within(lambda a, b: time.sleep(5) or True, 0.2)("a", "b") is False and time.time() - began < 2
    assert E.within(lambda a, b: True, 0.2)("a", "b") is True


@pytest.mark.parametrize(
    "text,want",
    [
        ("final answer is $\\frac12$. I hope it is correct", ["\\frac{1}{2}"]), ("\\boxed{a{b}c} and \\boxed{50}%", ["a{b}c", "50}"]), ("The answer is: $5.$", ["5"]), ("x\n```output\n7\n```", ["7"]),
        ("so 1,234 or -5", ["-5"]), ("nothing", []), ("\\boxed{open", []), (None, None),
    ],
)
def test_cascade(spark, text, want):
    d = spark.createDataFrame([(text,)], "t string").select(N.stated_answers(F.col("t")).alias("a"), N.stated_answer(F.col("t")).alias("last")).first()
    assert (d["a"] or ([] if text else None)) == want and d["last"] == (None if text is None else want[-1] if want else "")


@pytest.mark.parametrize(
    "raw,plain",
    [
        ("\\text{cm}", "cm"), ("5 \\text{ kg}", "5"), ("\\dfrac12", "\\frac{1}{2}"), ("\\frac1{72}", "\\frac{1}{72}"), ("\\frac1", "\\frac1"), ("5\\!00.", "500"), ("90^{\\circ}", "90"), ("7 t", "7"),
        ("x\\in[0, infinity)", "[0,\\infty)"), ("inf", "\\infty"), ("2j", "2i"), ("2ij", "2ij"), ("1.00", "1"), ("1.00x", "1x"), ("\\tan x", "\\tan{x}"), ("\\sqrt 3", "\\sqrt{3}"), ("-3/4", "\\frac{-3}{4}"), ("03/4", "03/4"), ("", ""),
    ],
)
def test_plain_forms(spark, raw, plain):
    assert spark.createDataFrame([(raw,)], "t string").select(N.plain_answer(F.col("t")).alias("p")).first()["p"] == plain


def test_suffix_sums_agree_with_the_loop():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 500, 5000):
        for decay in (0.0, 0.3, 0.95, 0.9999, 1.0, 1.01):
            x, acc, want = rng.normal(size=n), 0.0, []
            if decay > 1 and n > 500:
                continue
            for v in x[::-1]:
                acc = v + decay * acc
                want.append(acc)
            assert np.allclose(A.suffix_sums(x, decay), want[::-1], rtol=1e-9, atol=1e-9)


def test_templates_keep_the_braces_of_values(spark):
    d = spark.createDataFrame([("{input} {{x}}", None)], "q string, p string")
    got = d.select(templates.rendered("{{}} {input} {prefix}|", input=F.col("q"), prefix=F.col("p")).alias("t")).first()["t"]
    assert got == "{} {input} {{x}} |"
    with pytest.raises(ValueError):
        templates.template("chatml-none")
