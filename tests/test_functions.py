"""Micro-fixtures worked out by hand, and plain Python twins of the array functions."""

import math

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pairloom.functions import answers as N, arrays as A, equality as E, symbolic, text as T
from pairloom.operators import order, preference as P
from pairloom.plans.registry import Transforms


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "text,expected",
    [("The answer is: 3.14", "3"), ("The answer is: '42'.", "42"), ("so \\boxed{{7}}", "7"), ("The answer is: 7\nThe answer is: 8", "8"), ("nothing", None), (None, None), ("", None)],
)
def test_last_answer(spark, text, expected):
    assert one(spark, text, T.last_answer) == expected


def test_all_answers(spark):
    assert one(spark, "The answer is: 7\nThe answer is: 8\n\\boxed{7}", T.all_answers) == ["7", "8"]
    assert one(spark, "none", T.all_answers) is None


@pytest.mark.parametrize("text,expected", [("4.5", 4), ("3/5", 3), ("N/A", None), ("9", 5), ("0", 1)])
def test_ratings(spark, text, expected):
    assert one(spark, f"#### Output for Text 1\nRating: {text}\n", T.ratings) == [expected]


@pytest.mark.parametrize("a,b,same", [("1000000", "1000001", True), ("a b", "ab", True), ("1_000", "1000", True), ("5d", "5", False), ("x", None, False), ("2", "3", False)])
def test_answer_equal(spark, a, b, same):
    d = spark.createDataFrame([(a, b)], "a string, b string")
    assert d.select(T.answer_equal(F.col("a"), F.col("b")).alias("y")).first()["y"] is same


def test_math_equal(spark):
    d = spark.createDataFrame([("50", "0.5", True), ("7", "7.0005", True), ("7", "8", False), ("1,200", "1200", True), ("50%", "0.5", True)], "a string, b string, want boolean")
    assert all(r["y"] == r["want"] for r in d.select(T.math_equal(F.col("a"), F.col("b")).alias("y"), "want").collect())


@pytest.mark.parametrize("raw,plain", [("\\frac12", "\\frac{1}{2}"), ("3/4", "\\frac{3}{4}"), ("$2224$", "2224"), ("1152.0", "1152"), (".5", "0.5"), ("50\\%", "50%"), ("90^\\circ", "90"), ("\\sqrt3", "\\sqrt{3}"), (None, None)])
def test_plain_answer(spark, raw, plain):
    assert one(spark, raw, N.plain_answer) == plain


def test_balanced_boxed(spark):
    got = spark.createDataFrame([("a \\boxed{\\frac{1}{2^{3}}} b \\boxed{x} \\boxed{open",), (None,)], "x string").select(T.balanced_boxed("x").alias("y")).collect()
    assert [r["y"] for r in got] == [["\\frac{1}{2^{3}}", "x"], None]
    got = spark.createDataFrame([("(1, 2], 3; {4, 5}",)], "x string").select(T.split_outside_brackets("x").alias("y")).first()["y"]
    assert got == ["(1, 2]", "3", "{4, 5}"]


def test_retemplate_raises(spark):
    d = spark.createDataFrame([("pre body post",)], "x string")
    assert d.select(T.retemplated(F.col("x"), "pre ", " post", "[{input}]").alias("y")).first()["y"] == "[body]"
    with pytest.raises(Exception, match="doesn't fit"):
        d.select(T.retemplated(F.col("x"), "other ", " post", "[{input}]").alias("y")).collect()


def test_strip_tokens(spark):
    assert one(spark, "<p><p>a<p>b<p>", lambda x: T.strip_tokens(x, "<p>")) == "a<p>b"


def plain_regret(p, gap):
    n = len(p)
    return sum(p[t] - sum(gap[t:]) / (n - t) for t in range(n)) / n


def test_regret_fixtures(spark):
    d = spark.createDataFrame([([-1.0, -2.0], [-0.5, -1.0])], "p array<double>, q array<double>")
    gap = F.zip_with("q", "p", lambda q_item, p_item: q_item - p_item)
    r = d.select(A.regret("p", gap).alias("a"), A.regret("p", F.transform("p", lambda item: -item)).alias("b")).first()
    assert r["a"] == pytest.approx(-2.375) and r["b"] == pytest.approx(-3.25)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.floats(-5, 5), min_size=1, max_size=60), min_size=1, max_size=20))
def test_regret_equals_its_definition(spark, xs):
    d = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, p array<double>")
    got = {r["i"]: r["s"] for r in d.select("i", A.regret("p", F.transform("p", lambda item: item * 0.5)).alias("s")).collect()}
    for i, x in enumerate(xs):
        assert got[i] == pytest.approx(plain_regret(x, [v * 0.5 for v in x]), abs=1e-8)


def test_gae_and_returns(spark):
    d = spark.createDataFrame([([1.0, 0.0, 2.0], [0.5, 0.2, 0.1])], "r array<double>, v array<double>")
    r = d.select(A.gae("r", "v", F.lit(0.99), F.lit(0.95)).alias("a"), A.discounted_returns("r", F.lit(0.9)).alias("g")).first()
    assert r["a"] == pytest.approx([2.283636, 1.685950, 1.9], abs=1e-6)
    assert r["g"] == pytest.approx([2.62, 1.8, 2.0])


def test_kl_and_losses(spark):
    d = spark.createDataFrame([([0.1], [0.0], [0.6, 0.3], [0.5, 0.2])], "a array<double>, b array<double>, p array<double>, q array<double>")
    r = d.select(*[F.get(A.approx_kl("a", "b", k), F.lit(0)).alias(k) for k in ("k1", "k2", "k3")], A.topk_kl(F.col("p"), F.col("q"), 10).alias("t"), (-A.log_sigmoid(F.lit(0.2))).alias("dpo")).first()
    assert (r["k1"], r["k2"], r["k3"]) == pytest.approx((0.1, 0.005, 0.004837418))
    assert r["t"] == pytest.approx(0.121171, abs=1e-5) and r["dpo"] == pytest.approx(0.598139, abs=1e-6)


def test_shaped_rewards(spark):
    d = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 6.0), (2, 4.0)], "p int, r double")
    got = {r["r"]: r for r in P.shaped_rewards(d, "p", "r").collect()}
    assert [got[x]["rloo"] for x in (1.0, 2.0, 6.0)] == pytest.approx([-3.0, -1.5, 4.5])
    assert [got[x]["normed"] for x in (1.0, 2.0, 6.0)] == pytest.approx([-0.755929, -0.377964, 1.133893], abs=1e-6)
    assert got[4.0]["rloo"] is None


def test_best_of_n_ties(spark):
    d = spark.createDataFrame([("p", "a", 1.0, 0), ("p", "b", 2.0, 1), ("p", "c", 2.0, 2), ("q", "d", 1.0, 3)], "p string, o string, r double, ord int")
    assert {tuple(r) for r in P.best_of_n(d, "p", "o", "r", "ord").collect()} == {("p", "b", 2.0), ("q", "d", 1.0)}
    assert {tuple(r) for r in P.best_and_worst(d, "p", "o", "r", "ord").collect()} == {("p", "b", 2.0, "a", 1.0), ("q", "d", 1.0, "d", 1.0)}


def test_rotation(spark):
    d = spark.createDataFrame([(0, i, f"r{i}") for i in range(3)], "b int, o int, r string")
    assert [r["u"] for r in P.rotated(d, "b", "o", "r", "u").orderBy("o").collect()] == ["r1", "r2", "r0"]


def test_shards(spark):
    d = order.with_count(spark.range(11).withColumnRenamed("id", "ord"))
    got = d.select(order.ntile_shard(F.col("ord"), F.col("n"), 4).alias("s")).groupBy("s").count().orderBy("s").collect()
    assert [r["count"] for r in got] == [3, 3, 3, 2]
    d = order.with_count(spark.range(10).withColumnRenamed("id", "ord"))
    assert [r["count"] for r in d.select(order.chunk_shard(F.col("ord"), F.col("n"), 4).alias("s")).groupBy("s").count().orderBy("s").collect()] == [3, 3, 3, 1]
    assert [r["count"] for r in d.select(order.batch_of(F.col("ord"), F.col("n"), 4).alias("s")).groupBy("s").count().orderBy("s").collect()] == [4, 6]


@pytest.mark.parametrize("drop,expected", [(False, [[0, 4, 8], [1, 5, 9], [2, 6, 0], [3, 7, 1]]), (True, [[0, 4], [1, 5], [2, 6], [3, 7]])])
def test_sampler(spark, drop, expected):
    d = order.sampler(spark.range(10).withColumnRenamed("id", "ord"), "ord", 4, drop)
    got = d.orderBy("replica", "step").collect()
    assert [[r["ord"] for r in got if r["replica"] == k] for k in range(4)] == expected


def test_ordinal_is_dense(spark):
    d = spark.createDataFrame([(k,) for k in (5, 999, 1000, 1001, 70_000, 3)], "k bigint")
    got = {r["k"]: r["ord"] for r in order.ordinal(d, "k", width=1000).collect()}
    assert got == {3: 0, 5: 1, 999: 2, 1000: 3, 1001: 4, 70_000: 5}


def test_unknown_transform(spark):
    with pytest.raises(ValueError, match="unknown transform"):
        Transforms().apply("none", spark.range(1))


def test_zscore_of_one_row_is_null(spark):
    assert P.zscore(spark.createDataFrame([(1.0,)], "r double"), "r", "z").first()["z"] is None
    assert sorted(r["z"] for r in P.zscore(spark.createDataFrame([(1.0,), (3.0,)], "r double"), "r", "z").collect()) == pytest.approx([-math.sqrt(0.5), math.sqrt(0.5)])


def test_empty_tables(spark):
    e = spark.createDataFrame([], "p string, o string, r double, ord int")
    assert P.best_of_n(e, "p", "o", "r", "ord").count() == 0
    assert P.shaped_rewards(e, "p", "r").count() == 0
    assert order.ordinal(spark.createDataFrame([], "k bigint"), "k").count() == 0
