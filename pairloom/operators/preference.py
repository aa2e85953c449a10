"""Rewards and answers into preference pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _extreme(df: DataFrame, prompt: str, output: str, reward: str, ord_: str, least: bool) -> DataFrame:
    """prompt, output, reward of each prompt's highest (or lowest) reward, the first of equals.

    Spark cuts every group to its first row before and after the shuffle (window group limit), so a hot prompt sends
    one row a task and nothing is sorted by struct.
    """
    by = F.col(reward).asc_nulls_last() if least else F.col(reward).desc_nulls_last()
    rn = F.row_number().over(Window.partitionBy(prompt).orderBy(by, F.col(ord_)))
    return df.withColumn("__rn", rn).where("__rn = 1").select(prompt, output, reward)


def best_of_n(df: DataFrame, prompt: str, output: str, reward: str, ord_: str) -> DataFrame:
    """The output of the highest reward of each prompt; the first of equals."""
    return _extreme(df, prompt, output, reward, ord_, False)


def best_and_worst(df: DataFrame, prompt: str, output: str, reward: str, ord_: str) -> DataFrame:
    """chosen and rejected with their rewards: first argmax and first argmin; a lone output is both."""
    hi = _extreme(df, prompt, output, reward, ord_, False).toDF(prompt, "chosen", "chosen_reward")
    lo = _extreme(df, prompt, output, reward, ord_, True).toDF(prompt, "rejected", "rejected_reward")
    return hi.join(lo, prompt)


def conditional(df: DataFrame, text: str, reward: str, name: str = "text", template: str = "<rm_score>: {reward} ", places: int = 2) -> DataFrame:
    """df with name: text, then the reward in a template, stripped and followed by a blank."""
    from ..functions.text import fixed, strip_all

    suffix = strip_all(F.replace(F.lit(template), F.lit("{reward}"), fixed(F.col(reward), places)))
    return df.withColumn(name, F.concat(F.col(text), F.lit(" "), suffix, F.lit(" ")))


def zscore(df: DataFrame, value: str, name: str) -> DataFrame:
    """value less its mean over its sample deviation; one aggregate row is broadcast. Null for a single row."""
    s = df.agg(F.avg(value).alias("__m"), F.stddev_samp(value).alias("__s"))
    return df.crossJoin(F.broadcast(s)).withColumn(name, F.try_divide(F.col(value) - F.col("__m"), F.col("__s"))).drop("__m", "__s")


def answer_pairs(rows: DataFrame) -> DataFrame:
    """Right x wrong responses of each row of (responses array<struct<text, gold_answer, is_correct>>, other columns).

    A row needs one gold answer and both kinds; the product is made inside the row, so it needs no shuffle.
    """
    side = lambda v: F.filter("responses", lambda r: r["is_correct"] == v)
    one = F.size(F.array_distinct(F.transform("responses", lambda r: F.coalesce(r["gold_answer"], F.lit("\u0000"))))) == 1
    pos = rows.where(one).withColumn("pos", side(True)).withColumn("neg", side(False)).where("size(pos) > 0 and size(neg) > 0")
    return pos.withColumn("p", F.explode("pos")).withColumn("m", F.explode("neg")).drop("pos", "neg", "responses").withColumnsRenamed({"p": "positive", "m": "negative"})


def top_k(df: DataFrame, by: list[str], score: str, ord_: str, k: int) -> DataFrame:
    """The k best of each group with rn; a missing score ranks last, ties by ord. Spark cuts groups before the shuffle."""
    rn = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(score).desc_nulls_last(), F.col(ord_).asc()))
    return df.withColumn("rn", rn).where(F.col("rn") <= k)


def top_k_pairs(chosen: DataFrame, rejected: DataFrame, prompt: str, output: str, score: str, ord_: str, k: int = 2) -> DataFrame:
    c = top_k(chosen, [prompt], score, ord_, k).select(prompt, F.col(output).alias("chosen"))
    r = top_k(rejected, [prompt], score, ord_, k).select(prompt, F.col(output).alias("rejected"))
    return c.join(r, prompt)


def intra_set_pairs(df: DataFrame, by: list[str], output: str, score: str, ord_: str) -> DataFrame:
    """Second under first within each group's top two, where there are two. One pass: no self-join."""
    t = top_k(df, by, score, ord_, 2)
    pick = lambda k: F.max(F.when(F.col("rn") == k, F.col(output)))
    return t.groupBy(*by).agg(pick(1).alias("chosen"), pick(2).alias("rejected")).where("rejected is not null")


def strict_pairs(df: DataFrame, by: list[str], output: str, score: str, ord_: str, k: int = 6) -> DataFrame:
    """All pairs of unequal score within each group's top k. At most k (k - 1) / 2 a group."""
    t = top_k(df, by, score, ord_, k)
    g = t.groupBy(*by).agg(F.collect_list(F.struct(F.col(score).alias("s"), F.col(output).alias("o"))).alias("xs"))
    return g.withColumn("a", F.explode("xs")).withColumn("b", F.explode("xs")).where("a.s > b.s").select(*by, F.col("a.o").alias("chosen"), F.col("b.o").alias("rejected"))


def last_by_model(df: DataFrame, prompt: str, model: str, at: list[str]) -> DataFrame:
    """The last row written of each (prompt, model)."""
    cols = [c for c in df.columns if c not in (prompt, model)]
    return df.groupBy(prompt, model).agg(F.max_by(F.struct(*cols), F.struct(*at)).alias("x")).select(prompt, model, "x.*")


def complete(df: DataFrame, prompt: str, model: str, needed: list[str]) -> DataFrame:
    """The rows of the needed models, of prompts that have all of them."""
    own = df.where(F.col(model).isin(needed))
    full = own.groupBy(prompt).agg(F.countDistinct(model).alias("n")).where(F.col("n") == len(set(needed))).select(prompt)
    return own.join(full, prompt, "left_semi")


def binarise(df: DataFrame, prompt: str, model: str, rating: str) -> DataFrame:
    """Per prompt the best model and the one by name first among those below it, where ratings differ; nulls don't count."""
    g = df.where(F.col(rating).isNotNull()).groupBy(prompt).agg(F.collect_list(F.struct(F.col(rating).alias("r"), F.col(model).alias("m"))).alias("xs"), F.max(rating).alias("hi"), F.min(rating).alias("lo"))
    pick = lambda keep: F.array_min(F.transform(F.filter("xs", keep), lambda x: x["m"]))
    return g.where("hi > lo").select(prompt, pick(lambda x: x["r"] == F.col("hi")).alias("chosen_model"), pick(lambda x: x["r"] < F.col("hi")).alias("rejected_model"), F.col("hi").alias("chosen_rating"))


def unpair(df: DataFrame, keep: list[str]) -> DataFrame:
    """chosen rows with label 1 and rejected rows with label 0."""
    return df.select(*keep, F.explode(F.array(F.struct(F.col("chosen").alias("response"), F.lit(1).alias("label")), F.struct(F.col("rejected").alias("response"), F.lit(0).alias("label")))).alias("x")).select(*keep, "x.response", "x.label")


def rotated(df: DataFrame, batch: str, ord_: str, response: str, name: str) -> DataFrame:
    """df with name, the response of the next row of the batch, the last taking the first's."""
    w = Window.partitionBy(batch).orderBy(ord_)
    first = F.first(response).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    last = F.row_number().over(w) == F.count("*").over(Window.partitionBy(batch))
    return df.withColumn(name, F.when(last, first).otherwise(F.lead(response).over(w)))


def seeded_pick(values: Column, seed: int, *key: str) -> Column:
    """One of an array by a hash of seed and key: the same for every run and partitioning."""
    return F.element_at(values, (F.pmod(F.xxhash64(F.lit(seed), *key), F.size(values)) + 1).cast("int"))


def shaped_rewards(df: DataFrame, prompt: str, reward: str) -> DataFrame:
    """df with rloo (leave-one-out), centred (less the mean) and normed (over sample deviation + 1e-9)."""
    w = Window.partitionBy(prompt)
    r, n, s, m, d = F.col(reward), F.count(reward).over(w), F.sum(reward).over(w), F.avg(reward).over(w), F.stddev_samp(reward).over(w)
    return df.withColumns({"rloo": F.when(n > 1, r - F.try_divide(s - r, n - 1)), "centred": r - m, "normed": F.when(n > 1, (r - m) / (d + 1e-9))})
