"""Evaluation metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def pass_at_k(df: DataFrame, source: str, prompt: str, correct: str) -> DataFrame:
    """Per source: mean over prompts of the best and of the mean outcome; null outcomes don't count."""
    x = F.col(correct).cast("int")
    p = df.where(F.col(correct).isNotNull()).groupBy(source, prompt).agg(F.max(x).alias("best"), F.avg(x).alias("mean"))
    return p.groupBy(source).agg(F.round(F.avg("best"), 6).alias("pass_at_k"), F.round(F.avg("mean"), 6).alias("pass_at_1"), F.count("*").alias("prompts"))


def majority(df: DataFrame, key: str, answer: str, ord_: str) -> DataFrame:
    """key, answer, votes: the most frequent answer, of equals the one seen first. Nulls don't vote."""
    v = df.where(F.col(answer).isNotNull()).groupBy(key, F.col(answer).alias("answer")).agg(F.count("*").alias("votes"), F.min(ord_).alias("first"))
    # the group limit of Spark keeps one answer a key on either side of the shuffle
    rn = F.row_number().over(Window.partitionBy(key).orderBy(F.col("votes").desc(), "first"))
    return v.withColumn("__rn", rn).where("__rn = 1").select(key, "answer", "votes")


def pair_accuracy(df: DataFrame, chosen: str, rejected: str, batch: str) -> DataFrame:
    """Share of chosen over rejected by row and as a mean of batch means; mean and deviation of all scores."""
    win = (F.col(chosen) > F.col(rejected)).cast("int")
    by_row = df.agg(F.round(F.avg(win), 6).alias("by_row"))
    by_batch = df.groupBy(batch).agg(F.avg(win).alias("a")).agg(F.round(F.avg("a"), 6).alias("by_batch"))
    both = df.select(F.explode(F.array(chosen, rejected)).alias("x")).agg(F.round(F.avg("x"), 6).alias("score_mean"), F.round(F.greatest(F.stddev_samp("x"), F.lit(1e-8)), 6).alias("score_std"))
    return by_row.crossJoin(by_batch).crossJoin(both)  # one row each


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """bin (from 0), n, density; values outside are dropped, the upper edge belongs to the last bin."""
    width = (high - low) / bins
    x = F.col(value)
    b = F.when(x == high, F.lit(bins - 1)).otherwise(F.floor((x - low) / width).cast("int"))
    g = df.where((x >= low) & (x <= high)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    return g.withColumn("density", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))) / width, 6))  # a row a bin


def masked_normalise(df: DataFrame, value: str, mask: str, name: str) -> DataFrame:
    """value less sum / number masked in, over the root of the masked population variance, at least 1e-8."""
    n = F.count_if(mask)
    mean = df.agg((F.sum(value) / n).alias("__m"))
    d = df.crossJoin(F.broadcast(mean))
    gap = F.col(value) - F.col("__m")
    var = d.agg((F.sum(F.when(F.col(mask), gap * gap)) / F.count_if(mask)).alias("__v"))
    return d.crossJoin(F.broadcast(var)).withColumn(name, gap / F.sqrt(F.greatest("__v", F.lit(1e-8)))).drop("__m", "__v")


def adaptive_coefficient(df: DataFrame, step: str, current: str, n: str, start: float, target: float, horizon: int) -> DataFrame:
    """df with coef: start times the factors 1 + clip(current / target - 1, 0.2) n / horizon of all steps so far."""
    factor = 1 + F.least(F.greatest(F.col(current) / target - 1, F.lit(-0.2)), F.lit(0.2)) * F.col(n) / horizon
    return df.withColumn("coef", start * F.exp(F.sum(F.ln(factor)).over(Window.orderBy(step).rowsBetween(Window.unboundedPreceding, 0))))
