"""Dense positions, shards and running totals without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


#: Buckets under one group: sums over all earlier buckets are taken in groups, then over the groups.
GROUP = 1000


def _offsets(counts: DataFrame, n: str) -> DataFrame:
    """bucket, before: sums over all earlier buckets, in two levels, so that a task holds GROUP buckets or the groups."""
    w = lambda *by: Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("group", F.floor(F.col("bucket").cast("bigint") / GROUP)) if not dict(counts.dtypes)["bucket"].startswith("timestamp") else counts.withColumn("group", F.date_trunc("year", "bucket"))
    groups = ranked.groupBy("group").agg(F.sum(n).alias("n"))
    g = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    above = groups.select("group", F.coalesce(F.sum("n").over(g), F.lit(0)).alias("above"))
    inner = ranked.withColumn("before", F.coalesce(F.sum(n).over(w("group")), F.lit(0)))
    return inner.join(above, "group").withColumn("before", F.col("before") + F.col("above")).drop("group", "above")


def ordinal(df: DataFrame, key: str, order: list[str] | None = None, width: int = 100_000, name: str = "ord") -> DataFrame:
    """df with name, the dense 0-based position by an integer key and then by order.

    Positions are counted in buckets of width keys and shifted by the rows of earlier buckets: the largest task holds
    one bucket. Rows of equal key and order are placed arbitrarily.
    """
    b = df.withColumn("bucket", F.floor(F.col(key) / width))
    before = _offsets(b.groupBy("bucket").agg(F.count("*").alias("n")), "n").select("bucket", "before")
    inner = F.row_number().over(Window.partitionBy("bucket").orderBy(key, *(order or []))) - 1
    return b.withColumn("inner", inner).join(before, "bucket").withColumn(name, (F.col("inner") + F.col("before")).cast("bigint")).drop("bucket", "inner", "before")


def interleaved(df: DataFrame, source: str, weight: Column, key: str, seed: int = 42, buckets: int = 64) -> DataFrame:
    """df with w, place: a source's k-th row in a seeded order stands at k / weight. Sources are ranked in hash buckets."""
    d = df.withColumns({"h": F.xxhash64(F.lit(seed), key), "w": weight}).withColumn("b", F.pmod("h", F.lit(buckets)))
    counts = d.groupBy(source, "b").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy(source).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    k = d.withColumn("k", F.row_number().over(Window.partitionBy(source, "b").orderBy("h", key))).join(before.select(source, "b", "before"), [source, "b"])
    return k.withColumn("place", (F.col("k") + F.col("before")) / F.col("w")).drop("h", "b", "k", "before")


def running_total(df: DataFrame, bucket: Column, order: list[str], value: str, name: str) -> DataFrame:
    """df with name, the sum of value over all rows up to this one in order; bucket is a coarsening of the order."""
    b = df.withColumn("bucket", bucket)
    before = _offsets(b.groupBy("bucket").agg(F.sum(value).alias("n")), "n").select("bucket", "before")
    inner = F.sum(value).over(Window.partitionBy("bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return b.withColumn("inner", inner).join(before, "bucket").withColumn(name, F.col("inner") + F.col("before")).drop("bucket", "inner", "before")


def ntile_shard(ord_: Column, n: Column, shards: int) -> Column:
    """Contiguous shards; the first n % shards have one row more."""
    small, more = F.floor(n / shards), n % shards
    cut = more * (small + 1)
    return F.when(ord_ < cut, F.floor(ord_ / (small + 1))).otherwise(more + F.floor((ord_ - cut) / F.greatest(small, F.lit(1)))).cast("int")


def chunk_shard(ord_: Column, n: Column, shards: int) -> Column:
    """Contiguous shards of ceil(n / shards) rows."""
    return F.floor(ord_ / F.ceil(n / shards)).cast("int")


def batch_of(ord_: Column, n: Column, size: int) -> Column:
    """Batches of size rows, the last taking the remainder; fewer rows than size are one batch."""
    return F.least(F.floor(ord_ / size), F.greatest(F.floor(n / size) - 1, F.lit(0))).cast("bigint")


def with_count(df: DataFrame, name: str = "n") -> DataFrame:
    """df with its number of rows: one aggregate, one broadcast row."""
    return df.crossJoin(F.broadcast(df.agg(F.count("*").alias(name))))


def sampler(df: DataFrame, ord_: str, replicas: int, drop_last: bool = False) -> DataFrame:
    """df with replica and step: positions dealt in turn, padded by wrapping round or cut to a multiple of replicas."""
    d = with_count(df, "__n")
    o, n = F.col(ord_), F.col("__n")
    if drop_last:
        each = F.floor(n / replicas)
        dealt = d.where(o < each * replicas).withColumn("__p", o)
    else:
        total = F.ceil(n / replicas) * replicas
        turns = F.sequence(F.lit(0), F.floor((total - 1 - o) / n))
        dealt = d.withColumn("__k", F.explode(turns)).withColumn("__p", o + F.col("__k") * n)
    return dealt.withColumn("replica", (F.col("__p") % replicas).cast("int")).withColumn("step", F.floor(F.col("__p") / replicas)).drop("__n", "__p", "__k")
