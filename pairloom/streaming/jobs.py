"""Structured Streaming jobs over files: windows with a watermark, idempotent resumption."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _stream(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.read.parquet(path).schema
    # a stream reads a folder; a single file is named by its folder and a filter
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder) if _is_file(spark, path) else spark.readStream.schema(schema).parquet(path)


def _is_file(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


def window_totals(spark: SparkSession, path: str, folder: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """start, event_type, n, total: hourly sums of a stream, upserted batch by batch; rows later than late are dropped."""
    events = _stream(spark, path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    sums = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    out = sums.select(F.col("w.start").alias("start"), "event_type", "n", "total")

    def put(batch: DataFrame, number: int) -> None:
        # a batch that runs again writes the same folder
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    q = out.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(f"{folder}/out")
    return got.groupBy("start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("x")).select("start", "event_type", "x.n", "x.total")


def resumed(spark: SparkSession, path: str, key: list[str], folder: str) -> DataFrame:
    """The keys of a stream, each written once however often its rows come and the job is started."""

    def put(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(key).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    for _ in range(2):  # the second start finds nothing new
        d = _stream(spark, path).select(*key)
        q = d.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(*key).distinct()


def fifo(spark: SparkSession, path: str, key: str, order: str, limit: int, folder: str) -> DataFrame:
    """key, order: the last limit values of order of each key of a stream, in a bounded state that evicts the oldest."""

    def keep(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        xs = list(state.get[0]) if state.exists else []
        for pdf in batches:
            xs = sorted([*xs, *pdf["o"].tolist()])[-limit:]
        state.update((xs,))
        yield pd.DataFrame({"k": [k[0]], "xs": [xs]})

    d = _stream(spark, path).select(F.col(key).cast("bigint").alias("k"), F.col(order).cast("bigint").alias("o"))
    kept = d.groupBy("k").applyInPandasWithState(keep, "k bigint, xs array<bigint>", "xs array<bigint>", "update", GroupStateTimeout.NoTimeout)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    q = kept.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.read.parquet(f"{folder}/out").groupBy("k").agg(F.max_by("xs", "batch").alias("xs"))
    return last.select(F.col("k").alias(key), F.explode("xs").alias(order))


def step_metrics(spark: SparkSession, path: str, step: Column, folder: str, value: str = "value") -> DataFrame:
    """step, n, loss: counts and means of each step of a stream, the latest state of each."""
    sums = _stream(spark, path).groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.avg(value).alias("loss"))

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    q = sums.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(f"{folder}/out")
    return got.groupBy("step").agg(F.max_by(F.struct("n", "loss"), "batch").alias("x")).select("step", "x.n", "x.loss")


def barrier(spark: SparkSession, path: str, rank: Column, answer: Callable[[DataFrame, int], DataFrame], folder: str) -> DataFrame:
    """All rows of a micro-batch answered in one call that knows their number, and written back under their ranks."""

    def put(batch: DataFrame, number: int) -> None:
        whole = batch.withColumn("rank", rank)
        answer(whole, whole.count()).write.mode("overwrite").partitionBy("rank").parquet(f"{folder}/out/batch={number}")

    q = _stream(spark, path).writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("batch").withColumn("rank", F.col("rank").cast("bigint"))
