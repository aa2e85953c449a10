"""Enough tasks for a Python step over a small table."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: A table of fewer files than cores is dealt out anew only up to this size; a larger one has parts enough.
MOST_BYTES = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """df with a partition a core if it comes from fewer files and is small, else as it is. Nothing is run to tell."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if len(df._jdf.inputFiles()) >= cores:
        return df
    if int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) > MOST_BYTES:
        return df
    return df.repartition(cores)
