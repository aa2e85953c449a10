"""Readers: by extension, by path list, JSON lines under a line policy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: What to do with a line that is no record.
POLICIES = {"drop": "DROPMALFORMED", "keep": "PERMISSIVE", "fail": "FAILFAST"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def split_spec(spec: str) -> tuple[str, str | None]:
    """path@data_dir -> (path, data_dir)."""
    path, _, sub = spec.strip().partition("@")
    return path, sub or None


def read_path(spark: SparkSession, spec: str, schema: T.StructType | str | None = None, policy: str = "drop") -> DataFrame:
    """One source by its extension: json, jsonl, csv, parquet, orc, or a folder of parquet files."""
    path, sub = split_spec(spec)
    path = f"{path}/{sub}" if sub else path
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind in ("json", "jsonl"):
        return read_jsonl(spark, path, schema, policy)
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind == "csv":
        return reader.option("header", True).csv(path)
    return reader.orc(path) if kind == "orc" else reader.parquet(path)


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None, policy: str = "drop", array: bool = False) -> DataFrame:
    """JSON lines (or one array a file) under a policy for lines that are no objects: drop, keep (as _corrupt_record), fail."""
    reader = spark.read.option("mode", POLICIES[policy]).option("multiLine", array)
    if schema is not None:
        if isinstance(schema, str):
            schema = T._parse_datatype_string(schema)
        if policy == "keep" and "_corrupt_record" not in schema.names:
            schema = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
        reader = reader.schema(schema)
    return reader.json(path)


def file_stem(df: DataFrame, suffix: str = "") -> DataFrame:
    """df with dataset, the stem of the file that each row came from."""
    return df.withColumn("dataset", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)" + suffix + r"\.\w+$", 1))


def read_many(spark: SparkSession, specs: str, schema: T.StructType | str | None = None) -> list[DataFrame]:
    """A comma list of sources; one source is a list of one."""
    return [read_path(spark, x, schema) for x in specs.split(",") if x.strip()]


def concat(frames: list[DataFrame]) -> DataFrame:
    return frames[0] if len(frames) == 1 else reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
