"""Writers: JSON lines in three escapings, resumable appends, markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def json_text(df: DataFrame) -> Column:
    return F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})


def write_jsonl(df: DataFrame, path: str, escape: str = "none", mode: str = "overwrite") -> None:
    """One object a line. escape: none; separators (U+2028, U+2029 as escapes); ascii (all but ASCII as escapes)."""
    if escape == "ascii":
        df.write.mode(mode).option("ignoreNullFields", False).option("writeNonAsciiCharacterAsCodePoint", True).json(path)
    elif escape == "separators":
        text = F.replace(F.replace(json_text(df), F.lit(" "), F.lit("\\u2028")), F.lit(" "), F.lit("\\u2029"))
        df.select(text.alias("value")).write.mode(mode).text(path)
    else:
        df.write.mode(mode).option("ignoreNullFields", False).json(path)


def portion(df: DataFrame, order: list[str], n: int = 64) -> DataFrame:
    """The first n rows in order, for a side file."""
    return df.orderBy(*order).limit(n)


def append_new(df: DataFrame, path: str, key: str, done: DataFrame | None) -> DataFrame:
    """Appends the rows whose key isn't done yet; returns them."""
    fresh = df if done is None else df.join(done.select(key).distinct(), key, "left_anti")
    fresh.write.mode("append").parquet(path)
    return fresh


def markdown(rows: list, columns: list[str]) -> str:
    """A table of a small, already aggregated result."""
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(columns), line(["---"] * len(columns)), *(line([r[c] for c in columns]) for r in rows)])


def merge_parts(spark: SparkSession, folder: str, base: str, schema: T.StructType | str) -> None:
    """base.jsonl of all base.part*.jsonl, which are deleted once it is whole."""
    from .folders import listed
    from .tables import read_jsonl

    parts = [x for x in listed(spark, folder) if x.startswith(base + ".part") and x.endswith(".jsonl")]
    if not parts:
        return
    write_jsonl(read_jsonl(spark, [f"{folder}/{x}" for x in parts], schema), f"{folder}/{base}.jsonl")
    for x in parts:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{x}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def upsert(spark: SparkSession, folder: str, rows: DataFrame, keys: list[str]) -> None:
    """Adds rows as the next version of a table of results; earlier versions stay as they are."""
    from .folders import listed

    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    exists = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    version = 1 + max((int(x.split("=")[1]) for x in listed(spark, folder) if x.startswith("version=")), default=0) if exists else 1
    rows.write.parquet(f"{folder}/version={version}")


def current(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """The newest row of each key."""
    d = spark.read.parquet(folder)
    rest = [c for c in d.columns if c not in (*keys, "version")]
    return d.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("x")).select(*keys, "x.*")


def write_scalars(rows: DataFrame, path: str, step: str, names: list[str]) -> None:
    """step, name, value: a row for each scalar of each step."""
    rows.unpivot(step, [F.col(n).cast("double").alias(n) for n in names], "name", "value").write.mode("append").parquet(path)


def write_batches(spark: SparkSession, rows: DataFrame, folder: str, number: str) -> list[int]:
    """Writes the batches (by number, a column of few values) that the folder lacks, in one job; returns their numbers."""
    from .folders import listed

    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    exists = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    done = {int(x.split("=")[1]) for x in listed(spark, folder) if x.startswith(number + "=")} if exists else set()
    fresh = rows.where(~F.col(number).isin(*done)) if done else rows
    numbers = sorted(r[0] for r in fresh.select(number).distinct().collect())
    fresh.write.mode("append").partitionBy(number).parquet(folder)
    return numbers
