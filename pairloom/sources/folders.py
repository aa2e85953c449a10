"""Folders of files as sources: ordered scans, names as columns, one folder a model, parts of one base."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .tables import read_jsonl


def listed(spark: SparkSession, folder: str) -> list[str]:
    """Names of what lies in a folder, sorted; of any file system that the session knows."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(x.getPath().getName() for x in found)


def ordered_lines(spark: SparkSession, folder: str, schema: T.StructType | str, pattern: str = "*.jsonl") -> DataFrame:
    """Rows of all files of a folder with file, the name, by which they are in lexicographic order (10 before 2)."""
    d = spark.read.schema(schema).option("recursiveFileLookup", True).option("mode", "DROPMALFORMED").json([f"{folder}/{x}" for x in listed(spark, folder) if _fits(x, pattern)])
    return d.withColumn("file", F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]*\.jsonl)(?:/|$)", 1))


def _fits(name: str, pattern: str) -> bool:
    from fnmatch import fnmatch

    return fnmatch(name, pattern)


def named_sets(spark: SparkSession, folder: str, schema: T.StructType | str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """Rows of all sets (name.jsonl) of a folder but the ignored ones, with dataset, the name."""
    names = [x for x in listed(spark, folder) if x.endswith(".jsonl") and x.removesuffix(".jsonl") not in ignore]
    d = read_jsonl(spark, [f"{folder}/{x}" for x in names], schema)
    return d.withColumn("dataset", F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]*)\.jsonl(?:/|$)", 1))


def model_folders(spark: SparkSession, root: str, schema: T.StructType | str, name: str = "generation_merged.jsonl") -> tuple[DataFrame, int]:
    """Rows of root/<model>/name with model, and the number of folders, those without the file included."""
    models = listed(spark, root)
    with_file = [m for m in models if name in listed(spark, f"{root}/{m}")]
    d = read_jsonl(spark, [f"{root}/{m}/{name}" for m in with_file], schema)
    return d.withColumn("model", F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/" + name.replace(".", r"\.") + r"(?:/|$)", 1)), len(models)


def part_files(spark: SparkSession, folder: str, base: str, schema: T.StructType | str) -> DataFrame:
    """Rows of all files base.part*.jsonl."""
    return read_jsonl(spark, f"{folder}/{base}.part*.jsonl", schema)
