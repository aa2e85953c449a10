"""The pN_ queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import copies, defects, leakage, packing, related, same_question, sentences


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return related.related_records(_t(spark, sf, "repo_train"), _t(spark, sf, "contest")).where("members > 1").select("pair_id", "lead_data_id")


def p1_splits(spark: SparkSession, sf: str) -> DataFrame:
    return related.assign_splits(related.related_records(_t(spark, sf, "repo_train"), _t(spark, sf, "contest"))).select("pair_id", "split")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return defects.defective_pairs(_t(spark, sf, "repo_train")).where("defect = 'truncated'").select("pair_id", "field_name")


def p2_report(spark: SparkSession, sf: str) -> DataFrame:
    return defects.truncation_report(_t(spark, sf, "repo_train"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    found = same_question.cross_split_overlaps(_t(spark, sf, "repo_train"), _t(spark, sf, "contest"))
    return found.select(F.least("train_id", "eval_id").alias("pair_id_a"), F.greatest("train_id", "eval_id").alias("pair_id_b"))


def p3_overlap_report(spark: SparkSession, sf: str) -> DataFrame:
    return same_question.Overlaps(_t(spark, sf, "repo_train"), _t(spark, sf, "contest")).report()


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return copies.formatting_copies(_t(spark, sf, "repo_train")).where("pair_id <> keep_id").select("keep_id", "pair_id")


def p4_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    return copies.collapse(_t(spark, sf, "repo_train").select("pair_id", "prompt", "chosen", "rejected")).select("pair_id", "copies")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return defects.defective_pairs(_t(spark, sf, "repo_train")).select("pair_id", "field_name", "defect")


def p6_packed(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_texts(_t(spark, sf, "documents"))


def p6_fill(spark: SparkSession, sf: str) -> DataFrame:
    used = p6_packed(spark, sf).groupBy("container").agg(F.sum("tokens").alias("tokens"))
    return used.agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), (F.sum("tokens") / (F.count("*") * packing.CAPACITY)).alias("fill"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaked_items(_t(spark, sf, "documents"), _t(spark, sf, "benchmark_item")).select("doc_id", "item_id")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.sentence_units(_t(spark, sf, "documents")).select("doc_id", "end_pos")


def p8_units(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.sentence_units(_t(spark, sf, "documents"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {}
