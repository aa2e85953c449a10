import pytest
from pyspark.sql import functions as F

from pairloom.llm import copies

SCHEMA = "pair_id bigint, prompt string, chosen string, rejected string"
BASE = ("Solve: what is 4 - 2?", 'It is 4.5, so "yes"; done.', '{"a": "5 × 3", "b": [1, 2]}')


def classes(spark, rows):
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA).withColumn("id", F.lit(1)).withColumn("n", F.lit("x")).withColumn("copies", F.lit(0))
    return {r["pair_id"]: (r["keep_id"], r["copies"]) for r in copies.formatting_copies(d).collect()}, d


@pytest.mark.parametrize(
    "other,same",
    [
        (("SOLVE   what is\n4 - 2", "it is 4.5; so yes. Done", '{"b": [1,2], "a": "5 \\u00d7 3"}'), True),
        (("Solve:​ what is 4 - 2?", BASE[1], '{\n "b": [1, 2],\n "a": "5 × 3"\n}'), True),
        ((BASE[0], "It is 45, so yes done", BASE[2]), False),
        ((BASE[0], "It is -4.5, so yes; done.", BASE[2]), False),
        (("Solve: what is 4 + 2?", BASE[1], BASE[2]), False),
        ((BASE[0], BASE[1], '{"a": "5 × 3", "b": [2, 1]}'), False),
        ((BASE[0], BASE[1], None), False),
        ((BASE[0], BASE[1].replace("4.5", "4,5"), BASE[2]), False),
        ((BASE[0], "**It is** 4.5 so 'yes' - done", BASE[2]), True),
        ((BASE[0], "- It is 4.5 so yes done", BASE[2]), True),
    ],
)
def test_pairs(spark, other, same):
    got, _ = classes(spark, [BASE, other])
    assert got == ({0: (0, 2), 1: (0, 2)} if same else {})


def test_nulls_blanks_and_repeats(spark):
    got, d = classes(spark, [(None, None, None), (None, None, None), ("", None, None), (" ", None, None), BASE, ("x" * 100_000, "y", None), ("X" * 100_000, "y!", None)])
    assert got == {0: (0, 2), 1: (0, 2), 2: (2, 2), 3: (2, 2), 5: (5, 2), 6: (5, 2)}
    kept = {r["pair_id"]: r["copies"] for r in copies.collapse(d).collect()}
    assert kept == {0: 2, 2: 2, 4: 1, 5: 2}


def test_a_class_of_a_third_of_all_rows(spark):
    d = spark.range(60_000).select(F.col("id").alias("pair_id"), F.when(F.col("id") % 3 == 0, "Same, text").otherwise(F.concat(F.lit("text "), "id")).alias("prompt"), F.lit(None).cast("string").alias("chosen"), F.lit("a").alias("rejected"))
    got = copies.formatting_copies(d, salts=4)
    assert got.agg(F.count("*"), F.min("keep_id"), F.max("keep_id"), F.min("copies")).first() == (20_000, 0, 0, 20_000)


def test_collapse_keeps_one_row_of_repeated_and_null_keys(spark):
    d = spark.createDataFrame([(5, *BASE), (5, *BASE), (5, "other", None, None), (None, "SOLVE what is 4 - 2", BASE[1], BASE[2]), (None, "lone", "a", "b"), (None, "Lone!", "a", "b")], SCHEMA).withColumn("n", F.lit("kept"))
    got = sorted((r["pair_id"] or 0, r["prompt"].lower().strip("!"), r["copies"], r["n"]) for r in copies.collapse(d).collect())
    assert got == [(0, "lone", 2, "kept"), (5, "other", 1, "kept"), (5, BASE[0].lower(), 3, "kept")]
    assert sorted((r["pair_id"] or 0, r["copies"]) for r in copies.formatting_copies(d).collect()) == [(0, 2), (0, 2), (0, 3), (5, 3), (5, 3)]


def test_empty(spark):
    assert copies.formatting_copies(spark.createDataFrame([], SCHEMA)).count() == 0
    assert copies.collapse(spark.createDataFrame([], SCHEMA)).count() == 0
