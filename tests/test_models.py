import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairloom.plans import models
from pairloom.sources import sinks
from pairloom.sources.plugin import ScriptSource
from pairloom.sources.tables import read_jsonl, read_many, read_path, split_spec


def test_score_once_calls_each_text_once(spark):
    d = spark.createDataFrame([(1, "m", "p", "aeb"), (2, "m", "p", "aeb"), (3, "n", "p", None), (4, None, None, "")], "id int, model string, prompt string, response string")
    got = {r["id"]: r["score"] for r in models.score_once(d, "model", "prompt", "response", models.stub_score).collect()}
    assert got[1] == got[2] == pytest.approx(2 / 3 + 0.01) and set(got) == {1, 2, 3, 4}


def test_retries():
    calls, waits = [], []

    def f(x):
        calls.append(x)
        if len(calls) < 3:
            raise models.Retry
        return x

    assert models.with_retries(f, pause=waits.append)(7) == 7 and waits == [1.0, 2.0]
    with pytest.raises(models.Retry):
        models.with_retries(lambda: (_ for _ in ()).throw(models.Retry()), tries=2, pause=waits.append)()
    with pytest.raises(KeyError):
        models.with_retries(lambda: {}["x"], pause=waits.append)()


def test_guarded_sends_only_the_rest(spark):
    d = spark.createDataFrame([(1, True), (2, None), (3, False)], "id int, v boolean")
    got = {r["id"]: r["ok"] for r in models.guarded(d, F.col("v"), lambda rest: rest.withColumn("ok", F.col("id") == 2), "ok").collect()}
    assert got == {1: True, 2: True, 3: False}


def test_reward_functions(spark):
    fns = models.RewardFns()
    fns.register("len", lambda q, p, l: q.str.len().astype("float64"))
    d = spark.createDataFrame([("abc", "p", "l")], "q string, p string, l string")
    assert d.select(fns.column("len", "q", "p", "l").alias("r")).first()["r"] == 3.0


def test_script_source(spark, tmp_path):
    script = tmp_path / "load.py"
    script.write_text("SCHEMA = 'part int, x string'\nPARTS = 3\ndef rows(part):\n    yield part, 'r%d' % part\n")
    spark.dataSource.register(ScriptSource)
    got = spark.read.format("script").option("path", str(script)).load().collect()
    assert sorted(map(tuple, got)) == [(0, "r0"), (1, "r1"), (2, "r2")]


def test_json_lines(spark, tmp_path):
    d = spark.createDataFrame([(1, "a b é"), (2, None)], "id bigint, t string")
    for escape in ("none", "separators", "ascii"):
        path = str(tmp_path / f"{escape}.jsonl")
        sinks.write_jsonl(d, path, escape)
        assert sorted(map(tuple, read_jsonl(spark, path, d.schema, "fail").collect())) == [(1, "a b é"), (2, None)]
    raw = "".join(r["value"] for r in spark.read.text(str(tmp_path / "ascii.jsonl")).collect())
    assert raw.isascii()
    (tmp_path / "bad.jsonl").write_text('{"id": 1, "t": "x"}\n\n{bad\n"plain string"\n')
    path = str(tmp_path / "bad.jsonl")
    assert read_jsonl(spark, path, "id bigint, t string", "drop").collect()[0]["id"] == 1
    kept = read_jsonl(spark, path, "id bigint, t string", "keep")
    assert sorted((r["id"] is None) for r in kept.select("id", "_corrupt_record").collect()) == [False, True, True]
    with pytest.raises(Exception):
        read_jsonl(spark, path, "id bigint, t string", "fail").collect()
    (tmp_path / "array.json").write_text('[{"id": 1}, {"id": 2}]')
    assert read_jsonl(spark, str(tmp_path / "array.json"), "id bigint", array=True).count() == 2


def test_paths(spark, tmp_path):
    assert split_spec("a/b@part") == ("a/b", "part") and split_spec("a/b") == ("a/b", None)
    spark.range(3).write.parquet(str(tmp_path / "all/part"))
    assert read_path(spark, f"{tmp_path}/all@part").count() == 3
    assert [x.count() for x in read_many(spark, f"{tmp_path}/all@part, {tmp_path}/all@part")] == [3, 3]


def test_append_and_markdown(spark, tmp_path):
    d = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    path = str(tmp_path / "out")
    sinks.append_new(d.where("id = 1"), path, "id", None)
    assert sinks.append_new(d, path, "id", spark.read.parquet(path)).count() <= 2
    assert spark.read.parquet(path).count() == 2
    assert sinks.markdown([{"a": 1, "b": None}], ["a", "b"]) == "| a | b |\n| --- | --- |\n| 1 |  |"
