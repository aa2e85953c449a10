"""Results that the oracles don't reach."""

from pairloom import catalog


def test_pivot_has_every_benchmark(spark, tmp_path):
    names = ["tarn24", "ostrel_hard", "polyset", "aft", "quarry_mini"]
    spark.createDataFrame([(k, x) for k, x in enumerate(names)], "item_id bigint, benchmark string").write.parquet(f"{tmp_path}/benchmark_item.parquet")
    log = [("m", k, k % 2 == 0) for k in range(len(names))] + [("m", 1, True), ("n", 3, True)]
    spark.createDataFrame(log, "model string, data_id bigint, is_correct boolean").write.parquet(f"{tmp_path}/eval_log.parquet")
    df = catalog.queries()["results_pivot"](spark, str(tmp_path))
    assert df.columns == ["model", "aft", "ostrel_hard", "polyset", "quarry_mini", "tarn24"]
    got = {r[0]: tuple(r)[1:] for r in df.collect()}
    assert got == {"m": (0.0, 0.5, 1.0, 1.0, 1.0), "n": (1.0, None, None, None, None)}
