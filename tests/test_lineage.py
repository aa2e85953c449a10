from pyspark.errors import AnalysisException, PySparkException

import pytest

from pairloom.plans import lineage


def test_dropped_tables_are_gone_and_others_stay(spark):
    a, b = lineage.materialise(spark.range(5), "a"), lineage.materialise(spark.range(7), "b")
    (folder,) = {f.rsplit("/", 1)[0] for f in a.inputFiles()}
    lineage.drop(a, spark.range(3))
    assert b.count() == 7
    with pytest.raises((AnalysisException, PySparkException)):
        spark.read.parquet(folder).count()
    lineage.drop(a)
