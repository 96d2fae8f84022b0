import time

import pytest
from pyspark.sql import functions as F

from textsentry.session import materialise


def _shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = manager.getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_shuffle_files_of_a_written_step_go_at_once(spark):
    before = _shuffle_files(spark)
    kept = materialise(spark.range(20_000).groupBy((F.col("id") % 7_000).alias("k")).agg(F.count(F.lit(1)).alias("n")), "sums")
    for _ in range(50):  # files are removed in the background
        if not (left := _shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left
    assert (kept.count(), kept.agg(F.sum("n")).first()[0]) == (7_000, 20_000)


@pytest.mark.parametrize("own", [None, "false"])
def test_the_session_keeps_its_own_setting(spark, own):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    if own:
        spark.conf.set(key, own)
    try:
        materialise(spark.range(3), "few")
        assert spark.conf.get(key, None) == own
    finally:
        spark.conf.unset(key)
