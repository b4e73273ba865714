from pathlib import Path

from pyspark.sql import functions as F

from learnloom.storage import stored


def test_shuffle_files_of_a_stored_table_are_removed(spark):
    """Not at some time when the driver collects its garbage: what a step shuffled is gone before the next ones have run."""
    import time

    places = [Path(p) for p in spark._jvm.org.apache.spark.util.Utils.getConfiguredLocalDirs(spark.sparkContext._jsc.sc().conf())]
    held = lambda: {f for p in places for f in p.rglob("shuffle_*.data")}
    before, key = held(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(key)
    out = stored(spark.range(20000).groupBy((F.col("id") % 500).alias("k")).agg(F.collect_list("id").alias("ids")))
    for _ in range(50):
        if not held() - before:
            break
        time.sleep(0.1)
    assert not held() - before and out.count() == 500 and spark.conf.get(key) == setting
