import time

from pyspark.sql import functions as F

from keyloom import storage


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {found.apply(k).getName() for k in range(found.size()) if found.apply(k).getName().startswith("shuffle_")}


def test_cut_leaves_no_shuffle_files(spark):
    """They stayed until the driver collected its garbage, so disk grew with all steps of a query."""
    counts = spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count()
    before, setting = shuffle_files(spark), spark.conf.get(storage.CLEANUP, None)
    held = storage.cut(counts.join(counts.hint("merge").withColumnRenamed("count", "n"), "k"))
    until = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(storage.CLEANUP, None) == setting
    assert held.count() == 100 and len(counts.collect()) == len(counts.collect()) == 100
