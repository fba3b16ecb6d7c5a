from pyspark.sql import functions as F

from pairspace.plans.storage import CLEAN_UP, materialise


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}


def test_a_stored_table_leaves_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    counted = spark.range(10_000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    stored = materialise(counted, "counted")
    assert not _shuffle_files(spark) - before
    assert {r.k: r.n for r in stored.collect()} == {k: 10_000 // 7 + (k < 10_000 % 7) for k in range(7)}
    assert spark.conf.get(CLEAN_UP) == "false"
