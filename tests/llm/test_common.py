import time
from pathlib import Path

from pyspark.sql import functions as F

from collatura.llm.common import _CLEANUP, Scratch, hash_sample


def test_sample_is_as_large_as_its_bound(spark):
    df = spark.range(5000).selectExpr("id AS key")
    for most in (0, 1, 7, 4999, 5000, 6000):
        got = [r["key"] for r in hash_sample(df, "key", most).collect()]
        assert len(got) == len(set(got)) == min(most, 5000)
    assert sorted(hash_sample(df, "key", 7).collect()) == sorted(hash_sample(df.repartition(9), "key", 7).collect())
    assert hash_sample(df.limit(0), "key", 7).count() == 0


def test_a_hot_key_leaves_no_sample_empty(spark):
    hot = spark.range(300).selectExpr("3L AS key")
    assert hash_sample(hot, "key", 20).count() == 20
    assert hash_sample(hot.unionByName(spark.range(100).selectExpr("id AS key")), "key", 150).count() == 150


def test_a_tidy_table_leaves_no_shuffle_files(spark):
    """Its rows are whole, the session's setting is as before, and a frame can be written again."""
    was = spark.conf.get(_CLEANUP, None)
    folders = Path(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    held = lambda: set(folders.rglob("shuffle_*"))
    df = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).agg(F.count("*").alias("n")).repartition(3, "n")
    for tidy in (False, True, True):
        before, scratch = held(), Scratch(spark, "tidy", tidy=tidy)
        assert sorted(map(tuple, scratch.table(df, "t").collect())) == [(k, 100) for k in range(10)]
        new = held() - before
        for _ in range(50):  # files go in the background
            if not tidy or not new & held():
                break
            time.sleep(0.1)
        assert bool(new & held()) != tidy
        scratch.close()
    assert spark.conf.get(_CLEANUP, None) == was
