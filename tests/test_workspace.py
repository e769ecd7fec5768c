"""Scratch tables: what is written is read, and shuffle files do not outlive the write."""

from pathlib import Path

from pyspark.sql import functions as F

from quern.sources.workspace import CLEANUP, Workspace


def _shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return sum(1 for d in manager.localDirsString() for _ in Path(d).rglob("shuffle_*.data"))


def test_save_frees_shuffles(spark):
    ws = Workspace(spark, "test")
    before, setting = _shuffle_files(spark), spark.conf.get(CLEANUP, "false")
    saved = ws.save(spark.range(1000).groupBy((F.col("id") % 7).alias("r")).count(), "counts")
    assert _shuffle_files(spark) <= before
    assert spark.conf.get(CLEANUP, "false") == setting
    assert sorted(tuple(x) for x in saved.collect()) == [(r, 143 if r < 6 else 142) for r in range(7)]


def test_empty_table(spark):
    assert Workspace(spark, "test").save(spark.range(0).groupBy("id").count(), "none").collect() == []
