"""Scratch tables in the folder that the whole cluster shares.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``.  Only where that
setting is absent (tests, a laptop) a temporary folder takes its place.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder as a Hadoop URI."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="quern-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


#: Whether Spark deletes the shuffle files of a statement when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the statements inside go when each has ended, not at some later collection.

    Only for statements whose plan nothing runs again, such as the writing of a table that is read
    in its place.
    """
    before = spark.conf.get(CLEANUP, "false")
    try:
        spark.conf.set(CLEANUP, "true")
        yield
    finally:
        spark.conf.set(CLEANUP, before)


class Workspace:
    """Named scratch tables of one run of an operator."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/quern-{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return the written table."""
        path = self.path(name)
        with freed_shuffles(self.spark):
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing will read again."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)

    def write_bytes(self, name: str, chunks) -> str:
        """Write one file from byte chunks and return its URI."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        out = path.getFileSystem(conf).create(path, True)
        try:
            for chunk in chunks:
                out.write(bytearray(chunk))
        finally:
            out.close()
        return self.path(name)
