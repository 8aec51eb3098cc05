"""Tables in the folder that all executors share, for cutting lineage."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a single-process session without that setting gets a temporary folder
    of its own; a cluster without it is an error, as a machine-local folder
    would not be seen by the other executors.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = "file://" + tempfile.mkdtemp(prefix="collatura-")
    spark.sparkContext.setCheckpointDir(base)
    return base


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file systems, whatever its scheme."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


_TO_REMOVE: dict[str, list[str]] = {}


def _at_exit(spark: SparkSession, path: str) -> None:
    """Have ``path`` deleted when the application's driver ends."""
    name = spark.sparkContext.applicationId
    if name not in _TO_REMOVE:
        paths = _TO_REMOVE[name] = []

        def clear() -> None:
            with contextlib.suppress(Exception):  # a stopped session takes no more calls
                for x in paths:
                    remove(spark, x)

        atexit.register(clear)
    _TO_REMOVE[name].append(path)


#: Has Spark (from 4.1 on) remove the shuffle files of a query as it ends; else they stay until the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within, queries leave no shuffle files; the session's setting comes back afterwards."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


class Scratch:
    """Tables written to the shared folder in order to cut lineage.

    A written table survives the loss of any executor.  ``drop`` deletes tables
    once nothing reads them any more, ``close`` all of them.  What a result
    still reads stays until the driver ends, which then deletes it.  With
    ``tidy`` a table's shuffle files go once it is written.
    """

    def __init__(self, spark: SparkSession, name: str, tidy: bool = False):
        self.spark, self.path, self.tidy = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", tidy
        _at_exit(spark, self.path)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        with shuffles_removed(self.spark) if self.tidy else contextlib.nullcontext():
            df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, f"{self.path}/{name}")

    def close(self) -> None:
        remove(self.spark, self.path)

    def finish(self, df: DataFrame, *others: str) -> DataFrame:
        """Write the result and delete the tables it came from."""
        out = self.table(df, "result")
        self.drop(*others)
        return out
