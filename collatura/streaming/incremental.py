"""New files only: a file stream with a checkpoint, run until it has seen what is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def new_files(spark: SparkSession, path: str, schema: T.StructType, checkpoint: str, each: Callable[[DataFrame], None], format: str = "parquet") -> int:
    """Pass the rows of files not seen before to ``each``, once; returns how many batches there were.

    The checkpoint remembers the files, so a run that was stopped goes on and a
    run without new files does nothing.
    """
    batches = 0

    def one(batch: DataFrame, _: int) -> None:
        nonlocal batches
        if not batch.isEmpty():
            batches += 1
            each(batch)

    stream = spark.readStream.schema(schema).format(format).load(path)
    stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return batches


def track_occurrences(spark: SparkSession, path: str, checkpoint: str, store: str) -> int:
    """Append new false positives to the store that ``tracker.accumulate`` counts."""
    from collatura.schemas import OCCURRENCE

    return new_files(spark, path, OCCURRENCE, checkpoint, lambda rows: rows.write.mode("append").parquet(store))
