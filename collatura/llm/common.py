"""What the training-data operators share: a bit filter, samples by hash, and durable scratch tables."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from collatura.scratch import _CLEANUP, Scratch, remove, shared_dir, shuffles_removed  # noqa: F401


def _give_back() -> None:
    """Return what a task no longer uses to the system, as workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` whose workers give their memory back at the end of a task."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _give_back()

    return df.mapInArrow(whole, schema)


def slices(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows in batches of some ``most`` bytes, so that what is made of a batch stays small; a longer row is one alone."""
    for batch in batches:
        step = max(1, len(batch) * most // max(batch.nbytes, 1))
        if step >= len(batch):
            yield batch
            continue
        for at in range(0, len(batch), step):
            part = batch.slice(at, step)
            # Rows differ in length: halve what is still far too large.
            stack = [part]
            while stack:
                part = stack.pop()
                if len(part) > 1 and part.nbytes > 2 * most:
                    half = len(part) // 2
                    stack += [part.slice(half), part.slice(0, half)]
                else:
                    yield part


def bit_filter(keys: DataFrame, n: int, most: int = 1 << 25) -> np.ndarray:
    """A bitmap with two bits set for each 64-bit key of the one column of ``keys``.

    Its size follows ``n`` up to ``most`` bits (4 MB), which bounds what is
    sent to the driver and the executors.  It only spares later shuffles rows
    that cannot match; an exact join decides, so a full bitmap loses nothing.
    """
    bits = 1 << max(16, min(most.bit_length() - 1, (16 * max(n, 1)).bit_length()))
    key = F.col(keys.columns[0])
    at = F.explode(F.array(key.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(key, 32).bitwiseAND(F.lit(bits - 1))))
    words = (
        keys.select(at.alias("p"))
        .groupBy(F.shiftright("p", 6).alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 AS int))")).alias("v"))
        .toPandas()
    )
    out = np.zeros(bits // 64, np.uint64)
    out[words["w"].to_numpy(np.int64)] = words["v"].to_numpy(np.int64).view(np.uint64)
    return out


def in_filter(filter_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the unsigned 64-bit ``keys`` may be in the filter."""
    mask = np.uint64(len(filter_) * 64 - 1)
    one = lambda p: (filter_[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1)
    return (one(keys & mask) & one((keys >> np.uint64(32)) & mask)).astype(bool)


def _place(key: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 1)


def hash_edge(rows: DataFrame, key: str, most: int) -> tuple[int | None, int]:
    """(place, n): the ``most`` rows first by a hash of the long column ``key`` are those before that place and n at it.

    Buckets of the hash are counted, then the keys of the one in which the
    bound falls, so at most ``most`` keys reach the driver.  The place is None
    if all rows are within the bound.
    """
    bucket = F.shiftright(_place(key), 51)
    taken = 0
    for b, n in sorted(tuple(r) for r in rows.groupBy(bucket.alias("b")).count().collect()):
        if taken + n > most:
            break
        taken += n
    else:
        return None, 0
    if taken == most:
        return b << 51, 0
    for p, n in rows.where(bucket == b).groupBy(_place(key).alias("p")).count().orderBy("p").limit(most - taken).collect():
        if taken + n >= most:
            break
        taken += n
    return p, most - taken


def hash_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """``most`` of the rows, or all if there are fewer, the same on every run: those first by a hash of the long column ``key``.

    Rows stay where they are; only of the last key, whose rows count as equal,
    some may go.
    """
    place, n = hash_edge(rows, key, most)
    if place is None:
        return rows
    before = rows.where(_place(key) < place)
    return before.unionByName(rows.where(_place(key) == place).limit(n)) if n else before


def before_edge(rows: DataFrame, key: str, most: int) -> Column:
    """Whether a row is in a sample of at most ``most`` rows, those of the last key left out if they are not all in it."""
    place, _ = hash_edge(rows, key, most)
    return F.lit(True) if place is None else _place(key) < place


def names_beside(df: DataFrame, *wanted: str) -> DataFrame:
    """Only the columns wanted, so extra ones with clashing names play no part."""
    return df.select(*[F.col(f"`{c}`") for c in wanted])
