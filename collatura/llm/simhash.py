"""SimHash near-duplicates by tiled exact comparison of fingerprints."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import product, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from collatura.llm.common import Scratch, map_batches, names_beside, slices
from collatura.llm.components import connected_components, contract, forest

#: Fingerprints of a tile, and the distinct ones up to which 1, 2, 4 blocks are counted.
TILE = 2048
BLOCKS = ((30_000, 1), (1_500_000, 2), (100_000_000, 4))


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """64 majority bits over the shingles' XXH64 (seed 42); 0 for no words or null.

    Lower-cases A-Z; words are runs without ASCII white space; fewer words than
    a shingle form one.  Texts of any length count in chunks of bounded size.
    """
    w = (text or b"").lower().split()
    if not w:
        return 0
    if len(w) <= words:
        hashes = iter([xxhash.xxh64_intdigest(b" ".join(w), 42)])
        n = 1
    else:
        n = len(w) - words + 1
        hashes = map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(w[i:] for i in range(words)))), repeat(42))
    ones, left = np.zeros(64, np.int64), n
    while left:
        size = min(left, 1 << 16)
        part = np.fromiter(hashes, np.uint64, size)
        ones += np.unpackbits(part.view(np.uint8).reshape(size, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        left -= size
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp) of each row; fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(1).cast(pa.binary() if batch.column(1).type == pa.string() else pa.large_binary())
            fp = np.array([fingerprint(t.as_py(), words) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return map_batches(names_beside(docs, "doc_id", "text"), run, "doc_id long, fp long")


def with_print(docs: DataFrame, words: int = 3) -> DataFrame:
    """``docs`` with the fingerprint of its column ``text`` as ``fp``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.encode() if t is not None else None, words) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp)], names=[*batch.schema.names, "fp"])

    return map_batches(docs, run, T.StructType([*docs.schema.fields, T.StructField("fp", T.LongType())]))


def _steps(blocks: int, radius: int) -> list[list[int]]:
    """Half of the differences of block counts with a sum of at most ``radius``."""
    near = [d for d in product(range(-radius, radius + 1), repeat=blocks) if sum(map(abs, d)) <= radius]
    return [list(d) for d in near if d > (0,) * blocks]


def _linked(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links of each pair of tiles (left, right; right null: within left), as a forest."""
    for batch in batches:
        a, b = [], []
        for left, right in zip(batch.column(0), batch.column(1), strict=True):
            x = left.values.to_numpy().view(np.uint64)
            y = right.values.to_numpy().view(np.uint64) if right.is_valid else x
            found = []
            for i in range(0, len(x), 256):
                far = np.bitwise_count(x[i : i + 256, None] ^ y[None, :])
                p, q = np.nonzero(far <= radius)
                found.append((x[p + i], y[q]))
            p, q = (np.concatenate(z).view(np.int64) for z in zip(*found, strict=True))
            p, q = forest(p[p != q], q[p != q])
            a.append(p)
            b.append(q)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z), pa.int64()) for z in (a, b)], names=["a", "b"])


def links(scratch: Scratch, prints: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints ``fp`` within ``radius`` bits, a forest for each task.

    The bits fall into blocks.  Fingerprints with equal counts of set bits in
    every block share tiles of some ``tile`` rows; two fingerprints within the
    radius differ in their block counts by a sum of at most the radius, so all
    other pairs of tiles are skipped unseen.  More blocks skip more pairs; their
    number follows the number of fingerprints and changes no result.
    """
    spark = scratch.spark
    prints = scratch.table(prints.select("fp").distinct(), "prints")
    n = prints.count()
    blocks = next((k for most, k in BLOCKS if n <= most), 8)
    width = 64 // blocks
    ones = F.array(*[F.bit_count(F.shiftrightunsigned("fp", i * width).bitwiseAND(F.lit((1 << width) - 1 if blocks > 1 else -1))) for i in range(blocks)])
    prints = prints.select("fp", ones.alias("ones"))
    parts = prints.groupBy("ones").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))
    tiles = (
        prints.join(parts, "ones")
        .groupBy("ones", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("part"))
        .agg(F.collect_list("fp").alias("fps"))
    )
    tiles = scratch.table(tiles, "tiles")
    ids = tiles.select("ones", "part")
    steps = F.from_json(F.lit(json.dumps(_steps(blocks, radius))), "array<array<int>>")
    other = ids.select(F.col("ones").alias("ones2"), F.col("part").alias("part2"))
    near = ids.select("ones", "part", F.explode(steps).alias("step"))
    near = near.select("ones", "part", F.zip_with("ones", "step", lambda x, y: x + y).alias("ones2"))
    pairs = near.join(other, "ones2").unionByName(
        ids.join(other, [F.col("ones") == F.col("ones2"), F.col("part") < F.col("part2")])
    )
    right = tiles.select(F.col("ones").alias("ones2"), F.col("part").alias("part2"), F.col("fps").alias("fps2"))
    work = pairs.join(tiles, ["ones", "part"]).join(right, ["ones2", "part2"]).select("fps", "fps2")
    work = work.unionByName(tiles.select("fps", F.lit(None).cast("array<bigint>").alias("fps2")))
    # A pair of full tiles is some milliseconds of work: spread the pairs evenly.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    work = work.repartition(parts)
    return map_batches(work, lambda it: contract(_linked(it, radius)), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 3, words: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of each row of ``docs`` (doc_id, text).

    Rows whose fingerprints differ in at most ``radius`` bits are linked;
    component_id is the smallest doc_id reachable, the row's own included.
    Null, empty and blank texts have fingerprint 0 and are linked like others.
    Repeated rows each give a row; a null doc_id is linked but never names a
    component (null if nothing else is in it).  An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.table(fingerprints(docs, words), "rows")
    classes = scratch.table(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    nodes = connected_components(scratch, links(scratch, classes, radius), contracted=True)
    lowest = classes.join(nodes, F.col("fp") == F.col("node"))
    roots = lowest.groupBy("component").agg(F.min("least").alias("component_id"))
    named = lowest.join(roots, "component").select("fp", "component_id")
    named = classes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    named = scratch.table(named, "named")  # apart from the join, whose hot fingerprints Spark can then split
    out = rows.join(named, "fp").select("doc_id", "fp", "component_id")
    return scratch.finish(out, "rows", "classes", "prints", "tiles", "components", "named")
