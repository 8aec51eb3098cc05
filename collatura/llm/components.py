"""Connected components of a graph of links, without a driver-side graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collatura.llm.common import Scratch

#: Edges that one task contracts at a time; bounds its memory to some 100 MB.
EDGES_PER_TASK = 1_000_000


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes (ascending) and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for side in (x, y):
            np.minimum.at(new, label[side], low)
            np.minimum.at(new, side, low)
        while not np.array_equal(new, hop := new[new]):
            new = hop
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few links with the same components: each node to its smallest one."""
    if not len(a):
        return a, b
    nodes, root = local_components(a, b)
    far = nodes != root
    return nodes[far], root[far]


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's links (a, b) as a forest, contracted whenever there are EDGES_PER_TASK of them."""
    a, b = [], []
    for batch in batches:
        a.append(batch.column(0).to_numpy())
        b.append(batch.column(1).to_numpy())
        if sum(map(len, a)) >= EDGES_PER_TASK:
            a, b = ([x] for x in forest(np.concatenate(a), np.concatenate(b)))
    if a:
        x, y = forest(np.concatenate(a), np.concatenate(b))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])


def connected_components(scratch: Scratch, edges: DataFrame, per_task: int = EDGES_PER_TASK, contracted: bool = False) -> DataFrame:
    """(node, component) of every node that has an edge; component is its smallest node.

    ``edges`` has two long columns.  Tasks first contract bounded shares of the
    edges to forests, unless the step they come from did (``contracted``), as
    two Python steps in a row take two workers a task.  Graphs of more than ``per_task`` contracted edges then go
    through rounds of large-star and small-star operations, each written to the
    shared folder; hubs are only ever aggregated (map-side first) and joined.
    Null ends and self-links are dropped; no edges give no rows.
    """
    a, b = edges.columns
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    edges = scratch.table(edges if contracted else edges.mapInArrow(contract, "a long, b long"), "forest0")
    n, k = edges.count(), 0
    if n > per_task:
        mark = None
        while True:
            both = edges.union(edges.select("b", "a"))
            low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
            k += 1
            large = scratch.table(large, f"forest{k}")
            scratch.drop(f"forest{k - 1}")
            down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            low = down.groupBy("a").agg(F.min("b").alias("m"))
            small = down.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
            k += 1
            edges = scratch.table(small, f"forest{k}")
            scratch.drop(f"forest{k - 1}")
            now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if now == mark:
                break
            mark = now
    else:
        edges = edges.coalesce(1).mapInArrow(contract, "a long, b long")
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = found.select("component").distinct().select(F.col("component").alias("node"), "component")
    out = scratch.table(found.union(roots), "components")
    scratch.drop(f"forest{k}")
    return out
