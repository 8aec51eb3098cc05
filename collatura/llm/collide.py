"""From rows that share bucket keys to classes of rows truly alike, without all pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collatura.llm.common import Scratch, bit_filter, in_filter, map_batches
from collatura.llm.components import connected_components

#: Rows of a tile, and the sum of their sizes, about which a bucket is cut.
TILE, TILE_SIZE = 2000, 1 << 20

#: Ranges of keys for each shuffle partition, rows that a task sorts at a time, and rows packed into one at most.
CELLS, SORTED, PACK = 4, 1 << 18, 256

#: (i, others): which of the rows ``others`` of a tile are alike its row i.
Alike = Callable[[int, np.ndarray], np.ndarray]


#: Rows (key, id); if a broadcast bit filter is given, only those whose key may be in it.
Members = Callable[[Broadcast | None], DataFrame]


def kept(keys: np.ndarray, sent: Broadcast | None) -> np.ndarray:
    return np.ones(len(keys), bool) if sent is None else in_filter(sent.value, keys.view(np.uint64))


def from_table(members: DataFrame) -> Members:
    """Members that are rows (key, id) of a table."""

    def rows(sent: Broadcast | None) -> DataFrame:
        if sent is None:
            return members.select("key", "id")
        return members.select("key", "id").mapInArrow(lambda it: (b.filter(pa.array(kept(b.column(0).to_numpy(), sent))) for b in it), "key long, id long")

    return rows


def two_of_each(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each key one id, and another if it has one; keys ascending."""
    order = np.argsort(keys)
    keys, ids = keys[order], ids[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    run = np.cumsum(first) - 1
    other = np.flatnonzero(ids != ids[first][run])
    take = first
    take[other[np.flatnonzero(np.diff(run[other], prepend=-1))]] = True
    return keys[take], ids[take]


def _pack(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    """(cell, rows): a task's two ids of each key, in ranges of keys; ``rows`` are its keys and then their ids."""
    held: list[pa.RecordBatch] = []

    def packs() -> Iterator[pa.RecordBatch]:
        keys, ids = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(2))
        held.clear()
        keys, ids = two_of_each(keys.view(np.uint64), ids)
        cell = ((keys >> np.uint64(32)) * np.uint64(cells) >> np.uint64(32)).astype(np.int32)
        edges = np.flatnonzero(np.diff(cell, prepend=-1, append=-1)).tolist()
        spans = [(x, min(x + PACK, end)) for at, end in zip(edges, edges[1:]) for x in range(at, end, PACK)]
        for k in range(0, len(spans), PACK):
            part = spans[k : k + PACK]
            rows = [keys[a:b].tobytes() + ids[a:b].tobytes() for a, b in part]
            yield pa.RecordBatch.from_arrays([pa.array(cell[[a for a, _ in part]]), pa.array(rows, pa.binary())], names=["cell", "rows"])

    for batch in batches:
        if len(batch):
            held.append(batch)
        if sum(map(len, held)) >= SORTED:
            yield from packs()
    if held:
        yield from packs()


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key): those with two ids or more in rows (cell, rows) sorted by cell."""
    held: list[bytes] = []

    def close() -> pa.RecordBatch:
        flat = [np.frombuffer(x, np.uint64) for x in held]
        held.clear()
        keys, _ = two_of_each(*(np.concatenate(x) for x in ([x[: len(x) // 2] for x in flat], [x[len(x) // 2 :] for x in flat])))
        return pa.RecordBatch.from_arrays([pa.array(keys[1:][keys[1:] == keys[:-1]].view(np.int64))], names=["key"])

    cell = None
    for batch in batches:
        for at, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if held and at != cell:
                yield close()
            cell = at
            held.append(rows)
    if held:
        yield close()


def open_keys(rows: DataFrame, members: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """(key): those with two ids or more among the (key, id) that ``members`` makes of a task's ``rows``.

    The same as sums by key, for many keys of one id each: tasks sort what
    they make and shuffle it packed, in ranges of keys, at 16 bytes a row and
    at most two rows a key from each ``SORTED``.  Keys should be hashes, as
    their upper bits deal them out.
    """
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    packed = map_batches(rows, lambda it: _pack(members(it), n * CELLS), "cell int, rows binary")
    return map_batches(packed.repartition(n, "cell").sortWithinPartitions("cell"), _unpack, "key long")


def shared(scratch: Scratch, members: Members, opened: DataFrame | None = None) -> DataFrame:
    """The distinct (key, id) whose key has two ids or more; ``opened`` are these keys, if they are found in another way.

    A key's least and greatest id are found with sums in every task first, and
    rows of other keys are dropped where they are read, so neither a hot key
    nor the many keys of one id meet in a task.
    """
    if opened is None:
        opened = members(None).groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("key")
    open_ = scratch.table(opened, "open")
    sent = scratch.spark.sparkContext.broadcast(bit_filter(open_, open_.count()))
    held = scratch.table(members(sent).distinct().join(open_, "key", "left_semi"), "held")
    scratch.drop("open")
    return held


def tile_forest(ids: np.ndarray, roots: np.ndarray, visits: np.ndarray, alike: Alike) -> list[tuple[int, int]]:
    """Links that connect all alike rows of a tile whose roots differ.

    Rows are compared in turn with the later ones of other roots; what a link
    connects is not compared again.  ``visits`` marks rows of other tiles, if
    any: only these are compared, with the tile's own ones.
    """
    if len(ids) == 2:  # most tiles
        apart = roots[0] != roots[1] and not (visits[0] and visits[1])
        return [(int(ids[0]), int(ids[1]))] if apart and alike(0, np.array([1]))[0] else []
    label = np.unique(roots, return_inverse=True)[1]
    left = label.max() + 1
    across, out = bool(visits.any()), []
    for i in range(len(ids)):
        if left == 1:
            break
        if across:
            others = np.flatnonzero(~visits & (label != label[i])) if visits[i] else ()
        else:
            others = np.flatnonzero(label[i + 1 :] != label[i]) + (i + 1)
        if not len(others):
            continue
        for j in others[alike(i, others)].tolist():
            if label[j] != label[i]:
                out.append((int(ids[i]), int(ids[j])))
                label[label == label[j]] = label[i]
                left -= 1
    return out


def _links(batches: Iterator[pa.RecordBatch], prepare: Callable[[pa.Array], Alike]) -> Iterator[pa.RecordBatch]:
    """Links of each tile; rows (group, id, root, visit, body) are sorted by group."""
    open_: list[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]] = []
    done: list[tuple[int, int]] = []

    def close() -> None:
        *columns, bodies = open_[0] if len(open_) == 1 else [pa.concat_arrays(x) if isinstance(x[0], pa.Array) else np.concatenate(x) for x in zip(*open_)]
        if len(columns[0]) > 1:
            done.extend(tile_forest(*columns, prepare(bodies)))
        open_.clear()

    def links() -> pa.RecordBatch:
        a, b = zip(*done, strict=True) if done else ((), ())
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b)], names=["a", "b"])

    group = None
    for batch in batches:
        g = batch.column(0).to_numpy()
        if not len(g):
            continue
        start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])).tolist()
        ids, roots, visits = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
        for at, end in zip(start, [*start[1:], len(g)], strict=True):
            if open_ and g[at] != group:
                close()
            group = g[at]
            open_.append((ids[at:end], roots[at:end], visits[at:end], batch.column(4).slice(at, end - at)))
        if len(done) > 50_000:
            yield links()
    if open_:
        close()
    yield links()


def _in_tiles(rows: DataFrame, body: DataFrame, prepare: Callable[[pa.Array], Alike]) -> DataFrame:
    """(a, b): links within the tiles (key, part) of ``rows`` (key, part, id, root, visit)."""
    rows = rows.select(F.xxhash64("key", "part").alias("group"), "id", "root", "visit").join(body.select("id", "body"), "id")
    rows = rows.select("group", "id", "root", "visit", "body")
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return rows.repartition(n, "group").sortWithinPartitions("group", "id").mapInArrow(lambda it: _links(it, prepare), "a long, b long")


def classes(
    scratch: Scratch,
    members: Members,
    bodies: Callable[[DataFrame, int], DataFrame],
    prepare: Callable[[pa.Array], Alike],
    tile: int = TILE,
    tile_size: int = TILE_SIZE,
    opened: DataFrame | None = None,
) -> DataFrame:
    """(node, component) of the ids that are alike some other id of a bucket.

    ``members`` gives (key, id), twice, or once if ``opened`` are the keys with
    two ids or more; ``bodies(ids, n)`` returns
    (id, body, size) of the n ids that share a bucket; ``prepare`` takes the
    bodies of a tile and returns what compares them.  Buckets of the same ids
    count once.  A bucket is cut into tiles by ids; each tile's rows, and the
    bucket's least id in every tile, are compared inside a task, which sends on
    a forest of links.  In buckets of several tiles that are not yet connected,
    the rows outside the largest component then visit the bucket's other tiles,
    so no link is lost, and no pair of rows ever leaves a task.
    """
    held = shared(scratch, members, opened)
    ids = scratch.table(held.select("id").distinct(), "ids")
    body = scratch.table(bodies(ids, ids.count()), "bodies")
    sized = held.join(body.select("id", "size"), "id")
    keys = sized.groupBy("key").agg(
        F.count("*").alias("n"),
        F.min("id").alias("pivot"),
        F.sum("size").alias("size"),
        F.bit_xor(F.xxhash64("id")).alias("all"),
        F.bit_xor(F.xxhash64("id", F.lit(1))).alias("all2"),
    )
    keys = keys.where("n > 1").groupBy("n", "pivot", "size", "all", "all2").agg(F.min("key").alias("key"))
    parts = F.greatest(F.ceil(F.col("n") / tile), F.ceil(F.col("size") / tile_size)).cast("int")
    keys = scratch.table(keys.select("key", "pivot", parts.alias("parts")), "keys")
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")
    placed = scratch.table(held.join(keys, "key").select("key", "id", "parts", part), "placed")
    wide = keys.where("parts > 1")
    pivots = wide.select("key", F.col("pivot").alias("id"), "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    pivots = pivots.where(F.col("part") != F.pmod(F.xxhash64("id"), F.col("parts")))
    rows = placed.unionByName(pivots).select("key", "part", "id", F.col("id").alias("root"), F.lit(False).alias("visit"))
    links = scratch.table(_in_tiles(rows, body, prepare), "links")
    out = scratch.table(connected_components(scratch, links), "first")
    several = wide.limit(1).count()
    if several:
        rooted = placed.where("parts > 1").join(out.withColumnRenamed("node", "id"), "id", "left")
        rooted = scratch.table(rooted.select("key", "id", "parts", "part", F.coalesce("component", "id").alias("root")), "rooted")
        roots = rooted.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("root", "n").alias("main"), F.count("*").alias("roots"))
        open_ = scratch.table(rooted.join(roots.where("roots > 1").select("key", "main"), "key"), "apart")
        own = open_.select("key", "part", "id", "root", F.lit(False).alias("visit"))
        guests = open_.where("root <> main").withColumn("at", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("at <> part")
        guests = guests.select("key", F.col("at").alias("part"), "id", "root", F.lit(True).alias("visit"))
        more = scratch.table(_in_tiles(own.unionByName(guests), body, prepare), "more")
        out = scratch.table(connected_components(scratch, links.unionByName(more)), "classes")
        scratch.drop("rooted", "apart", "more")
    else:
        out = scratch.table(out, "classes")
    scratch.drop("held", "ids", "bodies", "keys", "placed", "links", "first", "components")
    return out
