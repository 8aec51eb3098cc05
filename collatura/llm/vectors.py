"""Embedding near-duplicates: rotated binary codes screen pairs, exact cosines decide."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collatura.llm.common import Scratch, map_batches, names_beside
from collatura.llm.components import EDGES_PER_TASK, connected_components, forest, local_components

#: Vectors of a tile and rows the centres are fitted on at most.
TILE, FIT_ROWS = 4096, 20_000
#: Bytes of the sample that reaches the driver, and of a tile's vectors, whatever the length of a vector.
FIT_BYTES, TILE_BYTES = 32 << 20, 4 << 20
#: Tiles of a file where there are many, files at most (a task compares two files), pairs of tiles that go to a worker at a
#: time, and bytes a worker keeps of prepared tiles.
FILE_TILES, FILES, BATCH_PAIRS, KEPT_BYTES = 8, 512, 4, 48 << 20


def rotation(dim: int, seed: int = 20) -> np.ndarray:
    """A random orthogonal matrix, the same on every machine."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign codes of the rotated unit vectors (packed bits) and their correction factors.

    The factor is the inner product of a vector with its code, the code scaled
    to unit length.  Dividing an estimate by it makes it unbiased over random
    rotations.
    """
    turned = unit @ turn
    return np.packbits(turned >= 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(unit.shape[1])


def estimates(codes: np.ndarray, factors: np.ndarray, queries: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (code row, query row) and the standard error of each code's estimates.

    A code's part outside its vector points in a random direction, so the
    estimate errs by sqrt(1 - factor^2) / factor / sqrt(dim - 1) at most for
    unit queries, as a standard error.
    """
    dim = queries.shape[1]
    scaled = signs(codes, dim) / factors[:, None].astype(np.float32)
    error = np.sqrt(np.maximum(0, 1 - factors**2)) / factors / np.sqrt(max(dim - 1, 1))
    return scaled @ (queries @ turn).astype(np.float32).T, error


def signs(codes: np.ndarray, dim: int) -> np.ndarray:
    """Codes as unit vectors."""
    return np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * np.float32(2 / np.sqrt(dim)) - np.float32(1 / np.sqrt(dim))


def reach(factors: np.ndarray, least: float) -> np.ndarray:
    """What a code's inner product with a unit vector is at least if its own vector has a cosine of ``least`` or more with that.

    Angles obey the triangle inequality: a code is arccos(factor) from its own
    vector, so at most that and arccos(least) from the other.  No pair is missed.
    """
    return np.cos(np.minimum(np.pi, np.arccos(np.clip(factors, -1, 1)) + np.arccos(np.clip(least, -1, 1))))


def unit_rows(raw: np.ndarray) -> np.ndarray:
    """Rows in double precision at length 1; scaled by their largest component first, so that no square overflows or vanishes."""
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _units(batches: Iterator[pa.RecordBatch], single: bool) -> Iterator[pa.RecordBatch]:
    """(vec_id, dim, key, raw): the SHA-256 of the unit vector's doubles and the vector as it came; null if it links with nothing."""
    kind = np.float32 if single else np.float64
    for batch in batches:
        column = batch.column(1)
        n = len(batch)
        dims, keys, raws = np.zeros(n, np.int32), [None] * n, [None] * n
        values, offsets = column.values, column.offsets.to_numpy()
        known = np.asarray(values.is_valid())
        values = values.to_numpy(zero_copy_only=False).astype(kind)
        size = np.where(np.asarray(column.is_valid()), np.diff(offsets), 0)
        for dim in np.unique(size[size > 0]).tolist():
            at = np.flatnonzero(size == dim)
            cells = offsets[at][:, None] + np.arange(dim)
            rows = values[cells]
            with np.errstate(invalid="ignore"):
                fine = known[cells].all(axis=1) & np.isfinite(rows).all(axis=1) & (rows != 0).any(axis=1)
            at, rows = at[fine], rows[fine]
            if len(at):
                for k, unit, raw in zip(at.tolist(), unit_rows(rows) + 0.0, rows, strict=True):  # -0 is 0
                    dims[k], keys[k], raws[k] = dim, hashlib.sha256(unit.tobytes()).digest(), raw.tobytes()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dims), pa.array(keys, pa.binary()), pa.array(raws, pa.binary())], names=["vec_id", "dim", "key", "raw"])


def centres_of(sample: np.ndarray, k: int, rounds: int = 5) -> np.ndarray:
    """Spherical k-means over a sample in a fixed order."""
    centre = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = (sample @ centre.T).argmax(axis=1)
        for j in range(k):
            if (own == j).any():
                total = sample[own == j].sum(axis=0)
                if (size := np.linalg.norm(total)) > 1e-12:
                    centre[j] = total / size
    return centre


def nearest(v: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each unit vector and its cosine."""
    found = []
    for i in range(0, len(v), 1024):
        near = v[i : i + 1024] @ centre.T
        found.append((near.argmax(axis=1), near.max(axis=1)))
    own, cos = (np.concatenate(z) for z in zip(*found, strict=True))
    return own, np.clip(cos, -1, 1)


def _by_dim(batch: pa.RecordBatch, kind: type) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dim, rows of the batch, their unit vectors) for each length of vector."""
    dims, raws = batch.column("dim").to_numpy(), batch.column("raw").to_pylist()
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        yield dim, at, unit_rows(np.frombuffer(b"".join(raws[k] for k in at.tolist()), kind).reshape(-1, dim))


def _merged(keys: list[bytes], sizes: list[int], least: list[int | None]) -> tuple[list[int], list[int], list[int | None]]:
    """(first row, rows, smallest id) of each distinct key; a null id is no id."""
    at: dict[bytes, int] = {}
    first, total, low = [], [], []
    for k, (key, size, i) in enumerate(zip(keys, sizes, least, strict=True)):
        if (j := at.setdefault(key, len(first))) == len(first):
            first.append(k)
            total.append(size)
            low.append(i)
        else:
            total[j] += size
            low[j] = i if low[j] is None else low[j] if i is None else min(low[j], i)
    return first, total, low


TILES = "no long, dim int, cell int, radius double, keys array<binary>, sizes array<long>, least array<long>, raws binary, codes binary, factors binary"


def _tiles(batches: Iterator[pa.RecordBatch], centres: Callable[[], dict[int, np.ndarray]], kind: type) -> Iterator[pa.RecordBatch]:
    """A row for each tile of the rows (no, dim, cell, key, raw, size, least), which come in order of ``no``.

    Rows of one direction become one class.  ``radius`` is the largest angle to
    the cell's centre.
    """
    turns: dict[int, np.ndarray] = {}
    held: list[dict] = []

    def whole() -> pa.RecordBatch:
        no, dim, cell = (held[0][c] for c in ("no", "dim", "cell"))
        first, sizes, least = _merged(*([x for part in held for x in part[c]] for c in ("key", "size", "least")))
        keys, raws = ([x for part in held for x in part[c]] for c in ("key", "raw"))
        keys, raws = [keys[k] for k in first], b"".join(raws[k] for k in first)
        unit = unit_rows(np.frombuffer(raws, kind).reshape(-1, dim))
        if dim not in turns:
            turns[dim] = rotation(dim)
        codes, factors = encode(unit, turns[dim])
        radius = np.arccos(np.clip(unit @ centres()[dim][cell], -1, 1)).max()
        row = [no, dim, cell, float(radius), keys, sizes, least, raws, codes.tobytes(), factors.astype(np.float64).tobytes()]
        names = [c.split()[0] for c in TILES.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=names)

    for batch in batches:
        numbers = batch.column("no").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
        for i, j in zip(edges, edges[1:], strict=False):
            if i == j:
                continue
            part = batch.slice(i, j - i)
            if held and held[0]["no"] != int(numbers[i]):
                yield whole()
                held = []
            held.append({c: part.column(c).to_pylist() for c in ("key", "raw", "size", "least")} | {c: part.column(c)[0].as_py() for c in ("no", "dim", "cell")})
    if held:
        yield whole()


def _links(left: tuple, right: tuple, same: bool, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The linked rows of two prepared tiles, or of one with itself, for some rows at a time."""
    (_, _, unit, coded, bound), (_, _, unit2, turned) = left, right
    for i in range(0, len(unit), 256):
        close = coded[i : i + 256] @ turned >= bound[i : i + 256, None]
        x, y = np.divmod(np.flatnonzero(close), len(unit2))
        x += i
        if same:
            x, y = x[x < y], y[x < y]
        near = np.zeros(len(x), bool)
        check = np.arange(len(x))
        if len(x) > close.size // 16:  # all at once; what rounding may decide is checked like single pairs
            cos = (unit[i : i + 256] @ unit2.T)[x - i, y]
            near = cos >= least
            check = np.flatnonzero(np.abs(cos - least) < 1e-12)
        step = max(1, (16 << 20) // unit[0].nbytes)
        for j in range(0, len(check), step):
            at = check[j : j + step]
            near[at] = np.einsum("ij,ij->i", unit[x[at]], unit2[y[at]]) >= least
        if near.any():
            yield x[near], y[near]


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels of positions after links a-b (a ascending); a label is a position of its component."""
    place = np.full(len(label), -1)
    place[b[::-1]] = np.arange(len(b))[::-1]
    # Each end's first link goes before the rest: most links of a dense group are within a component by then.
    for at in (np.flatnonzero(np.diff(a, prepend=-1)), place[place >= 0], slice(None)):
        p, q = label[a[at]], label[b[at]]
        apart = p != q
        if apart.any():
            nodes, root = local_components(p[apart], q[apart])
            new = np.arange(len(label))
            new[nodes] = root
            label = new[label]
    return label


def _link_tiles(batches: Iterator[pa.RecordBatch], least: float, kind: type) -> Iterator[pa.RecordBatch]:
    """What a task's pairs of tiles (columns ending in 2: the right one) link, summed over the task.

    Rows out: (a, b, n): b null: class a has n linked rows there; else a link
    a-b that connects.
    """
    turns: dict[int, np.ndarray] = {}
    kept: dict[int, tuple] = {}
    left: tuple = (None,)
    kept_bytes = 0
    counts: list[np.ndarray] = [np.zeros((2, 0), np.int64)]
    edges: list[np.ndarray] = [np.zeros((2, 0), np.int64)]

    def base(batch: pa.RecordBatch, k: int, dim: int, no: str, sizes: str, raws: str) -> tuple:
        size = batch.column(sizes)[k].values.to_numpy()
        unit = unit_rows(np.frombuffer(batch.column(raws)[k].as_buffer(), kind).reshape(-1, dim))
        return (batch.column(no)[k].as_py() << 32) + np.arange(len(size)), size.copy(), unit

    def summed(parts: list[np.ndarray]) -> list[np.ndarray]:
        a, n = np.concatenate(parts, axis=1)
        ids, at = np.unique(a, return_inverse=True)
        total = np.zeros(len(ids), np.int64)
        np.add.at(total, at, n)
        return [np.stack([ids, total])]

    for batch in batches:
        for k in range(len(batch)):
            no, no2, dim = (batch.column(c)[k].as_py() for c in ("no", "no2", "dim"))
            if dim not in turns:
                turns[dim] = rotation(dim)
            turn = turns[dim]
            if left[0] != no:
                ids, size, unit = base(batch, k, dim, "no", "sizes", "raws")
                codes = np.frombuffer(batch.column("codes")[k].as_buffer(), np.uint8).reshape(len(ids), -1)
                bound = reach(np.frombuffer(batch.column("factors")[k].as_buffer(), np.float64), least) - 1e-5
                left = (no, (ids, size, unit, signs(codes, dim), bound.astype(np.float32)))
            if no2 not in kept:
                ids2, size2, unit2 = base(batch, k, dim, "no2", "sizes2", "raws2")
                turned = np.ascontiguousarray((unit2 @ turn).astype(np.float32).T)
                new = unit2.nbytes + turned.nbytes + ids2.nbytes + size2.nbytes
                while kept and kept_bytes + new > KEPT_BYTES:
                    kept_bytes -= sum(z.nbytes for z in kept.pop(next(iter(kept))))
                kept[no2] = (ids2, size2, unit2, turned)
                kept_bytes += new
            ids, size = left[1][:2]
            ids2, size2 = kept[no2][:2]
            n, m = np.zeros(len(ids), np.int64), np.zeros(len(ids2), np.int64)
            nodes = ids if no == no2 else np.concatenate([ids, ids2])
            label = np.arange(len(nodes))
            for x, y in _links(left[1], kept[no2], no == no2, least):
                n += np.bincount(x, size2[y], len(n)).astype(np.int64)
                m += np.bincount(y, size[x], len(m)).astype(np.int64)
                label = _joined(label, x, y + len(nodes) - len(ids2))
            if not n.any():
                continue
            counts += [np.stack([ids[n > 0], n[n > 0]]), np.stack([ids2[m > 0], m[m > 0]])]
            far = label != np.arange(len(label))
            edges.append(np.stack([nodes[far], nodes[label[far]]]))
            if sum(z.shape[1] for z in counts) >= EDGES_PER_TASK:
                counts = summed(counts)
            if sum(z.shape[1] for z in edges) >= EDGES_PER_TASK:
                edges = [np.stack(forest(*np.concatenate(edges, axis=1)))]
    (a, n), (p, q) = summed(counts)[0], forest(*np.concatenate(edges, axis=1))
    a, b, n = np.concatenate([a, p]), np.concatenate([np.full(len(a), -1), q]), np.concatenate([n, np.zeros(len(p), np.int64)])
    for i in range(0, len(a), 1 << 18):
        part = [pa.array(z[i : i + (1 << 18)], pa.int64()) for z in (a, n)]
        ends = b[i : i + (1 << 18)]
        yield pa.RecordBatch.from_arrays([part[0], pa.array(ends, pa.int64(), mask=ends < 0), part[1]], names=["a", "b", "n"])


def near_duplicates(embeddings: DataFrame, least: float = 0.9, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of ``embeddings`` (vec_id, embedding).

    Vectors of one length are linked at a cosine of ``least`` or more, in
    double precision; equal directions form one class first, so that a group of
    copies costs one row.  Classes are dealt to cells around centres (fitted on
    at most FIT_ROWS classes and FIT_BYTES), cells to tiles, each a row of a table.  By the triangle inequality of
    angles, two cells whose centres are further apart than their radii and the
    angle sought hold no link and are skipped; in the other pairs of tiles the
    same inequality on a code's angle decides which pairs are recomputed, so none is missed.  A task reads the
    two files it compares from the shared folder, so vectors are shuffled once however many
    pairs of tiles there are.  n_links counts rows linked directly, copies included.

    Null, empty, zero vectors and those with a null or non-finite component
    link with nothing.  Rows with a null vec_id are linked and counted but name
    no component.  Rows sharing a vec_id count each.  No rows give no rows.
    """
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "vectors")
    single = dict(embeddings.dtypes)["embedding"] == "array<float>"
    kind = np.float32 if single else np.float64
    raw = names_beside(embeddings, "vec_id", "embedding").mapInArrow(lambda it: _units(it, single), "vec_id long, dim int, key binary, raw binary")
    raw = scratch.table(raw, "raw")
    rows = scratch.table(raw.select("vec_id", "dim", "key"), "rows")  # outlives the vectors
    linking = raw.where("key IS NOT NULL")
    place = F.shiftrightunsigned(F.xxhash64("key"), 1)
    centres, wanted = {}, {}
    for dim, n in linking.groupBy("dim").agg(F.approx_count_distinct("key", 0.02)).collect():  # a row a length of vector
        wanted[dim] = max(1, min(tile, TILE_BYTES // (np.dtype(kind).itemsize * dim)))
        most = min(FIT_ROWS, max(1, FIT_BYTES // (8 * dim)))
        # Of the distinct directions, some ``most`` that come first by a hash.
        first = linking.where((F.col("dim") == dim) & (place <= min((1 << 63) - 1, int((1 << 63) * 1.2 * most / n))))
        sample = first.groupBy("key").agg(F.any_value("raw").alias("raw"), F.any_value(place).alias("place")).orderBy("place", "key").limit(most).select("raw").collect()
        if not sample:  # few directions, none of them within the share
            sample = linking.where(F.col("dim") == dim).select("raw").limit(1).collect()
        sample = unit_rows(np.frombuffer(b"".join(r["raw"] for r in sample), kind).reshape(-1, dim))
        centres[dim] = centres_of(sample, int(max(1, min(1024, n // wanted[dim], len(sample)))))
    sent = spark.sparkContext.broadcast(centres)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.zeros(len(batch), np.int32)
            for dim, at, v in _by_dim(batch, kind):
                cell[at] = nearest(v, sent.value[dim])[0]
            yield pa.RecordBatch.from_arrays([batch.column("dim"), pa.array(cell), batch.column("key")], names=["dim", "cell", "key"])

    counted = map_batches(linking.select("dim", "key", "raw"), cells, "dim int, cell int, key binary").groupBy("dim", "cell").agg(F.approx_count_distinct("key").alias("n"))
    parts = {dim: np.ones(len(centre), np.int64) for dim, centre in centres.items()}  # at most 1,024 cells a length
    for dim, cell, n in counted.collect():
        parts[dim][cell] = -(-n // wanted[dim])
    starts, n_tiles = {}, 0
    for dim, own in parts.items():
        starts[dim] = n_tiles + np.cumsum(own) - own
        n_tiles += int(own.sum())
    numbers = spark.sparkContext.broadcast((parts, starts))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, start = numbers.value
        for batch in batches:
            keys = batch.column("key").to_pylist()
            first, sizes, low = _merged(keys, [1] * len(keys), batch.column("vec_id").to_pylist())
            batch = batch.take(pa.array(first, pa.int64()))
            hashes = np.frombuffer(b"".join(keys[k][:4] for k in first), np.uint32).astype(np.int64)
            no, cell = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int32)
            for dim, at, v in _by_dim(batch, kind):
                cell[at] = nearest(v, sent.value[dim])[0]
                no[at] = start[dim][cell[at]] + hashes[at] % own[dim][cell[at]]
            out = [pa.array(no), batch.column("dim"), pa.array(cell), batch.column("key"), batch.column("raw"), pa.array(sizes, pa.int64()), pa.array(low, pa.int64())]
            yield pa.RecordBatch.from_arrays(out, names=["no", "dim", "cell", "key", "raw", "size", "least"])

    dealt = linking.mapInArrow(numbered, "no long, dim int, cell int, key binary, raw binary, size long, least long")
    files = max(1, min(n_tiles, FILE_TILES), min(FILES, n_tiles // FILE_TILES))
    dealt = dealt.repartition(files, "no").sortWithinPartitions("no")
    tiles = scratch.table(map_batches(dealt, lambda it: _tiles(it, lambda: sent.value, kind), TILES), "tiles")
    scratch.drop("raw")

    # Which cells each cell can link with, as bits.
    radii = {(r["dim"], r["cell"]): r["radius"] for r in tiles.groupBy("dim", "cell").agg(F.max("radius").alias("radius")).collect()}
    near = []
    for dim, centre in centres.items():
        radius = np.array([radii.get((dim, j), 0.0) for j in range(len(centre))])
        apart = np.arccos(np.clip(centre @ centre.T, -1, 1))
        fine = apart <= radius[:, None] + radius[None, :] + np.arccos(least) + 1e-9
        bits = np.packbits(np.pad(fine, ((0, 0), (0, -len(fine) % 64))), axis=1, bitorder="little").view(np.int64)
        near += [(dim, j, row) for j, row in enumerate(bits.tolist())]
    # A pair takes up to 9 MB, so workers get few at a time; the setting is of a session beside the caller's.
    beside = spark.newSession()
    beside.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_PAIRS)
    near = F.broadcast(beside.createDataFrame(near, "dim int, cell int, near array<long>"))
    stored = beside.read.schema(tiles.schema).parquet(f"{scratch.path}/tiles")
    left = stored.select("no", "dim", "cell", "sizes", "raws", "codes", "factors").coalesce(FILES).join(near, ["dim", "cell"])
    right = stored.select(*[F.col(c).alias(f"{c}2") for c in ("no", "dim", "cell", "sizes", "raws")]).coalesce(FILES)
    # Each pair once, in either order by turns, so that tasks have like shares; Spark pairs files without a shuffle.
    once = F.when((F.col("no") + F.col("no2")) % 2 == 0, F.col("no") <= F.col("no2")).otherwise(F.col("no") > F.col("no2"))
    bit = F.expr("shiftrightunsigned(near[cell2 div 64], cast(cell2 % 64 AS int)) & 1 = 1")
    pairs = left.join(right.hint("shuffle_replicate_nl"), (F.col("dim") == F.col("dim2")) & once & bit)
    pairs = pairs.select("no", "dim", "sizes", "raws", "codes", "factors", "no2", "sizes2", "raws2")
    found = map_batches(pairs, lambda it: _link_tiles(it, least, kind), "a long, b long, n long")
    found = scratch.table(found, "found")  # read by the caller's session again

    nodes = connected_components(scratch, found.where("b IS NOT NULL").select("a", "b"), contracted=True)
    counts = found.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("n"))
    classes = tiles.select("no", "dim", F.posexplode(F.arrays_zip("keys", "sizes", "least")).alias("at", "m"))
    classes = classes.select((F.shiftleft("no", 32) + F.col("at")).alias("class"), "dim", F.col("m.keys").alias("key"), F.col("m.sizes").alias("size"), F.col("m.least").alias("least"))
    known = classes.join(counts, F.col("class") == F.col("a"), "left").join(nodes, F.col("class") == F.col("node"), "left")
    known = known.select("dim", "key", "least", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "class").alias("root"))
    lowest = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = known.join(lowest, "root").select(F.col("dim").alias("d"), F.col("key").alias("u"), "n_links", "component_id")
    known = scratch.table(known, "named")  # apart from what groups it, so that Spark can split a large component
    # Were a direction on the edge of two cells ever dealt to both, its classes are linked and say the same.
    known = known.groupBy("d", "u").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = rows.join(known, (F.col("key") == F.col("u")) & (F.col("dim") == F.col("d")), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    out = out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    return scratch.finish(out, "rows", "tiles", "found", "components", "named")
