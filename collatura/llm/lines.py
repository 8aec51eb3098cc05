"""Line dedup: segment-partition edit join with bit-parallel verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collatura.llm.collide import Alike, classes, from_table
from collatura.llm.common import Scratch, bit_filter, in_filter, names_beside, slices

#: Edits within which lines are alike, and characters from which a line is compared so; shorter ones must be equal.
RADIUS, LEAST = 2, 20


def lines_of(text: str) -> list[str]:
    """The lines between line feeds, without outer white space, that are not empty."""
    return [x for line in text.split("\n") if (x := line.strip())]


def number(line: str) -> int:
    return xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), 3)


def segments(length: int, radius: int) -> list[tuple[int, int]]:
    """(start, size) of the radius + 1 segments of a line; the later ones take the odd characters."""
    base, odd = divmod(length, radius + 1)
    out, at = [], 0
    for i in range(radius + 1):
        size = base + (i > radius - odd)
        out.append((at, size))
        at += size
    return out


def probes(length: int, radius: int) -> list[tuple[int, int, int, int]]:
    """(indexed length, segment, start, size) of the substrings of a line to look up.

    For each length up to the line's and each segment, only the starts from
    which the edits left of the segment and those right of it can still sum to
    the radius.
    """
    out = []
    for other in range(max(0, length - radius), length + 1):
        shift = length - other
        for i, (start, size) in enumerate(segments(other, radius)):
            lo = max(0, start - i, start + shift - (radius - i))
            hi = min(length - size, start + i, start + shift + (radius - i))
            out += [(other, i, at, size) for at in range(lo, hi + 1)]
    return out


def banded_distance(a: str, b: str, radius: int) -> int:
    """Edit distance of ``a`` and ``b`` if at most ``radius``, else radius + 1.

    Bit-parallel over the diagonals: reach[d] has bit k set if, with d edits,
    some alignment gets past b's character at diagonal k of the current
    column.  Only the 2 radius + 1 diagonals within the radius exist.
    """
    if abs(len(a) - len(b)) > radius:
        return radius + 1
    same = _shared_prefix(a, b)  # what both begin and end with costs no edits
    a, b = a[same:], b[same:]
    same = _shared_prefix(a[::-1], b[::-1])
    a, b = a[: len(a) - same], b[: len(b) - same]
    if not a or not b:
        return max(len(a), len(b))
    width = 2 * radius + 1
    full = (1 << width) - 1
    # Column j = 0: diagonal k stands for row i = j + k - radius of a; i deletions reach row i.
    reach = [sum(1 << k for k in range(radius, width) if k - radius <= d and k - radius <= len(a)) for d in range(radius + 1)]
    window = 0  # match bits of the next character are read from a mask for each character
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    for j, ch in enumerate(b):
        # Bit k: a[j + k - radius] equals b[j].
        mask = masks.get(ch, 0)
        window = (mask >> (j - radius) if j >= radius else mask << (radius - j)) & full
        old, reach = reach, []
        for d in range(radius + 1):
            now = old[d] & window  # match: the diagonal stays
            if d:
                now |= old[d - 1]  # substitution
                now |= old[d - 1] >> 1  # b's character is extra: one row less in the next column
            # a's characters are extra: more rows in the same column, an edit each
            if d:
                now |= reach[d - 1] << 1
            reach.append(now & full & _rows(j + 1, len(a), radius, width))
        if not reach[radius]:
            return radius + 1
    k = len(a) - len(b) + radius
    return next((d for d in range(radius + 1) if reach[d] >> k & 1), radius + 1)


def _shared_prefix(a: str, b: str) -> int:
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return lo


def _rows(j: int, n: int, radius: int, width: int) -> int:
    """Diagonals whose row j + k - radius lies in 0..n."""
    lo, hi = max(0, radius - j), min(width - 1, n - j + radius)
    return ((1 << (hi + 1)) - 1) & ~((1 << lo) - 1) if hi >= lo else 0


def _keys(batches: Iterator[pa.RecordBatch], radius: int, least: int, remember: int = 300_000) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    plans: dict[int, list[tuple[bytes, int, int]]] = {}
    for batch in slices(batches, 1 << 20):
        keys, ids = [], []
        for text in batch.column(0):
            for line in lines_of(text.as_py() or ""):
                if len(line) < least or (own := number(line)) in seen:
                    continue
                if len(seen) >= remember:
                    seen.clear()
                seen.add(own)
                if (plan := plans.get(len(line))) is None:
                    if len(plans) > 10_000:
                        plans.clear()
                    indexed = [(len(line), i, at, size) for i, (at, size) in enumerate(segments(len(line), radius))]
                    plan = plans[len(line)] = [(n * (radius + 1) + i, at, at + size) for n, i, at, size in dict.fromkeys(indexed + probes(len(line), radius))]
                ids += [own] * len(plan)
                keys += [xxhash.xxh64_intdigest(line[a:b].encode("utf-8", "surrogatepass"), salt) for salt, a, b in plan]
                if len(keys) > 50_000:
                    yield _pairs(keys, ids, ["key", "id"])
                    keys, ids = [], []
        yield _pairs(keys, ids, ["key", "id"])


def _pairs(a: list[int], b: list[int], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)], names=names)


def bag(line: str) -> bytes:
    """How often each of 32 classes of characters occurs, as 16-bit counts."""
    points = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32) & 31
    return np.minimum(np.bincount(points, minlength=32), 32_767).astype(np.int16).tobytes()


def within(lines: list[str], radius: int) -> Alike:
    """Comparison of the rows of a tile by edit distance.

    An edit changes two counts of a bag by one at most, so bags further apart
    than twice the radius hold lines further apart than the radius.
    """
    bags = np.frombuffer(b"".join(map(bag, lines)), np.int16).reshape(-1, 32) if len(lines) > 3 else None

    def hits(i: int, others: np.ndarray) -> np.ndarray:
        near = np.ones(len(others), bool) if bags is None else np.abs(bags[others] - bags[i]).sum(axis=1, dtype=np.int32) <= 2 * radius
        for k in np.flatnonzero(near).tolist():
            near[k] = banded_distance(lines[i], lines[others[k]], radius) <= radius
        return near

    return hits


def line_classes(docs: DataFrame, radius: int = RADIUS, least: int = LEAST) -> DataFrame:
    """(doc_id, mix, line_no, line, class, first) of each non-empty line of each distinct row."""
    scratch = Scratch(docs.sparkSession, "lines")
    texts = names_beside(docs, "text")

    def bodies(ids: DataFrame, n: int) -> DataFrame:
        wanted = docs.sparkSession.sparkContext.broadcast(bit_filter(ids, n))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sent: set[int] = set()
            for batch in slices(batches, 1 << 20):
                lines = [x for t in batch.column(0).to_pylist() for x in lines_of(t or "") if len(x) >= least]
                own = np.array([number(x) for x in lines], np.uint64)
                at = [k for k in np.flatnonzero(in_filter(wanted.value, own)).tolist() if own[k] not in sent] if len(own) else []
                if len(sent) > 300_000:
                    sent.clear()
                sent.update(own[at].tolist())
                yield pa.RecordBatch.from_arrays([pa.array(own[at].view(np.int64)), pa.array([lines[k] for k in at], pa.string())], names=["id", "body"])

        made = texts.mapInArrow(run, "id long, body string")
        return made.join(ids, "id", "left_semi").groupBy("id").agg(F.any_value("body").alias("body")).withColumn("size", F.length("body"))

    members = scratch.table(texts.mapInArrow(lambda it: _keys(it, radius, least), "key long, id long"), "members")
    near = classes(scratch, from_table(members), bodies, lambda held: within(held.to_pylist(), radius))
    scratch.drop("members")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 20):
            out: list[list] = [[], [], [], []]
            for d, m, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = [number(x) for x in lines_of(t or "")]
                for column, values in zip(out, ([d] * len(own), [m] * len(own), range(len(own)), own), strict=True):
                    column.extend(values)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(np.array(out[3], np.uint64).view(np.int64))], names=["doc_id", "mix", "line_no", "line"])

    each = names_beside(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("mix"), "text").mapInArrow(rows, "doc_id long, mix long, line_no int, line long").distinct()
    each = each.join(near.withColumnRenamed("node", "line"), "line", "left").withColumn("class", F.coalesce("component", "line")).drop("component")
    each = scratch.table(each, "each")
    first = each.groupBy("class").agg(F.min(F.struct("doc_id", "mix", "line_no")).alias("first"), F.count("*").alias("n"))
    first = scratch.table(first, "firsts")  # apart from the join, whose hot classes Spark can then split
    return scratch.finish(each.join(first, "class").select("doc_id", "mix", "line_no", "line", "class", "n", "first"), "each", "firsts", "classes")


def line_duplicates(docs: DataFrame, radius: int = RADIUS, least: int = LEAST) -> DataFrame:
    """(doc_id, n_lines, n_repeated, n_removed, removed) of each row of ``docs`` (doc_id, text).

    Lines with at least ``least`` characters are linked at an edit distance of
    at most ``radius``; their components, and equal shorter lines, are classes.
    n_repeated counts the row's lines whose class has another occurrence
    anywhere; the occurrence first by (doc_id, text hash, line) stays and the
    others are removed (``removed`` lists their numbers, from 0, among the
    row's non-empty lines).  Null and blank texts have no lines.  Equal rows
    count as one document and each get its row; null doc_ids come first in
    order.  An empty table gives no rows.
    """
    each = line_classes(docs, radius, least)
    is_first = F.struct("doc_id", "mix", "line_no").eqNullSafe(F.col("first"))
    found = each.withColumn("is_first", is_first).groupBy("doc_id", "mix").agg(
        F.count("*").alias("n_lines"),
        F.sum((F.col("n") > 1).cast("long")).alias("n_repeated"),
        F.sort_array(F.collect_list(F.when(~F.col("is_first"), F.col("line_no")))).alias("removed"),
    )
    found = found.select(F.col("doc_id").alias("id"), F.col("mix").alias("m"), "n_lines", "n_repeated", "removed")
    rows = names_beside(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("mix"))
    out = rows.join(found, rows["doc_id"].eqNullSafe(F.col("id")) & (F.col("mix") == F.col("m")), "left")
    none = F.array().cast("array<int>")
    zero = F.lit(0).cast("long")
    removed = F.coalesce("removed", none)
    return out.select("doc_id", F.coalesce("n_lines", zero).alias("n_lines"), F.coalesce("n_repeated", zero).alias("n_repeated"), F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))
