"""Alignment of two word sequences and the differences that follow from it."""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SCHEMA = "pair string, op_idx int, tag string, a_lo int, a_hi int, b_lo int, b_hi int"
_ERRORS = "pair string, err_id long, type string, wrong string, correct string, a_pos int, b_pos int"
_ERROR_KINDS = [pa.string(), pa.int64(), *[pa.string()] * 3, *[pa.int32()] * 2]
_SUMMARY = "pair string, n_ops long, n_equal long, n_a long, n_b long, begins int"
_AROUND = "before string, after string, after_stop boolean, context string, transcript_context string, t double, phantom double"

#: Marks that end a sentence.
_STOP = re.compile(r"[.!?…]$")
Op = tuple[str, int, int, int, int]


def opcodes_of(a: list[str], b: list[str]) -> list[Op]:
    """Operations that turn ``a`` into ``b``: equal, replace, delete, insert over word ranges.

    One rule at any length, the longest run in common first, and frequent words
    are never treated as junk.  Where a word in common occurs once on each side
    time follows the length, else how often the words of one side occur on the
    other and how many runs there are.
    """
    blocks = _blocks_of(a, b)
    if blocks is None:
        return SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
    ops: list[Op] = []
    i = p = 0
    for at, to, n in [*blocks, (len(a), len(b), 0)]:
        if i < at or p < to:
            ops.append(("replace" if i < at and p < to else "delete" if i < at else "insert", i, at, p, to))
        if n:
            ops.append(("equal", at, at + n, to, to + n))
        i, p = at + n, to + n
    return ops


def _blocks_of(a: list[str], b: list[str]) -> list[tuple[int, int, int]] | None:
    """(a_lo, b_lo, length) of the matches that ``SequenceMatcher`` finds, or None if a word in common occurs twice on a side.

    The runs of such words share no place, so of two runs either both fit or
    one crosses the other.  ``SequenceMatcher`` takes the longest, the first of
    equal ones, and goes on at either side of it; that is to take them in this
    order, each unless it crosses the taken ones beside it.
    """
    place = dict(zip(b, range(len(b)), strict=True))
    to = [place.get(w, -1) for w in a]
    found = [p for p in to if p >= 0]
    if len(set(found)) < len(found):
        return None
    if len(place) < len(b):
        known = set(a)
        if sum(w in known for w in b) > len(found):
            return None
    runs: list[list[int]] = []  # (-length, a_lo, b_lo)
    after = -1
    for i, p in enumerate(to):
        if p < 0:
            after = -1
            continue
        if p == after:
            runs[-1][0] -= 1
        else:
            runs.append([-1, i, p])
        after = p + 1
    starts: list[int] = []
    taken: list[tuple[int, int, int]] = []
    for n, i, p in sorted(runs):
        k = bisect(starts, i)
        if (k == 0 or taken[k - 1][1] + taken[k - 1][2] <= p) and (k == len(taken) or p - n <= taken[k][1]):
            starts.insert(k, i)
            taken.insert(k, (i, p, -n))
    return taken


def errors_of(a: list[str], b: list[str], ops: list[Op]) -> Iterator[tuple[str, str, str, int, int]]:
    """(type, wrong, correct, a_pos, b_pos): one row a word that differs.

    A word heard but not expected is an insertion, one expected but not heard
    a deletion.  Replaced blocks pair word by word; the surplus of the longer
    side becomes insertions or deletions.  An insertion and a deletion of one
    word around a single equal word make a transposition.
    """
    k = 0
    while k < len(ops):
        tag, i, j, p, q = ops[k]
        if tag in ("insert", "delete") and k + 2 < len(ops) and ops[k + 1][0] == "equal" and {tag, ops[k + 2][0]} == {"insert", "delete"}:
            _, i1, j1, _, _ = ops[k + 1]
            _, i2, j2, p2, q2 = ops[k + 2]
            if max(j - i, q - p) == j1 - i1 == max(j2 - i2, q2 - p2) == 1 and (b[p] == a[i2] if tag == "insert" else a[i] == b[p2]):
                yield "transposition", " ".join(a[i : i + 2]), " ".join(b[p : p + 2]), i, p
                k += 3
                continue
        if tag != "equal":
            for n in range(max(j - i, q - p)):
                wrong, correct = a[i + n] if i + n < j else "", b[p + n] if p + n < q else ""
                yield "insertion" if not correct else "deletion" if not wrong else "substitution", wrong, correct, min(i + n, j), min(p + n, q)
        k += 1


def align(pairs: DataFrame) -> DataFrame:
    """(pair, op_idx, tag, a_lo, a_hi, b_lo, b_hi) for each row (pair, a, b) of word arrays.

    ``a`` is what was heard, ``b`` what was expected.  A row holds both sides,
    so pairs spread over tasks without a shuffle.  A null side has no words.
    """

    kinds = [pa.string(), pa.int32(), pa.string(), *[pa.int32()] * 4]
    return _told(pairs.select(F.col("pair").cast("string"), "a", "b"), _ops_of, kinds, _SCHEMA)


def summaries(pairs: DataFrame, run: int = 4) -> DataFrame:
    """(pair, n_ops, n_equal, n_a, n_b, begins): a row for each row (pair, a, b), so that no operations have to move.

    ``begins`` is where the first ``run`` successive matched words begin in
    ``a``, null without such a run.
    """

    def one(pair: str, a: list[str] | None, b: list[str] | None) -> list[tuple]:
        a, b = a or [], b or []
        ops = opcodes_of(a, b)
        return [(pair, len(ops), sum(op[2] - op[1] for op in ops if op[0] == "equal"), len(a), len(b), _begins(ops, run))]

    return _told(pairs.select(F.col("pair").cast("string"), "a", "b"), one, [pa.string(), *[pa.int64()] * 4, pa.int32()], _SUMMARY)


def _begins(ops: list[Op], run: int) -> int | None:
    return next((i for tag, i, j, _, _ in ops if tag == "equal" and j - i >= run), None)


def _ops_of(pair: str, a: list[str] | None, b: list[str] | None) -> list[tuple]:
    return [(pair, n, *op) for n, op in enumerate(opcodes_of(a or [], b or []))]


def _told(pairs: DataFrame, one: Callable[..., list[tuple]], kinds: list[pa.DataType], schema: str, most: int = 10_000) -> DataFrame:
    """The rows that ``one`` makes of each row, in batches of some ``most`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for k in range(len(batch)):
                rows += one(*(c[k].as_py() for c in batch.columns))
                if len(rows) >= most:
                    yield _batch(rows, kinds, schema)
                    rows = []
        if rows:
            yield _batch(rows, kinds, schema)

    return pairs.mapInArrow(run, schema)


def _batch(rows: list[tuple], kinds: list[pa.DataType], schema: str) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])


def differences(pairs: DataFrame) -> DataFrame:
    """(pair, err_id, type, wrong, correct, a_pos, b_pos): one row a word that differs, as ``errors_of`` tells."""

    def one(pair: str, a: list[str] | None, b: list[str] | None) -> list[tuple]:
        a, b = a or [], b or []
        return [(pair, n, *error) for n, error in enumerate(errors_of(a, b, opcodes_of(a, b)), 1)]

    return _told(pairs.select(F.col("pair").cast("string"), "a", "b"), one, _ERROR_KINDS, _ERRORS)


def in_context(pairs: DataFrame, around: int, run: int = 4) -> DataFrame:
    """``differences`` with what stands around them and when they are heard.

    The expected words before and after (null beyond the ends), whether a
    sentence ended just before, ``around`` words on either side of both texts,
    the time, and when the introduction ends (``phantom_seconds``).  ``pairs``
    may bring ``times`` of the heard words and ``tokens``, the expected ones as
    written; without them times are 0 and the words as compared stand for them.

    A row holds both sides, so what a difference needs of them goes with it:
    no words are joined back, and nothing is sorted or shuffled.
    """
    empty = {"times": F.lit(None).cast("array<double>"), "tokens": F.lit(None).cast("array<string>")}
    columns = [F.col("pair").cast("string"), "a", "b", *[F.col(c).cast(f"array<{t}>") if c in pairs.columns else empty[c].alias(c) for c, t in (("times", "double"), ("tokens", "string"))]]
    cut = lambda words, at: " ".join(words[max(at - around, 0) : max(at - around, 0) + 2 * around + 1])

    def one(pair: str, a: list[str] | None, b: list[str] | None, times: list[float] | None, tokens: list[str] | None) -> list[tuple]:
        a, b, times = a or [], b or [], times or []
        tokens = b if tokens is None else tokens
        ops = opcodes_of(a, b)
        begins = _begins(ops, run)
        clock = lambda at: times[min(at, len(times) - 1)] or 0.0 if times else 0.0
        phantom = clock(begins) if begins is not None else 0.0
        out = []
        for n, (type_, wrong, correct, i, p) in enumerate(errors_of(a, b, ops), 1):
            next_ = p + (type_ != "insertion")
            stop = p == 0 or (p <= len(tokens) and bool(_STOP.search(tokens[p - 1] or "")))
            out.append((pair, n, type_, wrong, correct, i, p, b[p - 1] if p else None, b[next_] if next_ < len(b) else None, stop, cut(tokens, p), cut(a, i), clock(i), phantom))
        return out

    kinds = [*_ERROR_KINDS, *[pa.string()] * 2, pa.bool_(), *[pa.string()] * 2, *[pa.float64()] * 2]
    return _told(pairs.select(*columns), one, kinds, f"{_ERRORS}, {_AROUND}")


def similarity(ops: DataFrame) -> DataFrame:
    """(pair, n_equal, n_a, n_b, ratio): twice the equal words over all words; 1 for two empty sides."""
    out = ops.groupBy("pair").agg(
        F.sum(F.when(F.col("tag") == "equal", F.col("a_hi") - F.col("a_lo")).otherwise(0)).cast("long").alias("n_equal"),
        F.max("a_hi").cast("long").alias("n_a"),
        F.max("b_hi").cast("long").alias("n_b"),
    )
    return ratio(out)


def ratio(out: DataFrame) -> DataFrame:
    """``out`` (n_equal, n_a, n_b) with the ratio of ``similarity``."""
    return out.withColumn("ratio", F.when(F.col("n_a") + F.col("n_b") > 0, 2 * F.col("n_equal") / (F.col("n_a") + F.col("n_b"))).otherwise(1.0))


def phantom_seconds(ops: DataFrame, timed: DataFrame, run: int = 4) -> DataFrame:
    """(pair, phantom): when the first ``run`` successive matched words begin; what is heard before is an introduction.

    ``timed`` has (pair, pos, t).  Without such a run nothing is skipped (0).
    """
    first = ops.where(f"tag = 'equal' AND a_hi - a_lo >= {int(run)}").groupBy("pair").agg(F.min("a_lo").alias("pos"))
    found = first.join(timed.select(F.col("pair").cast("string"), "pos", "t"), ["pair", "pos"], "left")
    return ops.select("pair").distinct().join(found, "pair", "left").select("pair", F.coalesce("t", F.lit(0.0)).alias("phantom"))


def skip_phantom(errors: DataFrame, phantom: DataFrame | float) -> DataFrame:
    """Errors (pair, t) from the end of the introduction on: a table of ``phantom_seconds``, or fixed seconds."""
    if isinstance(phantom, DataFrame):
        return errors.join(phantom, "pair").where("t >= phantom").drop("phantom")
    return errors.where(F.col("t") >= F.lit(float(phantom)))


def around(words: Column, at: Column, k: int) -> Column:
    """The words from k before to k after place ``at`` of an array, as a text."""
    first = F.greatest(at - k + 1, F.lit(1))
    return F.array_join(F.slice(words, first, at + k + 2 - first), " ")
