"""Substring dedup: MinHash bands over short paragraphs, exact Jaccard, classes, runs."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from collatura.llm.collide import Alike, classes, kept, open_keys
from collatura.llm.common import Scratch, bit_filter, in_filter, names_beside, slices

#: Words of a shingle, least similarity, words from which a paragraph is compared and from which a run of repeated ones counts.
SHINGLE, LEAST, PARAGRAPH, RUN = 5, 0.8, 8, 20
#: Recall that the bands must reach for a pair at the least similarity, and hashes in a band.
RECALL, ROWS = 0.999, 2

#: Paragraphs end at line ends and after the marks that end a sentence, as passages are copied into the middle of lines.
_ENDS = [(mark + space, mark + b"\n") for mark in (b".", b"!", b"?") for space in (b" ", b"\t", b"\r")]


def tune(least: float = LEAST, recall: float = RECALL, rows: int = ROWS) -> int:
    """The least number of bands with which a pair at similarity ``least`` collides with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - least**rows))


def _joined(short: list[list[bytes]], before: int, least: int) -> Iterator[tuple[int, list[bytes]]]:
    """Successive short paragraphs as units of ``least`` words or more: from each one on, and up to each one.

    Units overlap, so a passage gives the same ones whatever stands around it.
    Starts and ends both rise from unit to unit.  Too few words for one are
    given as they are.
    """
    words = [w for p in short for w in p]
    ends = [0, *accumulate(map(len, short))]
    if len(words) < least:
        yield before, words
        return
    spans = {(i, ends[bisect_left(ends, i + least)]) for i in ends if i + least <= len(words)}
    spans |= {(ends[bisect_right(ends, j - least) - 1], j) for j in ends if j >= least}
    for i, j in sorted(spans):
        yield before + i, words[i:j]


def paragraphs(text: bytes, least: int = PARAGRAPH) -> Iterator[tuple[int, list[bytes]]]:
    """(number of words before, lower-cased words) of each paragraph; successive ones under ``least`` words are joined."""
    before = 0
    short: list[list[bytes]] = []
    waiting = 0  # words in ``short``
    text = text.lower()
    for end, line_end in _ENDS:
        text = text.replace(end, line_end)
    for words in map(bytes.split, text.split(b"\n")):
        if not words:
            continue
        if len(words) < least:
            short.append(words)
            waiting += len(words)
        else:
            if short:
                yield from _joined(short, before - waiting, least)
                short, waiting = [], 0
            yield before, words
        before += len(words)
    if short:
        yield from _joined(short, before - waiting, least)


def _digests(words: list[bytes], size: int = SHINGLE) -> list[bytes]:
    return list(map(xxhash.xxh64_digest, map(b" ".join, zip(*(words[i:] for i in range(size)))))) or [xxhash.xxh64_digest(b" ".join(words))]


def shingles(words: list[bytes], size: int = SHINGLE) -> list[int]:
    """The words' shingles by hash; fewer words than a shingle form one."""
    return [int.from_bytes(x, "big") for x in _digests(words, size)]


def number(words: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(words), 1)


def _salts(n: int) -> np.ndarray:
    return np.random.default_rng(6).integers(0, 1 << 63, (2, n), np.uint64) | np.uint64(1)


def band_keys(flat: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(paragraphs, bands) keys: for each band a hash of ``rows`` minima over the paragraph's shingles."""
    salt = _salts(bands * rows)
    out = np.empty((len(starts), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(starts), band + 1, np.uint64)
        for r in range(rows):
            times, plus = salt[:, band * rows + r]
            mixed = (flat ^ plus) * times
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            key = (key * np.uint64(0x9E3779B97F4A7C15)) ^ np.minimum.reduceat(mixed, starts)
            key ^= key >> np.uint64(31)
        out[:, band] = key
    return out


def _binary(column: pa.Array) -> pa.Array:
    return column.cast(pa.binary() if column.type == pa.string() else pa.large_binary())


def _scan(batches: Iterator[pa.RecordBatch], least_words: int, remember: int = 300_000) -> Iterator[pa.RecordBatch]:
    """Paragraphs with at least ``least_words`` words; shingles only where a task meets the paragraph first."""
    seen: set[int] = set()
    for batch in slices(batches, 2 << 20):
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            per_doc, pos, word, size, unit, made, ends = [], [], [], [], [], [], []
            for text in _binary(part.column(2)):
                k = 0
                for before, words in paragraphs(text.as_py() or b"", least_words):
                    if len(words) < least_words:
                        continue
                    u = number(words)
                    pos.append(k)
                    word.append(before)
                    size.append(len(words))
                    unit.append(u)
                    k += 1
                    if u not in seen:
                        if len(seen) >= remember:
                            seen.clear()
                        seen.add(u)
                        made += _digests(words)
                        ends.append(len(made))
                    else:
                        ends.append(None)
                per_doc.append(k)
            new = np.array([e is not None for e in ends], bool)
            last = np.maximum.accumulate(np.array([0, *(e or 0 for e in ends)], np.int32))
            bodies = pa.ListArray.from_arrays(pa.array(last), pa.array(np.frombuffer(b"".join(made), ">i8").astype(np.int64)), mask=pa.array(~new))
            doc, mix = (pa.array(np.repeat(np.arange(len(part)), per_doc)) for _ in range(2))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(doc), part.column(1).take(mix), pa.array(pos, pa.int32()), pa.array(word, pa.int64()), pa.array(size, pa.int32()), pa.array(np.array(unit, np.uint64).view(np.int64)), bodies],
                names=["doc_id", "mix", "pos", "word", "size", "unit", "shingles"],
            )


def _keys(batches: Iterator[pa.RecordBatch], bands: int, rows: int, sent: Broadcast | None) -> Iterator[pa.RecordBatch]:
    """(key, id): the band keys of each paragraph (unit, shingles)."""
    for batch in slices(batches, 1 << 20):
        if len(batch):
            flat, size = batch.column(1).flatten().to_numpy().view(np.uint64), np.diff(batch.column(1).offsets.to_numpy())
            keys = band_keys(flat, np.concatenate([[0], np.cumsum(size)[:-1]]), bands, rows).view(np.int64).ravel()
            fine = kept(keys, sent)
            yield pa.RecordBatch.from_arrays([pa.array(keys[fine]), pa.array(np.repeat(batch.column(0).to_numpy(), bands)[fine])], names=["key", "id"])


def _bodies(batches: Iterator[pa.RecordBatch], wanted: Broadcast, remember: int = 300_000) -> Iterator[pa.RecordBatch]:
    """(id, body) of the paragraphs (unit, shingles) that may be wanted, those a task has sent before left out."""
    sent: set[int] = set()
    for batch in batches:
        batch = batch.filter(pa.array(in_filter(wanted.value, batch.column(0).to_numpy().view(np.uint64))))
        ids = batch.column(0).to_pylist()
        fresh = [x not in sent for x in ids]
        if len(sent) > remember:
            sent.clear()
        sent.update(ids)
        batch = batch.filter(pa.array(fresh, pa.bool_()))
        flat, row = batch.column(1).flatten().to_numpy(), np.repeat(np.arange(len(batch)), np.diff(batch.column(1).offsets.to_numpy()))
        order = np.lexsort((flat, row))
        flat, row = flat[order], row[order]
        once = np.ones(len(flat), bool)
        once[1:] = (flat[1:] != flat[:-1]) | (row[1:] != row[:-1])
        ends = np.concatenate([[0], np.cumsum(np.bincount(row[once], minlength=len(batch)))]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat[once]))], names=["id", "body"])


def similar(bodies: pa.Array, least: float) -> Alike:
    """Comparison of the rows of a tile by the Jaccard similarity of their distinct shingles."""
    if len(bodies) <= 4:
        flat, ends = bodies.flatten().to_numpy().tolist(), bodies.offsets.to_numpy().tolist()
        sets = [set(flat[a - ends[0] : b - ends[0]]) for a, b in zip(ends, ends[1:])]

        def few(i: int, others: np.ndarray) -> np.ndarray:
            both = [len(sets[i] & sets[j]) for j in others.tolist()]
            return np.array([n >= least * (len(sets[i]) + len(sets[j]) - n) - 1e-12 for n, j in zip(both, others.tolist())])

        return few
    size = np.diff(bodies.offsets.to_numpy())
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    each, at = np.unique(bodies.flatten().to_numpy(), return_inverse=True)
    mark = np.zeros(len(each), np.int64)

    def hits(i: int, others: np.ndarray) -> np.ndarray:
        own = at[start[i] : start[i] + size[i]]
        mark[own] = 1
        both = np.add.reduceat(mark[at], start)[others]
        mark[own] = 0
        return both >= least * (size[i] + size[others] - both) - 1e-12

    return hits


def repeated_passages(docs: DataFrame, least: float = LEAST, least_words: int = PARAGRAPH, run_words: int = RUN, recall: float = RECALL) -> DataFrame:
    """Runs of paragraphs that occur, alike, in other documents too: a row for each run of a document.

    (doc_id, start_word, stop_word, passage, n_docs, removed, parts): words
    [start, stop) of the lower-cased text; ``passage`` is a number that alike
    runs' first paragraphs share; ``n_docs`` is how many documents hold the
    most common of its paragraphs.  A paragraph is a sentence or line, or
    successive ones of under ``least_words`` words joined until they have as many.  Two
    with a shingle Jaccard of ``least`` or more are linked, and their component
    is one class.  Consecutive paragraphs of repeated classes, with at least
    ``run_words`` words from the first to the last, make a run.  Of each class
    the occurrence first by (doc_id, text hash, position) stays; ``parts`` cuts
    a run where first occurrences and later ones meet, and says of each part
    (start_word, stop_word, removed) whether it goes.  ``removed`` is whether
    the whole run goes.

    Null and blank texts have no paragraphs.  Equal rows (same doc_id and text)
    are one document; rows with a null doc_id are compared, and each text among
    them is a document.  Paragraphs repeated only within one document are no
    run.  Empty tables and tables without repeats give no rows.
    """
    scratch = Scratch(docs.sparkSession, "passages", tidy=True)
    bands = tune(least, recall)
    texts = names_beside(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("mix"), "text")
    found = texts.mapInArrow(lambda it: _scan(it, least_words), "doc_id long, mix long, pos int, word long, size int, unit long, shingles array<long>")
    found = scratch.table(found, "found")
    whole = found.where("shingles IS NOT NULL").select("unit", "shingles")

    def bodies(ids: DataFrame, n: int) -> DataFrame:
        wanted = docs.sparkSession.sparkContext.broadcast(bit_filter(ids, n))
        made = whole.mapInArrow(lambda it: _bodies(it, wanted), "id long, body array<long>")
        return made.join(ids, "id", "left_semi").groupBy("id").agg(F.any_value("body").alias("body")).withColumn("size", F.size("body"))

    opened = open_keys(whole, lambda it: _keys(it, bands, ROWS, None))
    near = classes(scratch, lambda sent: whole.mapInArrow(lambda it: _keys(it, bands, ROWS, sent), "key long, id long"), bodies, lambda held: similar(held, least), opened=opened)
    # Documents of a class: ids, and of rows without one the texts.
    nameless = F.when(F.col("doc_id").isNull(), F.col("mix"))
    docs_of = [f(x).alias(f"{n}_{f.__name__}") for n, x in (("id", F.col("doc_id")), ("own", nameless)) for f in (F.min, F.max)]
    again = [f(f"{n}_{f.__name__}").alias(f"{n}_{f.__name__}") for n in ("id", "own") for f in (F.min, F.max)]
    several = "coalesce(id_min <> id_max, false) OR coalesce(own_min <> own_max, false) OR (id_min IS NOT NULL AND own_min IS NOT NULL)"
    units = found.groupBy("unit").agg(*docs_of)
    units = units.join(near.withColumnRenamed("node", "unit"), "unit", "left").where(f"component IS NOT NULL OR {several}").withColumn("class", F.coalesce("component", "unit"))
    units = scratch.table(units.drop("component"), "units")
    repeated = scratch.table(units.groupBy("class").agg(*again).where(several).select("class"), "repeated")  # apart from the joins, whose hot classes Spark can then split
    units = units.select("unit", "class").join(repeated, "class", "left_semi")
    hits = scratch.table(found.drop("shingles").join(units, "unit").drop("unit").distinct(), "hits")
    each = hits.groupBy("class", "doc_id", nameless.alias("own")).agg(F.min(F.struct("mix", "pos")).alias("at"))
    each = each.groupBy("class").agg(F.count("*").alias("n_docs"), F.min(F.struct("doc_id", "at.mix", "at.pos")).alias("first"))
    each = scratch.table(each, "each")
    hits = hits.join(each, "class").withColumn("is_first", F.struct("doc_id", "mix", "pos").eqNullSafe(F.col("first"))).drop("first")
    island = F.col("pos") - F.row_number().over(Window.partitionBy("doc_id", "mix").orderBy("pos"))
    alike = F.col("pos") - F.row_number().over(Window.partitionBy("doc_id", "mix", "is_first").orderBy("pos"))
    parts = hits.withColumns({"island": island, "part": alike}).groupBy("doc_id", "mix", "island", "is_first", "part")
    parts = parts.agg(
        F.min("pos").alias("pos"),
        F.min("word").alias("start_word"),
        F.max(F.col("word") + F.col("size")).alias("stop_word"),
        F.min_by("class", "pos").alias("passage"),
        F.max("n_docs").alias("n_docs"),
    )
    # Where paragraphs overlap, a word of a first occurrence stays.
    beside = Window.partitionBy("doc_id", "mix", "island").orderBy("pos")
    since = F.when(F.col("is_first"), F.col("start_word")).otherwise(F.greatest("start_word", F.lag("stop_word").over(beside)))
    until = F.when(F.col("is_first"), F.col("stop_word")).otherwise(F.least("stop_word", F.lead("start_word").over(beside)))
    parts = parts.withColumn("part", F.struct(since.alias("start_word"), until.alias("stop_word"), (~F.col("is_first")).alias("removed")))
    runs = parts.groupBy("doc_id", "mix", "island").agg(
        F.min("start_word").alias("start_word"),
        F.max("stop_word").alias("stop_word"),
        F.min_by("passage", "pos").alias("passage"),
        F.max("n_docs").alias("n_docs"),
        (~F.bool_or("is_first")).alias("removed"),
        F.array_sort(F.collect_list(F.when(F.col("part.start_word") < F.col("part.stop_word"), F.col("part")))).alias("parts"),
    ).where(F.col("stop_word") - F.col("start_word") >= run_words)
    out = runs.select("doc_id", "start_word", "stop_word", "passage", "n_docs", "removed", "parts")
    return scratch.finish(out, "found", "units", "repeated", "hits", "each", "classes")
