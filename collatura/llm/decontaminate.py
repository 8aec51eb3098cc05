"""Benchmark decontamination by Wu-Manber search for windows of words."""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collatura.llm.common import Scratch, map_batches, names_beside, slices

#: Bytes of benchmark text searched for in one pass; more text takes more passes.
#: A worker's tables take some 125 bytes for each, so 125 MB.
PASS_BYTES = 1_000_000

#: Lower-cases A-Z and turns every ASCII byte but letters and digits into a space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """The words: runs of digits, letters and non-ASCII characters, A-Z lower-cased."""
    return (text or b"").translate(_TABLE).split()


class WuManber:
    """Search for patterns, sequences of one length, over words as symbols.

    ``shift`` says for a block of symbols how far the window may move on;
    blocks that end a pattern (shift 0) lead to its suffix bucket, whose
    patterns are compared symbol by symbol.
    """

    def __init__(self, patterns: Iterable[tuple[bytes, ...]]):
        patterns = list(patterns)
        self.m = len(patterns[0])
        self.block = min(2, self.m)
        self.far = self.m - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], list[tuple[bytes, ...]]] = defaultdict(list)
        for p in patterns:
            for end in range(self.block, self.m + 1):
                key = p[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.far), self.m - end)
            self.bucket[p[-self.block :]].append(p)
        # Within a suffix bucket the first symbol selects the few to compare.
        self.heads = {k: self._by_head(v) for k, v in self.bucket.items()}

    @staticmethod
    def _by_head(patterns: list[tuple[bytes, ...]]) -> dict[bytes, list[tuple[bytes, ...]]]:
        out = defaultdict(list)
        for p in patterns:
            out[p[0]].append(p)
        return dict(out)

    def find(self, words: list[bytes]) -> Iterator[tuple[int, tuple[bytes, ...]]]:
        """(start, pattern) of every occurrence."""
        m, block, far, shift, heads, n = self.m, self.block, self.far, self.shift.get, self.heads, len(words)
        at = m
        while at <= n:
            key = (words[at - 2], words[at - 1]) if block == 2 else (words[at - 1],)
            move = shift(key, far)
            if move == 0:
                start = at - m
                for p in heads[key].get(words[start], ()):
                    if tuple(words[start:at]) == p:
                        yield start, p
                move = 1
            at += move


def windows_of(words: list[bytes], size: int) -> set[tuple[bytes, ...]]:
    """The windows of ``size`` consecutive words; fewer words, but some, are one."""
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def searchers(items: Iterable[tuple[str, bytes | None]], size: int) -> tuple[list[WuManber], dict[tuple[bytes, ...], list[str]]]:
    """One searcher for each length of pattern, and the items of each pattern."""
    owners: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    for item, text in items:
        for w in windows_of(words_of(text), size):
            owners[w].add(item)
    by_length = defaultdict(list)
    for w in owners:
        by_length[len(w)].append(w)
    return [WuManber(v) for _, v in sorted(by_length.items())], {k: sorted(v) for k, v in owners.items()}


def scan(words: list[bytes], found: list[WuManber], owners: dict[tuple[bytes, ...], list[str]]) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged spans [start, end) of words that are hit, and the items that occur."""
    hits, items = [], set()
    for s in found:
        for start, p in s.find(words):
            hits.append((start, start + s.m))
            items.update(owners[p])
    return merged(hits), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SCHEMA = "doc_id long, n_words long, spans array<struct<start:long,stop:long>>, items array<string>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("items", pa.list_(pa.string()))])


def _blocks(benchmark: DataFrame, most: int) -> Iterator[list]:
    """The benchmark's rows in blocks of at most ``most`` bytes (one longer row is a block), one block at a time."""
    text = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string"), F.encode("text", "UTF-8"))
    block, size = [], 0
    for item, body in text.toLocalIterator():
        if block and size + len(body) > most:
            yield block
            block, size = [], 0
        size += len(body)
        block.append((item, bytes(body)))
    yield block


def _first_blocks(benchmark: DataFrame, most: int) -> tuple[list, Iterator[list] | None]:
    """The first block, and the iterator over all blocks if there are more."""
    blocks = _blocks(benchmark, most)
    first = next(blocks)
    second = next(blocks, None)
    return first, None if second is None else chain([first, second], blocks)


_TABLES: dict[tuple[str, int], tuple] = {}


def _searchers(block: Broadcast, name: str, size: int) -> tuple[list[WuManber], dict[tuple[bytes, ...], list[str]]]:
    """A block's tables, made once a worker; only those of the last block are kept."""
    if (name, size) not in _TABLES:
        _TABLES.clear()
        _TABLES[name, size] = searchers(block.value, size)
    return _TABLES[name, size]


def occurrences(docs: DataFrame, benchmark: DataFrame, size: int = 8, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(doc_id, n_words, spans, items) of each row of ``docs``: what of ``benchmark`` occurs in it.

    ``spans`` are merged ranges of hit words, ``items`` the sorted ids of items
    with an occurring window of ``size`` words.  Only test strings travel, in
    blocks of at most ``pass_bytes``; each block takes one pass over the
    documents, and more passes are merged by row.  Null texts have no words;
    items without an id or words occur nowhere; an empty table gives no rows;
    repeated rows each give a row.
    """
    spark = docs.sparkSession
    first, blocks = _first_blocks(benchmark, pass_bytes)

    def one(rows: DataFrame, block: list) -> DataFrame:
        sent, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found, owners = _searchers(sent, name, size)
            for batch in slices(batches):
                out = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary() if batch.column(1).type == pa.string() else pa.large_binary()), strict=True):
                    words = words_of(text.as_py())
                    spans, items = scan(words, found, owners)
                    out.append({"doc_id": doc_id, "n_words": len(words), "spans": [{"start": a, "stop": b} for a, b in spans], "items": sorted(items)})
                yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

        return map_batches(names_beside(rows, "doc_id", "text"), run, _SCHEMA)

    if blocks is None:
        return one(docs, first)
    # Rows get a number that is written first, so each pass sees the same one.
    scratch = Scratch(spark, "decontaminate")
    rows = scratch.table(names_beside(docs, "doc_id", "text").withColumn("row", F.monotonically_increasing_id()), "rows")
    numbered = rows.select(F.col("row").alias("doc_id"), "text")
    parts = []
    for block in blocks:  # each is searched for before the next one is read
        parts.append(scratch.table(one(numbered, block), f"pass{len(parts)}"))
    names = [f"pass{k}" for k in range(len(parts))]
    parts = reduce(DataFrame.unionByName, parts)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                {**r, "spans": [{"start": a, "stop": b} for a, b in merged([(s["start"], s["stop"]) for s in r["spans"]])], "items": sorted(set(r["items"]))}
                for r in batch.to_pylist()
            ]
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    whole = parts.groupBy("doc_id").agg(F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    whole = whole.select("doc_id", "n_words", "spans", "items").mapInArrow(merge, _SCHEMA).withColumnRenamed("doc_id", "row")
    return scratch.finish(rows.select("doc_id", "row").join(whole, "row").select("doc_id", "n_words", "spans", "items"), "rows", *names)


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 8, least_items: int = 2, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """One row per document: words, words hit, items that occur, their digest, and the verdict.

    A document is contaminated from ``least_items`` items on, so a passage that
    one test item happens to share does not remove it.
    """
    found = occurrences(docs, benchmark, size, pass_bytes)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("items") >= least_items).alias("contaminated"),
    )


def reject(docs: DataFrame, benchmark: DataFrame, size: int = 8, least_items: int = 2, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The rows of ``docs``, columns as they are, in which fewer than ``least_items`` items occur.

    One block of test strings filters rows as they are read.  More blocks
    decide by (doc_id, text hash) first, which equal rows share.  A null or
    empty text holds no item and stays, as do repeated rows; items without an
    id or words occur nowhere; texts of any length are searched whole, and an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    first, blocks = _first_blocks(benchmark, pass_bytes)
    if blocks is None:
        sent, name = spark.sparkContext.broadcast(first), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found, owners = _searchers(sent, name, size)
            for batch in slices(batches):
                column = batch.column("text")
                texts = column.cast(pa.binary() if column.type == pa.string() else pa.large_binary())
                keep = [len(scan(words_of(t.as_py()), found, owners)[1]) < least_items for t in texts]
                yield batch.filter(pa.array(keep, pa.bool_()))

        return map_batches(docs, run, docs.schema)
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text")
    bad = contamination(keyed, benchmark, size, least_items, pass_bytes).where("contaminated").select(F.col("doc_id").alias("key")).distinct()
    return docs.join(bad, F.xxhash64("doc_id", "text") == F.col("key"), "left_anti")


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
