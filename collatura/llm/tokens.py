"""Token ids of documents in patched frame-of-reference files."""

from __future__ import annotations

import json
import pickle
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain, islice
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from collatura.llm.common import map_batches, names_beside, shared_dir, slices

#: Ids in a block, the share of them that fits the block's width, and how many pieces an encoder remembers (some 210 bytes each, so 210 MB a worker;
#: none longer than LONG).
BLOCK, FITS, REMEMBERED, LONG = 4096, 0.9, 1_000_000, 40
MAGIC = b"PFORIDS1"

_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Pieces of these characters are cut here as the byte-level rule cuts them; all others go to the library whole.
_PLAIN = re.compile(rf"[!-~\n{_LETTERS[6:]}]+\Z")
_CUT = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s0-9{_LETTERS}]+|\s+(?!\S)|\s+")


#: Marks that end a word and begin no contraction, and the last of the letters above.
_TAIL, _LAST = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", "ɏ"


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in keep]
    return dict(zip(keep, keep, strict=True)) | {b: 256 + i for i, b in enumerate(other)}


class _Awkward(Exception):
    """A piece ends in white space, so the next space need not start a token."""


class Encoder:
    """Encodes texts with a tokenizer of the tokenizers library, remembering what it has seen.

    Byte-level BPE cuts a text before every space that follows a non-space, so
    pieces between such spaces are encoded apart, each once while remembered.
    Any other kind of tokenizer encodes whole texts.
    """

    def __init__(self, spec: str, remember: int = REMEMBERED):
        self.whole, self.most = Tokenizer.from_str(spec), remember // 2
        self.model = self.whole.model
        rule = json.loads(spec)
        cut = rule.get("pre_tokenizer") or {}
        self.by_piece = rule.get("normalizer") is None and rule["model"].get("type", "BPE") == "BPE" and not rule["model"].get("dropout")
        self.by_piece &= cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True)
        self.added = [x["content"] for x in rule.get("added_tokens", [])]
        self.letters = _byte_letters()
        self.space = chr(self.letters[ord(" ")])
        self.bytes_of = [k.to_bytes(4, "little") for k in range(max(self.whole.get_vocab().values(), default=0) + 1)]
        self.pieces: dict[str, bytes] = {}  # by the piece without the space before it; never a blank one, which is awkward
        self.others: dict[str, bytes] = {}  # cuts without a space before them
        self.older: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})  # both, of the generation before

    def _all(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        """One cut of the byte-level rule."""
        spaced = word[0] == " " and not word.isspace()
        known, key = (self.pieces, word[1:]) if spaced else (self.others, word)
        if (out := self._seen(known, key)) is None:
            out = self._ids(word.encode().decode("latin-1").translate(self.letters))
            self._keep(known, key, out)
        return out

    def _ids(self, letters: str) -> bytes:
        found = self.model.tokenize(letters)
        return self.bytes_of[found[0].id] if len(found) == 1 else b"".join([self.bytes_of[t.id] for t in found])

    def _keep(self, known: dict[str, bytes], key: str, out: bytes) -> None:
        if len(key) > LONG:
            return
        if len(self.pieces) + len(self.others) >= self.most:
            self.older, self.pieces, self.others = (self.pieces, self.others), {}, {}
            known = self.pieces if known is self.older[0] else self.others
        known[key] = out

    def _seen(self, known: dict[str, bytes], key: str) -> bytes | None:
        """Remembered before: of the older generation what is met again moves on."""
        if (out := known.get(key)) is None and (out := self.older[known is not self.pieces].get(key)) is not None:
            self._keep(known, key, out)
        return out

    def rest(self, most: int) -> None:
        """Keep only the pieces met first, which are mostly the frequent ones.

        They are written down and made anew when all others are gone, as a few
        that stay where they are would hold on to all the memory around them.
        """
        first = lambda k: dict(islice(chain(self.older[k].items(), (self.pieces, self.others)[k].items()), most))
        kept = pickle.dumps((first(0), first(1)))
        self.pieces, self.others, self.older = {}, {}, ({}, {})
        self.pieces, self.others = pickle.loads(kept)

    def _unit(self, unit: str) -> bytes:
        if not _PLAIN.match(unit, 1 if unit[0] == " " else 0):
            return self._all(unit)
        cuts = _CUT.findall(unit)
        return self._word(unit) if len(cuts) == 1 else b"".join([self._word(w) for w in cuts])

    def _piece(self, piece: str) -> bytes:
        out = self.pieces.get(piece)
        if out is None:
            out = self.older[0].get(piece)
            if out is None:
                if not piece or piece[-1].isspace():
                    raise _Awkward
                core = piece.rstrip(_TAIL)
                if not core.isalpha() or (not core.isascii() and max(core) > _LAST):
                    out = self._unit(" " + piece)
                elif core is piece:
                    out = self._ids(self.space + self._mapped(piece))
                else:  # a word and what punctuation follows it are two cuts
                    out = self._piece(core) + self._tail(piece[len(core) :])
            if len(self.pieces) >= self.most or len(piece) > LONG:
                self._keep(self.pieces, piece, out)
            else:
                self.pieces[piece] = out
        return out

    def _mapped(self, word: str) -> str:
        """ASCII letters stand for themselves, so a plain word needs no mapping."""
        return word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)

    def _tail(self, marks: str) -> bytes:
        if (out := self._seen(self.others, marks)) is None:
            out = self._ids(marks)
            self._keep(self.others, marks, out)
        return out

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text as unsigned 32-bit integers."""
        if not text:
            return np.zeros(0, "<u4")
        if not self.by_piece or any(x in text for x in self.added):
            return np.frombuffer(self._all(text), "<u4")
        first, *rest = text.split(" ")
        try:
            if first and first[-1].isspace():
                raise _Awkward
            out = list(map(self.pieces.get, rest))
            if None in out:
                out = [self._piece(p) if x is None else x for p, x in zip(rest, out, strict=True)]
            out.insert(0, self._unit(first) if first else b"")
        except _Awkward:
            first, *rest = re.split(r"(?<=\S) ", text)
            out = [self._all(first), *[self._all(" " + p) for p in rest]]
        return np.frombuffer(b"".join(out), "<u4")


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(spec: str, remember: int = REMEMBERED) -> Encoder:
    """One encoder a worker, so that later tasks find what earlier ones have seen."""
    if (spec, remember) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[spec, remember] = Encoder(spec, remember)
    return _ENCODERS[spec, remember]


def pack(ids: np.ndarray, fits: float = FITS) -> bytes:
    """One block: minimum, width, packed differences, and a list of outliers.

    The width is the smallest that holds the share ``fits`` of the differences
    to the minimum; the others keep their low bits there and are patched from
    the list of (position, difference).
    """
    low = int(ids.min())
    diff = (ids - np.uint32(low)).astype(np.uint32)
    need = np.frexp(diff.astype(np.float64))[1]
    width = int(np.searchsorted(np.cumsum(np.bincount(need, minlength=33)), fits * len(diff)))
    far = np.flatnonzero(need > width)
    narrow = diff.astype("<u2" if width <= 16 else "<u4")  # outliers keep their low bits
    bits = np.unpackbits(narrow.view(np.uint8).reshape(-1, narrow.itemsize), axis=1, bitorder="little")[:, :width]
    packed = np.packbits(bits, axis=None, bitorder="little").tobytes()
    return struct.pack("<IIBI", len(ids), low, width, len(far)) + packed + far.astype("<u2").tobytes() + diff[far].astype("<u4").tobytes()


def unpack(block: bytes | memoryview) -> np.ndarray:
    n, low, width, n_far = struct.unpack_from("<IIBI", block)
    at, size = 13, (n * width + 7) // 8
    if width:
        # Each value lies in the eight bytes from the one it starts in, at a shift of less than eight bits.
        packed = bytes(block[at : at + size]) + bytes(8)
        first = np.arange(n, dtype=np.int64) * width
        words = np.ndarray((size + 1,), "<u8", packed, strides=(1,))[first >> 3]
        diff = ((words >> (first & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype("<u4")
    else:
        diff = np.zeros(n, "<u4")
    far = np.frombuffer(block, "<u2", n_far, at + size)
    diff[far] = np.frombuffer(block, "<u4", n_far, at + size + 2 * n_far)
    return diff + np.uint32(low)


class Writer:
    """Writes one file: blocks as they fill, then documents and the index of block starts."""

    def __init__(self, out: BinaryIO, block: int = BLOCK):
        assert 0 < block <= 1 << 16  # positions of outliers have 16 bits
        self.out, self.block, self.open, self.size = out, block, [], 0
        self.docs: list[tuple[int | None, int]] = []
        self.starts: list[int] = []
        self.at = out.write(MAGIC)
        self.n = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.n += len(ids)
        self.open.append(ids)
        self.size += len(ids)
        if self.size >= self.block:
            whole = np.concatenate(self.open)
            full = len(whole) // self.block * self.block
            for i in range(0, full, self.block):
                self._put(whole[i : i + self.block])
            self.open, self.size = [whole[full:]], len(whole) - full

    def _put(self, ids: np.ndarray) -> None:
        self.starts.append(self.at)
        self.at += self.out.write(pack(ids))

    def close(self) -> None:
        if self.size:
            self._put(np.concatenate(self.open))
        ids = np.array([d or 0 for d, _ in self.docs], "<i8").tobytes()
        known = np.array([d is not None for d, _ in self.docs], np.uint8).tobytes()
        sizes = np.array([n for _, n in self.docs], "<u8").tobytes()
        foot = ids + known + sizes + np.array([*self.starts, self.at], "<u8").tobytes()
        self.out.write(foot + struct.pack("<QQQQQ", len(self.docs), self.n, len(self.starts), self.block, self.at) + MAGIC)


class Reader:
    """Reads a file of ``Writer``; any range of ids costs only the blocks it touches."""

    def __init__(self, file: BinaryIO):
        self.file = file
        file.seek(0, 2)
        end = file.tell() - 48
        file.seek(end)
        tail = file.read(48)
        if tail[40:] != MAGIC:
            raise ValueError("not a file of packed ids")
        n_docs, self.n_tokens, n_blocks, self.block, at = struct.unpack("<QQQQQ", tail[:40])
        file.seek(at)
        foot = file.read(end - at)
        self.doc_ids = np.frombuffer(foot, "<i8", n_docs)
        self.known = np.frombuffer(foot, np.uint8, n_docs, 8 * n_docs).astype(bool)
        self.sizes = np.frombuffer(foot, "<u8", n_docs, 9 * n_docs).astype(np.int64)
        self.starts = np.frombuffer(foot, "<u8", n_blocks + 1, 17 * n_docs).astype(np.int64)

    def tokens(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block
        self.file.seek(int(self.starts[first]))
        raw = memoryview(self.file.read(int(self.starts[last + 1] - self.starts[first])))
        parts = [unpack(raw[self.starts[k] - self.starts[first] : self.starts[k + 1] - self.starts[first]]) for k in range(first, last + 1)]
        return np.concatenate(parts)[start - first * self.block : stop - first * self.block]

    def documents(self, chunk: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start in this file, ids) of each document, reading some ``chunk`` ids at a time."""
        ends = np.cumsum(self.sizes)
        at, buffer = 0, np.zeros(0, "<u4")
        for doc_id, known, size, end in zip(self.doc_ids.tolist(), self.known.tolist(), self.sizes.tolist(), ends.tolist(), strict=True):
            start = end - size
            if end > at + len(buffer):
                at, buffer = start, self.tokens(start, min(self.n_tokens, max(end, start + chunk)))
            yield (doc_id if known else None), start, buffer[start - at : end - at]


def _place(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path else re.sub("^file:/*", "file:///", path))


def write_ids(docs: DataFrame, spec: str, path: str, end_id: int = 0, files: int | None = None, remember: int = REMEMBERED, kept: int | None = None) -> DataFrame:
    """Encode and write all documents; returns (file, n_docs, n_tokens) of each file, in order.

    Rows are dealt by ranges of doc_id (null first; equal ids by text hash, so
    that a hot id spreads over files too), sorted, and each task writes its
    range to one file under a name of its own, renamed at the end.  A task that
    is run again writes the same bytes.  ``remember`` bounds the pieces that a
    worker remembers, ``kept`` those it keeps from task to task (None: all).
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(spec)
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    fs, base = _place(path)
    fs.create_dir(base, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        coder, end = encoder(sent.value, remember), np.array([end_id], "<u4")
        fs, base = _place(path)
        final, draft = f"{base}/ids-{part:05d}.pfor", f"{base}/.draft-{part:05d}-{attempt}"
        with fs.open_output_stream(draft) as out:
            writer = Writer(out)
            for batch in slices(batches):
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    writer.add(doc_id, np.concatenate([coder.encode(text.as_py() or ""), end]))
            writer.close()
        if kept is not None:
            coder.rest(kept)
        fs.move(draft, final)
        yield pa.RecordBatch.from_pydict({"file": pa.array([part], pa.int32()), "n_docs": pa.array([len(writer.docs)], pa.int64()), "n_tokens": pa.array([writer.n], pa.int64())})

    rows = names_beside(docs, "doc_id", "text").withColumn("mix", F.xxhash64("text"))
    rows = rows.repartitionByRange(files, "doc_id", "mix").sortWithinPartitions("doc_id", "mix").drop("mix")
    return map_batches(rows, run, "file int, n_docs long, n_tokens long")


def read_ids(spark, path: str, manifest: list) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files of ``manifest``, in their order."""
    starts, at = [], 0
    for row in sorted(manifest, key=lambda r: r["file"]):
        starts.append((row["file"], at))
        at += row["n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _place(path)
        for batch in batches:
            for part, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with fs.open_input_file(f"{base}/ids-{part:05d}.pfor") as file:
                    found = [(d, before + s, len(ids), zlib.crc32(ids.tobytes())) for d, s, ids in Reader(file).documents()]
                columns = list(zip(*found, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.createDataFrame(starts, "file int, before long").repartition(max(1, len(starts)), "file")
    return map_batches(files, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 0, path: str | None = None, remember: int = REMEMBERED, kept: int | None = None) -> DataFrame:
    """Write the ids of ``docs`` (doc_id, text) in ascending doc_id order and return them as read back.

    ``tokenizer`` is a file of the tokenizers library.  A null text is empty:
    only the end id.  Null doc_ids come first; repeated ids each keep their
    row.  An empty table gives no rows.  ``path`` is a shared folder; unset, a
    fresh one below ``spark.checkpoint.dir``.  Texts of any length are encoded
    whole.  ``remember`` and ``kept`` trade a worker's memory for time.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as file:
        spec = file.read()
    path = path or f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    manifest = write_ids(docs, spec, path, end_id, remember=remember, kept=kept).collect()  # a row a file
    return read_ids(spark, path, manifest)
