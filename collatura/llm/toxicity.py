"""Toxicity: noisy-channel deobfuscation, then a linear score of the restored words."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from collatura.llm.common import Scratch, before_edge, bit_filter, in_filter, map_batches, names_beside, slices

#: Hash buckets of word features, which bound their number; labelled rows the classifier is fitted on at most.
BUCKETS, FIT_ROWS = 1 << 20, 50_000
#: Readings of one obfuscated token that are scored, and tokens a task remembers (longer ones than LONG are decoded anew).
READINGS, REMEMBERED, LONG = 3, 320_000, 40
#: Prefix lengths that stand for a word beside the word itself.
PREFIXES = (4, 5, 6)

#: What a symbol may stand for (fixed values): look-alikes, and symbols that only separate or mask.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "†": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
}
#: Letters of other alphabets that look like Latin ones (fixed values).
TWINS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "і": "i", "ѕ": "s", "ј": "j",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}
SEPARATORS = ".-_*~'`^·/\\ "
#: Costs (in nats) of the channel: a look-alike, a dropped symbol, a dropped repeat of a letter, a kept one.
SWAP, DROP, SQUEEZE, REPEAT = 1.0, 1.0, 0.7, 0.7

_WORD = re.compile(r"[^\W\d_]+")
_SPACED = re.compile(r"(?<!\w)(?:\w[ .\-_*]{1,2}){2,}\w(?!\w)")
#: Symbols that hang on a word and can only be dropped, so the word reads the same without them.
_HANGING = ".,;:?\"')]}[{#%&>=" + SEPARATORS
_NO_LETTER = re.compile(r"[\W\d_]+")
#: Where a lattice branches: a repeated letter, a look-alike.
_BRANCH = re.compile(rf"([^\W\d_])\1|[{re.escape(''.join(LOOKALIKES) + ''.join(TWINS))}]")

# Symbols of the character model: 0 ends a word, a-z, the letters from ß to ÿ, and one for all other letters.
_OTHER = 60
_SYMBOL = np.full(0x3000, _OTHER, np.uint8)
for _c in range(0x3000):
    _SYMBOL[_c] = _c - 96 if 97 <= _c <= 122 else _c - 196 if 0xDF <= _c <= 0xFF and _c != 0xF7 else _OTHER if chr(_c).isalpha() else 0


def symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _SYMBOL[np.minimum(points, 0x2FFF)].astype(np.int64)


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts (64, 64, 64) of three successive symbols over all texts; summed in tasks, then over them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, open_, size = np.zeros(1 << 18, np.int64), [], 0

        def add() -> None:
            s = symbols(f" {'  '.join(open_)} ".lower())
            counts[:] += np.bincount((s[:-2] << 12) | (s[1:-1] << 6) | s[2:], minlength=1 << 18)

        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                open_.append(text or "")
                size += len(open_[-1])
                if size > 1_000_000:
                    add()
                    open_, size = [], 0
        if size > 1:
            add()
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["gram", "n"])

    rows = map_batches(names_beside(docs, "text"), run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << 18, np.int64)
    out[rows["gram"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out.reshape(64, 64, 64)


def language_model(counts: np.ndarray, weight: float = 5.0) -> np.ndarray:
    """Log-probabilities [a, b, c] of c after a and b, smoothed by the pair's and the single symbol's."""
    pair = counts.sum(axis=0).astype(float)
    single = pair.sum(axis=0)
    p1 = (single + 0.5) / (single + 0.5).sum()
    p2 = (pair + weight * p1) / (pair.sum(axis=1, keepdims=True) + weight)
    p3 = (counts + weight * p2) / (counts.sum(axis=2, keepdims=True) + weight)
    return np.log(p3).astype(np.float32)


def flat(model: np.ndarray) -> memoryview:
    """The model's log-probabilities by (a << 12) | (b << 6) | c, quick to read one by one."""
    return memoryview(np.ascontiguousarray(model, np.float32).reshape(-1))


def _code(letter: str) -> int:
    return int(_SYMBOL[min(ord(letter), 0x2FFF)])


def _arcs(ch: str, again: bool) -> list[tuple[str, float]]:
    """What a character may stand for, and at which cost; again: it repeats the one before."""
    if ch.isalpha():
        own = [(ch, REPEAT if again else 0.0)] + ([("", SQUEEZE)] if again else [])
        return own + [(x, SWAP) for x in TWINS.get(ch, "")]
    return [(x, SWAP) for x in LOOKALIKES.get(ch, "")] + [("", DROP / 2 if ch in SEPARATORS else 3 * DROP)]


def decode(token: str, model: np.ndarray | memoryview, best: int = READINGS) -> list[str]:
    """The ``best`` readings of a token under channel and character model, by Viterbi search.

    The lattice offers each character's letters, dropping a separator or
    symbol, and dropping or keeping a repeated letter; a state is the last two
    letters emitted and all states are kept.  Where only one state is left and
    the lattice does not branch, its only path is followed without a score.
    """
    lm = model if isinstance(model, memoryview) else flat(model)
    # A state's best path: score, letters so far as (before, letters).
    states: dict[tuple[int, int, str], tuple[float, tuple | None]] = {(0, 0, ""): (0.0, None)}
    i, n = 0, len(token)
    while i < n:
        if len(states) == 1:
            found = _BRANCH.search(token, max(i - 1, 0))
            at = n if not found else found.end() - 1
            if at > i:
                ((a, b, last), (_, path)), letters = next(iter(states.items())), _NO_LETTER.sub("", token[i:at])
                if letters:
                    before = b if len(letters) == 1 else _code(letters[-2])
                    states = {(before, _code(letters[-1]), letters[-1]): (0.0, (path, letters))}
                i = at
                continue
        ch = token[i]
        new: dict[tuple[int, int, str], tuple[float, tuple | None]] = {}
        arcs = [(letter, cost, _code(letter) if letter else 0) for letter, cost in _arcs(ch, i > 0 and ch == token[i - 1])]
        for (a, b, last), (score, path) in states.items():
            for letter, cost, c in arcs:
                if letter:
                    key, value, longer = (b, c, letter), score - cost + lm[(a << 12) | (b << 6) | c], (path, letter)
                else:
                    key, value, longer = (a, b, last), score - cost, path
                if key not in new or new[key][0] < value:
                    new[key] = value, longer
        states = new
        i += 1
    ended = []
    for (a, b, _), (score, path) in states.items():
        letters = []
        while path:
            path, x = path
            letters.append(x)
        if letters:
            ended.append((score + lm[(a << 12) | (b << 6)], "".join(reversed(letters))))
    return list(dict.fromkeys(out for _, out in sorted(ended, reverse=True)))[:best]


_WHOLE, _PREFIX = zlib.crc32(b"="), zlib.crc32(b"^")


def buckets_of(word: str) -> list[int]:
    """Hash buckets of a restored word: itself, and its prefixes."""
    whole = word.encode("utf-8", "surrogatepass")
    out = [zlib.crc32(whole, _WHOLE) % BUCKETS]
    at, code, plain = 0, _PREFIX, len(whole) == len(word)
    for k in PREFIXES:
        if len(word) < k:
            break
        code = zlib.crc32(whole[at:k] if plain else word[at:k].encode("utf-8", "surrogatepass"), code)
        out.append(code % BUCKETS)
        at = k
    return out


class Restorer:
    """Turns texts into sets of feature buckets; every token whose lattice branches is decoded.

    ``keep``: a mask of the buckets that matter; most tokens are then remembered
    as nothing.  Tokens are remembered in two generations, so frequent ones
    stay and memory keeps its bound: REMEMBERED tokens of some 170 bytes, or
    a third as many without ``keep``, as those hold all their buckets.
    """

    def __init__(self, model: np.ndarray, keep: np.ndarray | None = None):
        self.model, self.keep = model if isinstance(model, memoryview) else flat(model), keep if keep is None else keep.tobytes()
        self.most = REMEMBERED // (6 if keep is None else 2)
        self.known: dict[str, Sequence[int]] = {}
        self.older: dict[str, Sequence[int]] = {}

    def _buckets(self, words: list[str]) -> Sequence[int]:
        out = {b for w in words for b in buckets_of(w)}
        return array("i", out) if self.keep is None else tuple([b for b in out if self.keep[b]])

    def _token(self, token: str) -> Sequence[int]:
        words = [token] if token.isalpha() else _WORD.findall(token)
        if _BRANCH.search(token):
            words += decode(token, self.model)
        elif len(words) > 1:
            words.append("".join(words))  # its only reading
        return self._buckets(words)

    def _remembered(self, token: str) -> Sequence[int]:
        if len(token) > LONG:
            return self._token(token)
        found = self.older.get(token)
        if found is None:
            core = token.strip(_HANGING)
            if core == token:
                found = self._token(token)
            else:
                found = self.known.get(core)
                if found is None:
                    found = self._remembered(core) if core else ()
        known = self.known
        if len(known) >= self.most:
            self.older = known
            known = self.known = {}
        known[token] = found
        return found

    def features(self, text: str) -> set[int]:
        text = text.lower()
        out: set[int] = set()
        for token in set(text.split()):
            found = self.known.get(token)
            if found is None:
                found = self._remembered(token)
            if found:
                out.update(found)
        for spaced in set(_SPACED.findall(text)):
            joined = re.sub(r"[ .\-_*]", "", spaced)
            for part in (joined, joined[1:], joined[:-1]):
                out.update(self._buckets(decode(part, self.model, 2)))
        return out


def _mapped(docs: DataFrame, columns: list[str], fn, schema: str, arrow: pa.Schema) -> DataFrame:
    """Rows of ``fn(values)`` over the named columns, built up by record batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = fn()
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(call(*(x.to_pylist() for x in batch.columns)), arrow.types, strict=True)], schema=arrow)

    return map_batches(names_beside(docs, *columns), run, schema)


@dataclass
class Model:
    """What scoring needs: the character model and the weights of the features that have one."""

    language: np.ndarray
    weights: dict[int, float]
    bias: float

    def scorer(self) -> Callable[[list[str | None]], np.ndarray]:
        """Scores of texts, from 0 to 1; a null text is empty."""
        dense = np.zeros(BUCKETS)
        dense[list(self.weights)] = list(self.weights.values())
        own, weight = Restorer(self.language, dense != 0), memoryview(dense)

        def run(texts: list[str | None]) -> np.ndarray:
            z = np.array([self.bias + sum([weight[x] for x in sorted(own.features(t or ""))]) for t in texts])
            return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

        return run


def logistic(rows: list[list[int]], y: np.ndarray, size: int, l2: float = 1.0, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic regression over sets of features, by Adam on all rows."""
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.fromiter((c for r in rows for c in r), np.int64, len(row))
    w, b = np.zeros(size), 0.0
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        z = np.bincount(row, w[col], len(rows)) + b
        err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.append(np.bincount(col, err[row], size) + l2 * w, err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def in_training(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 != 0


def labelled_texts(scratch: Scratch, docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """(mix, text, toxic) of each distinct labelled text of a training fold, and how many there are of each label.

    Labels meet documents on ids and text hashes alone.  Texts without a label
    are dropped where they are read, and each of the others moves once.
    """
    spark = docs.sparkSession
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    texts = names_beside(docs, "doc_id", "text").where(F.col("text").isNotNull() & in_training(F.col("doc_id"))).withColumn("mix", F.xxhash64("text"))
    told = texts.select("doc_id", "mix").join(marks, F.col("doc_id") == F.col("id")).groupBy("mix").agg(F.max("toxic").alias("toxic"))
    told = scratch.table(told, "told")
    totals = {r["toxic"]: r["n"] for r in told.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    wanted = spark.sparkContext.broadcast(bit_filter(told.select("mix"), sum(totals.values())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_filter(wanted.value, batch.column(0).to_numpy().view(np.uint64))))

    held = map_batches(texts.select("mix", "text"), run, "mix long, text string").groupBy("mix").agg(F.any_value("text").alias("text"))
    return scratch.table(held.join(told, "mix"), "rows"), totals


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the rows of ``docs`` that ``labels`` (doc_id, toxic) marks and whose doc_id is in a training fold.

    The character model counts all texts, and feature counts cover all labelled
    training texts (equal texts once, toxic if any of them is).  The regression
    then uses all features that speak for toxicity and at most FIT_ROWS labelled
    rows, chosen by hash.  Rows without a label, doc_id or text teach nothing,
    nor do labels other than 0 and 1; of several labels of a doc_id the largest
    holds.  With no positive or no negative row, and for empty tables, the
    model is a constant.  Texts of any length are read whole.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    language = spark.sparkContext.broadcast(language_model(trigram_counts(docs)))
    rows, totals = labelled_texts(scratch, docs, labels)
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        scratch.close()
        return Model(language.value, {}, 5.0 if n1 else -5.0)

    # One pass decodes the labelled texts: it counts features over all of them and gives those of the sample's rows.
    marked = rows.withColumn("chosen", before_edge(rows, "mix", FIT_ROWS))
    kinds = pa.schema([("bucket", pa.int64()), ("pos", pa.int64()), ("neg", pa.int64()), ("f", pa.list_(pa.int32())), ("toxic", pa.int32())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n = Restorer(language.value), np.zeros((2, BUCKETS), np.int64)
        none = lambda k, t: pa.nulls(k, t)
        for batch in slices(batches):
            sets, marks = [], []
            for text, toxic, kept in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = list(own.features(text))
                n[toxic, found] += 1
                if kept:
                    sets.append(np.array(found, np.int32))
                    marks.append(toxic)
            k = len(sets)
            yield pa.RecordBatch.from_arrays([*[none(k, pa.int64()) for _ in range(3)], pa.array(sets, kinds.types[3]), pa.array(marks, pa.int32())], schema=kinds)
        at = np.flatnonzero(n.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[1, at]), pa.array(n[0, at]), none(len(at), kinds.types[3]), none(len(at), pa.int32())], schema=kinds)

    seen = scratch.table(map_batches(marked.select("text", "toxic", "chosen"), counted, "bucket long, pos long, neg long, f array<int>, toxic int"), "seen")
    counts = seen.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    odds = F.log(((F.col("pos") + 0.5) / (n1 + 1)) / ((F.col("neg") + 0.5) / (n0 + 1)))
    told = counts.where("pos >= 2").withColumn("odds", odds).where("odds > 1.5").orderBy((F.col("odds") * F.col("pos")).desc(), "bucket")
    buckets = [r["bucket"] for r in told.select("bucket").collect()]  # at most BUCKETS
    place = np.full(BUCKETS, -1, np.int32)
    place[buckets] = np.arange(len(buckets))
    sent = spark.sparkContext.broadcast(place)

    def vectors():
        at = sent.value
        return lambda sets, toxic: ([(x := at[np.array(f, np.int64)])[x >= 0] for f in sets], toxic)

    # Sums over features and rows depend on their order in the last digits only; sorted, reruns agree to the bit.
    found = _mapped(seen.where("f IS NOT NULL"), ["f", "toxic"], vectors, "f array<int>, toxic int", pa.schema([("f", pa.list_(pa.int32())), ("toxic", pa.int32())])).toPandas()
    rows = sorted((sorted(x), y) for x, y in zip(found["f"], found["toxic"].tolist(), strict=True))
    w, b = logistic([x for x, _ in rows], np.array([y for _, y in rows], float), len(buckets))
    scratch.close()
    return Model(language.value, dict(zip(buckets, w.tolist(), strict=True)), float(b))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row, from its text alone; a null text is empty."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scorer():
        run = sent.value.scorer()
        return lambda ids, texts: (ids, run(texts))

    out = _mapped(docs, ["doc_id", "text"], scorer, "doc_id long, score double", pa.schema([("doc_id", pa.int64()), ("score", pa.float64())]))
    return out.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the training folds of ``labels`` and score every row of ``docs`` (doc_id, text).

    Rows with a null doc_id are scored, never learned from, and have a null
    ``held_out``.  Repeated rows score alike.  An empty table gives no rows.
    """
    return score(docs, fit(docs, labels))


def reject(docs: DataFrame, model: Model, most: float = 0.5) -> DataFrame:
    """The rows of ``docs``, columns as they are, whose score is below ``most``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = sent.value.scorer()
        for batch in slices(batches):
            yield batch.filter(pa.array(of(batch.column("text").to_pylist()) < most, pa.bool_()))

    return map_batches(docs, run, docs.schema)
