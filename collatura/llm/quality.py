"""Quality: labels from overlapping heuristics by expectation-maximisation, then a hashed linear scorer."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby, islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collatura.llm.common import hash_sample, names_beside, slices

#: Rows the scorer is fitted on at most (chosen by hash), and its hash buckets.
FIT_ROWS, BUCKETS = 8_000, 1 << 18
GOOD, BAD, NONE = "1", "0", "-"

_SYMBOLS = re.compile(r"[^\w\s'’\-]{2,}")


def _vote(value: float, good: tuple[float, float], bad: tuple[float, float]) -> str:
    """GOOD or BAD if the value lies in that range, ends included; else none."""
    return GOOD if good[0] <= value <= good[1] else BAD if bad[0] <= value <= bad[1] else NONE


# Kinds of characters below U+3000: 1 a letter, 2 a capital one.
_KIND = np.array([2 if chr(c).isupper() else int(chr(c).isalpha()) for c in range(0x3000)], np.uint8)


def votes(text: str) -> str:
    """One vote a labeller, in the order of LABELLERS; a text without words gets a bad vote of the first alone."""
    words = text.split()
    n = len(words)
    if not n:
        return BAD + NONE * (len(LABELLERS) - 1)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    _, small, upper = np.bincount(_KIND[np.minimum(points, 0x2FFF)], minlength=3).tolist()
    lines = [x for x in text.split("\n") if x.strip()]
    longest = 1
    if any(map(eq, words, islice(words, 1, None))):
        longest = max(sum(1 for _ in g) for _, g in groupby(words))
    lower = Counter(text.lower().split())
    symbols = stops = 0
    for w, k in lower.items():
        if not w.isalpha():  # a plain word has neither
            symbols += k * bool(_SYMBOLS.search(w))
            stops += k * (w[-1] in ".!?" and w[:1].isalnum() and not w.endswith("!!"))
    return "".join((
        GOOD if n >= 5 else NONE,
        _vote(symbols / n, (0, 0.03), (0.15, 1)),
        _vote(upper / (small + upper), (0, 0.15), (0.4, 1)) if small + upper else BAD,
        _vote(lower["|"] / n, (0, 0.01), (0.08, 1)),
        _vote(len(lower) / n, (0.4, 1), (0, 0.25)) if n >= 30 else NONE,
        _vote(longest, (1, 2), (5, n)) if n >= 5 else NONE,
        _vote(1 - len(set(lines)) / len(lines), (0, 0.1), (0.3, 1)) if len(lines) > 2 else NONE,
        _vote(stops / n, (0.03, 0.4), (0, 0.004)) if n >= 30 else NONE,
        _vote(max(lower.values()) / n, (0, 0.15), (0.3, 1)) if n >= 30 else NONE,
    ))


def shape(word: str, core: str) -> str:
    """The last four characters by kind, whether a stop follows, and the use of capitals."""
    tail = core[-4:]
    kinds = "a" * len(tail) if core.isalpha() else re.sub(r"\d", "9", re.sub(r"[^\W\d_]", "a", tail))
    return kinds + ("." if word[-1] in ".!?" else ",") + ("U" if core.isupper() and len(core) > 1 else "T" if core.istitle() else "l")


def features(text: str) -> set[int]:
    """Hash buckets of the text's words, of how common their shapes are, of repeats, and of its length."""
    words = text.split()
    n, out = len(words), set()
    shapes: Counter[str] = Counter()
    for w, k in Counter(words).items():
        core = w.strip(".,;:!?\"'()")
        shapes[shape(w, core)] += k
        out.add(zlib.crc32(core.lower().encode("utf-8", "surrogatepass")) % BUCKETS)
    again = sum(map(eq, words, islice(words, 1, None)))
    marks = [f"#{x}{int(10 * k / n)}" for x, k in shapes.items()] + [f"#={int(10 * again / max(1, n))}", f"#n{n.bit_length()}"]
    return out | {zlib.crc32(m.encode("utf-8", "surrogatepass")) % BUCKETS for m in marks}


LABELLERS = ("words", "symbols", "capitals", "bars", "distinct", "runs", "lines", "sentences", "commonest")


#: How a labeller that votes does so before data speak, by class (bad, good) and vote (0, 1): a bad vote on good text is rare.
PRIOR = ((0.15, 0.85), (0.002, 0.998))
#: Texts that the prior on rates weighs as much as, whatever the number of texts; share of the sample that calibrates the scorer.
PRIOR_ROWS, CALIBRATE = 1_000, 5


def estimate(patterns: dict[str, int], rounds: int = 200) -> tuple[dict[str, float], np.ndarray, float]:
    """Posterior of GOOD for each pattern of votes, labellers' rates [class, labeller, vote], and the prior.

    Expectation-maximisation with labellers independent given the class; no
    vote says nothing.  Each labeller knows one fault, so the classes are told
    apart by where the iteration starts and by a prior on rates, which weighs
    as much as PRIOR_ROWS texts, so on more texts the data outvote it.
    """
    order = sorted(patterns)
    n = np.array([patterns[p] for p in order], float)
    code = np.array([["01-".index(v) for v in p] for p in order]).reshape(len(order), -1)
    hot = np.eye(3)[code][:, :, :2]
    good = np.where((code == 0).any(axis=1), 0.1, 0.95)
    for _ in range(rounds):
        weight = np.stack([(1 - good) * n, good * n])
        prior = (weight[1].sum() + 1) / (n.sum() + 2)
        held = np.array(PRIOR)[:, None, :] * PRIOR_ROWS * np.array([[[1 - prior]], [[prior]]])
        rates = np.einsum("cp,plv->clv", weight, hot) + held
        rates /= rates.sum(axis=2, keepdims=True)
        log = np.einsum("plv,clv->cp", hot, np.log(rates)) + np.log([[1 - prior], [prior]])
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        if np.abs(new - good).max(initial=0) < 1e-9:
            break
        good = new
    return dict(zip(order, good.tolist(), strict=True)), rates, float(prior)


@dataclass
class Model:
    posterior: dict[str, float]
    weights: np.ndarray
    bias: float


def linear(rows: list[np.ndarray], y: np.ndarray, size: int, l2: float = 1.0, steps: int = 150) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on sets of features with soft labels, by Adam on all rows."""
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    used, col = np.unique(np.concatenate(rows) if rows else np.zeros(0, np.int64), return_inverse=True)
    scale = 1 / np.sqrt(np.maximum(1, np.array([len(r) for r in rows])))
    value = scale[row]
    w, b, m, v = np.zeros(len(used)), 0.0, np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for t in range(1, steps + 1):
        z = np.bincount(row, w[col] * value, len(rows)) + b
        err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.append(np.bincount(col, err[row] * value, len(used)) + l2 * w, err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    out = np.zeros(size, np.float32)
    out[used] = w
    return out, float(b)


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, shift) of raw scores of rows that the scorer has not seen: the split at 0 agrees best with the weak labels.

    With rows of one class alone, or none, scores stay as they are.
    """
    good = y >= 0.5
    if not len(z) or good.all() or not good.any():
        return 1.0, 0.0
    order = np.argsort(z, kind="stable")
    z, good = z[order], good[order]
    right = np.concatenate([[good.sum()], good.sum() + np.cumsum(np.where(good, -1, 1))])  # below a cut: bad
    best = np.flatnonzero(right == right.max())
    k = int(best[len(best) // 2])
    cut = z[0] - 1 if k == 0 else z[-1] + 1 if k == len(z) else (z[k - 1] + z[k]) / 2
    spread = np.abs(z - cut)[np.abs(z - cut) > 0]
    slope = float(np.clip(2 / np.median(spread), 0.1, 10)) if len(spread) else 1.0
    return slope, -slope * float(cut)


def fit(docs: DataFrame) -> Model:
    """Votes of all texts by pattern (at most 3^9 patterns reach the driver), then the scorer on a bounded sample."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[str] = Counter()
        for batch in slices(batches):
            n.update(votes(t or "") for t in batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["votes", "n"])

    texts = names_beside(docs, "text")
    found = texts.mapInArrow(counted, "votes string, n long").groupBy("votes").agg(F.sum("n").alias("n")).collect()
    posterior, _, _ = estimate({r["votes"]: r["n"] for r in found}) if found else ({}, None, 0.5)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([votes(t) for t in rows], pa.string()), pa.array([sorted(features(t)) for t in rows], pa.list_(pa.int32()))], names=["votes", "f"])

    keyed = names_beside(docs, "doc_id", "text").where("text IS NOT NULL").withColumn("mix", F.xxhash64("doc_id", "text"))
    sample = hash_sample(keyed, "mix", FIT_ROWS).select("text")
    rows = sample.mapInArrow(sampled, "votes string, f array<int>").toPandas()
    y = np.array([posterior[v] for v in rows["votes"]])
    order = sorted(range(len(y)), key=lambda k: (tuple(rows["f"][k]), y[k]))  # reruns agree whatever the order of tasks
    sets, y = [np.asarray(rows["f"][k], np.int64) for k in order], y[order]
    apart = np.arange(len(y)) % CALIBRATE == 0
    w, b = linear([x for x, out in zip(sets, apart, strict=True) if not out], y[~apart], BUCKETS)
    z = np.array([w[x].astype(float).sum() / np.sqrt(max(1, len(x))) + b for x, out in zip(sets, apart, strict=True) if out])
    slope, shift = calibrate(z, y[apart])
    return Model(posterior, w * np.float32(slope), slope * b + shift)


def quality(docs: DataFrame) -> DataFrame:
    """(doc_id, votes, posterior, score, predicted) of each row of ``docs`` (doc_id, text).

    ``votes`` has a character a labeller (1 good, 0 bad, - none), ``posterior``
    is the weak label's probability of good text, ``score`` the linear scorer's
    and ``predicted`` 1 if that is 0.5 or more.  A null text is empty, and an
    empty text scores as the bias says with a bad vote.  Equal texts score
    alike; an empty table gives no rows.  No label column is read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in slices(batches):
            v, p, s = [], [], []
            for text in batch.column(1).to_pylist():
                vote = votes(text or "")
                f = np.fromiter(features(text or ""), np.int64)
                v.append(vote)
                p.append(m.posterior[vote])
                s.append(1 / (1 + np.exp(-np.clip(np.sort(m.weights[f].astype(float)).sum() / np.sqrt(max(1, len(f))) + m.bias, -30, 30))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(v, pa.string()), pa.array(p, pa.float64()), pa.array(s, pa.float64())], names=["doc_id", "votes", "posterior", "score"])

    out = names_beside(docs, "doc_id", "text").mapInArrow(run, "doc_id long, votes string, posterior double, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
