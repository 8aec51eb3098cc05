import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from collatura.llm import passages as P
from collatura.llm.collide import _pack, open_keys

SCHEMA = "doc_id long, text string, class long, pos int"


def sentence(rng, n):
    return " ".join(rng.choice("abcdefghijklmnop") + str(rng.randrange(900)) for _ in range(n)) + "."


def plain(docs):
    """Classes by comparing all pairs of paragraphs, runs by walking each document."""
    seen, rows = {}, []
    for d, text in dict.fromkeys(docs):
        k = 0
        for before, words in P.paragraphs((text or "").encode()):
            if len(words) >= P.PARAGRAPH:
                rows.append((d, text, k, before, tuple(words)))
                seen[tuple(words)] = set(P.shingles(words))
                k += 1
    root = {w: w for w in seen}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(seen, 2):
        both = len(seen[a] & seen[b])
        if both >= P.LEAST * (len(seen[a]) + len(seen[b]) - both):
            root[find(a)] = find(b)
    docs_of = {}
    for d, text, _, _, w in rows:
        docs_of.setdefault(find(w), set()).add((d, None if d is not None else text))
    out, open_ = [], None
    for d, text, k, before, w in sorted(rows, key=lambda r: (str(r[0]), str(r[1]), r[2])):
        hit = len(docs_of[find(w)]) > 1
        if hit and open_ and open_[0] == (d, text) and open_[1] == k - 1:
            open_ = (*open_[:1], k, open_[2], before + len(w))
        else:
            if open_:
                out.append(open_)
            open_ = ((d, text), k, before, before + len(w)) if hit else None
    if open_:
        out.append(open_)
    return sorted(((d, a, b) for (d, _), _, a, b in out if b - a >= P.RUN), key=str)


def near(rng, text, share):
    return " ".join("zz" + str(rng.randrange(999)) if rng.random() < share else w for w in text.split(" "))


def test_runs_equal_the_plain_ones(spark):
    rng = random.Random(1)
    shared = [" ".join(sentence(rng, rng.randrange(9, 30)) for _ in range(4)) for _ in range(6)]
    docs = []
    for i in range(60):
        parts = [sentence(rng, rng.randrange(3, 25)) for _ in range(rng.randrange(1, 8))]
        if i % 3 == 0:
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(shared))
        if i % 5 == 0:
            parts.append(near(rng, rng.choice(shared), 0.01))
        docs.append((i, rng.choice([" ", "\n"]).join(parts)))
    docs += [(70, docs[0][1]), (3, docs[3][1]), (71, None), (72, ""), (None, docs[9][1]), (None, docs[9][1]), (73, "x " * 40_000)]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], SCHEMA)
    got = P.repeated_passages(df).collect()
    assert sorted(((r["doc_id"], r["start_word"], r["stop_word"]) for r in got), key=str) == plain(docs)
    by = {}
    for r in got:
        by.setdefault(r["passage"], []).append(r["removed"])
    assert any(all(v) for v in by.values()) or not all(not x for v in by.values() for x in v)
    assert all(r["n_docs"] >= 2 for r in got)
    assert P.repeated_passages(df.limit(0)).count() == 0


def test_passage_in_the_middle_of_a_line(spark):
    rng = random.Random(2)
    passage = " ".join(sentence(rng, 12) for _ in range(6))
    docs = [(1, sentence(rng, 30)[:-1] + " " + passage + " " + sentence(rng, 20)), (2, sentence(rng, 9) + " and " + passage), (3, sentence(rng, 80))]
    got = P.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["removed"] for r in got} == {1: False, 2: True}


def test_bands_reach_their_recall():
    bands = P.tune()
    assert 1 - (1 - P.LEAST**P.ROWS) ** bands >= P.RECALL > 1 - (1 - P.LEAST**P.ROWS) ** (bands - 1)
    rng = np.random.default_rng(3)
    hit = 0
    for _ in range(400):
        x = rng.integers(0, 2**63, 90, np.uint64)
        both = x[:80]
        a, b = np.concatenate([both, x[80:90]]), np.concatenate([both, rng.integers(0, 2**63, 10, np.uint64)])
        keys = P.band_keys(np.concatenate([a, b]), np.array([0, 90]), bands, P.ROWS)
        hit += bool((keys[0] == keys[1]).any())
    assert hit / 400 > 0.985


def test_similarity_within_a_tile():
    rng = random.Random(4)
    sets = []
    for i in range(140):
        base = sets[rng.randrange(i)] if i and rng.random() < 0.7 else rng.sample(range(60), rng.randrange(1, 24))
        own = set(base)
        for _ in range(rng.randrange(3)):
            own.discard(rng.choice(sorted(own)))
            own.add(rng.randrange(60))
        sets.append(sorted(own))
    want = {(a, b) for a, b in combinations(range(140), 2) if len(set(sets[a]) & set(sets[b])) >= 0.8 * len(set(sets[a]) | set(sets[b]))}
    held = pa.array([[1]] + sets, pa.list_(pa.int64())).slice(1)
    alike = P.similar(held, 0.8)
    got = {(i, int(j)) for i in range(140) for j in np.arange(i + 1, 140)[alike(i, np.arange(i + 1, 140))] if i < 139}
    assert want and got == want
    for a, b in list(combinations(range(40), 2)):
        assert bool(P.similar(pa.array([sets[a], sets[b]], pa.list_(pa.int64())), 0.8)(0, np.array([1]))[0]) == ((a, b) in want)


def test_a_first_paragraph_keeps_no_copy_beside_it(spark):
    rng = random.Random(5)
    p, q = (" ".join(sentence(rng, 12) for _ in range(3)) for _ in range(2))
    docs = [(1, p), (5, p + " " + q), (9, q)]
    got = P.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    parts = {r["doc_id"]: (r["removed"], [tuple(x) for x in r["parts"]]) for r in got}
    assert parts == {1: (False, [(0, 36, False)]), 5: (False, [(0, 36, True), (36, 72, False)]), 9: (True, [(0, 36, True)])}


def test_short_lines_are_found(spark):
    rng = random.Random(6)
    lines = [sentence(rng, n) for n in (4, 4, 4, 4, 4, 2, 7, 1, 3, 5, 4, 4, 6, 7)]
    own = [sentence(rng, n) for n in (3, 5, 4, 4, 12, 6)]
    docs = [(1, "\n".join(lines)), (2, "\n".join([own[0], own[2], *lines, own[1], own[4]])), (3, " ".join([*own[4:], *lines, own[3], own[2]])), (4, "\n".join(own[:4]))]
    got = P.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    n = sum(len(x.split()) for x in lines)
    spans = {r["doc_id"]: (r["start_word"], r["stop_word"], r["removed"]) for r in got if r["stop_word"] - r["start_word"] >= n}
    assert spans == {1: (0, n, False), 2: (7, 7 + n, True), 3: (18, 18 + n, True)}


def test_joined_units_cover_all_words():
    rng = random.Random(7)
    for _ in range(200):
        short = [["w"] * rng.randrange(1, 8) for _ in range(rng.randrange(1, 9))]
        units = list(P._joined(short, 5, 8))
        n = sum(map(len, short))
        assert {k for b, w in units for k in range(b, b + len(w))} == set(range(5, 5 + n))
        assert all(a[0] <= b[0] and a[0] + len(a[1]) <= b[0] + len(b[1]) for a, b in zip(units, units[1:]))


def test_paragraphs_end_after_marks_and_lines():
    rng = random.Random(8)
    end = re.compile(rb"[.!?]+(?=[ \t\r\n])|\n")
    for _ in range(3000):
        text = bytes(rng.choice(b"aB.!? \t\r\n\x0b\x0c") for _ in range(rng.randrange(16)))
        cuts = [0, *(m.end() for m in end.finditer(text)), len(text)]
        want = [w for a, b in zip(cuts, cuts[1:]) if (w := text[a:b].lower().split())]
        assert [w for _, w in P.paragraphs(text, 1)] == want


def test_shared_keys_move_in_few_bytes(spark):
    """The keys of paragraphs, nearly all of one id each, were 24 bytes a row; packed they are 16."""
    rng = random.Random(9)
    units = [(k, [rng.getrandbits(62) for _ in range(10)]) for k in range(3000)] + [(-k, [7, 8, 9]) for k in range(1, 4)]
    df = spark.createDataFrame(units, "unit long, shingles array<long>").repartition(2)
    bands = P.tune()
    keys = lambda it: P._keys(it, bands, P.ROWS, None)
    packs = df.mapInArrow(lambda it: _pack(keys(it), 8), "cell int, rows binary").collect()
    assert sum(len(r["rows"]) for r in packs) <= 16 * bands * len(units)
    want = df.mapInArrow(keys, "key long, id long").groupBy("key").agg(F.countDistinct("id").alias("n")).where("n > 1")
    got = [r["key"] for r in open_keys(df, keys).collect()]
    assert len(got) >= bands and sorted(got) == sorted(r["key"] for r in want.collect())
