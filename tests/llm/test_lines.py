import random
from itertools import combinations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from collatura.llm import lines as L
from tests.llm.test_simhash import plain_components

SCHEMA = "doc_id long, text string, line string, class int"


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=600, deadline=None)
@given(st.text("abé", max_size=9), st.text("abé", max_size=9), st.integers(0, 4))
def test_banded_distance(a, b, radius):
    assert L.banded_distance(a, b, radius) == min(radius + 1, plain_distance(a, b))


def edit(rng, text, n):
    s = list(text)
    for _ in range(n):
        at = rng.randrange(len(s))
        kind = rng.randrange(3)
        if kind == 0:
            s[at] = rng.choice("xyz")
        elif kind == 1:
            s.insert(at, rng.choice("xyz"))
        else:
            del s[at]
    return "".join(s)


def test_long_lines():
    rng = random.Random(4)
    for _ in range(40):
        a = "".join(rng.choices("abc ", k=300))
        for n in range(4):
            b = edit(rng, a, n)
            assert L.banded_distance(a, b, 2) == min(3, plain_distance(a, b))


def test_probes_reach_every_line_within_the_radius():
    rng = random.Random(5)
    for _ in range(300):
        a = "".join(rng.choices("ab", k=rng.randrange(20, 30)))
        b = edit(rng, a, rng.randrange(3))
        short, long_ = sorted((a, b), key=len)
        index = {(len(short), i, short[s : s + n]) for i, (s, n) in enumerate(L.segments(len(short), 2))}
        found = {(other, i, long_[s : s + n]) for other, i, s, n in L.probes(len(long_), 2)}
        if plain_distance(a, b) <= 2:
            assert index & found


def plain(docs):
    rows = [(d, t, k, x) for d, t in dict.fromkeys(docs) for k, x in enumerate(L.lines_of(t or ""))]
    texts = sorted({r[3] for r in rows})
    root = {x: x for x in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(texts, 2):
        if min(len(a), len(b)) >= L.LEAST and abs(len(a) - len(b)) <= L.RADIUS and plain_distance(a, b) <= L.RADIUS:
            root[find(a)] = find(b)
    count = {}
    for r in rows:
        count[find(r[3])] = count.get(find(r[3]), 0) + 1
    return rows, find, count


def test_table_against_all_pairs(spark):
    rng = random.Random(6)
    base = ["".join(rng.choices("abcde ", k=rng.randrange(20, 60))).strip().ljust(20, "q") for _ in range(25)] + ["short", "The."]
    docs = [(i, "\n".join(edit(rng, x, rng.randrange(4)) if len(x) > 20 else x for x in rng.choices(base, k=rng.randrange(1, 9))) + "\n\n ") for i in range(40)]
    docs += [(50, None), (51, ""), (52, " \n "), (1, docs[1][1]), (None, docs[2][1]), (53, "short")]
    df = spark.createDataFrame([(*d, "k", 1) for d in docs], SCHEMA)
    got = L.line_duplicates(df).collect()
    assert len(got) == len(docs)
    rows, find, count = plain(docs)
    n_lines, repeated = {}, {}
    for d, t, _, x in rows:
        n_lines[d, t] = n_lines.get((d, t), 0) + 1
        repeated[d, t] = repeated.get((d, t), 0) + (count[find(x)] > 1)
    by = {d: (n_lines.get((d, t), 0), repeated.get((d, t), 0)) for d, t in docs}
    for r in got:
        assert (r["n_lines"], r["n_repeated"]) == by[r["doc_id"]] and r["n_removed"] == len(r["removed"])
    # One line of every class stays.
    distinct = {r["doc_id"]: r for r in got}.values()
    assert sum(r["n_lines"] - r["n_removed"] for r in distinct) == len(count)
    assert L.line_duplicates(df.limit(0)).count() == 0


def test_comparison_within_a_tile():
    rng = random.Random(7)
    texts = ["".join(rng.choices("abcdé ", k=30)) for _ in range(12)]
    texts += [edit(rng, rng.choice(texts), rng.randrange(1, 4)) for _ in range(90)]
    want = {(a, b) for a, b in combinations(range(len(texts)), 2) if plain_distance(texts[a], texts[b]) <= 2}
    alike = L.within(texts, 2)
    assert want == {(i, int(j)) for i in range(len(texts) - 1) for j in np.arange(i + 1, len(texts))[alike(i, np.arange(i + 1, len(texts)))]}


def test_which_lines_go(spark):
    """Of each class the occurrence first by (doc_id, text hash, line) stays; very long lines are compared too."""
    rng = random.Random(8)
    long_ = "".join(rng.choices("abcde fghij", k=200_000)).strip()
    a, b = "the quick brown fox jumps", "a lazy dog sleeps all day long"
    docs = [(2, f"{a}\n{b}\n{edit(rng, long_, 2)}"), (1, f"\n{edit(rng, a, 1)}\nshort\n"), (3, f"short\n{b}\n{b}\n{long_}"), (4, "own words only in this line")]
    got = {r["doc_id"]: r["removed"] for r in L.line_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [0], 3: [0, 1, 2, 3], 4: []}
