import random
import time
from difflib import SequenceMatcher

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from collatura.operators import align as A

WORDS = st.lists(st.sampled_from(["a", "b", "c", "d"]), max_size=14)


def rebuilt(a, b, ops):
    out, back = [], []
    for tag, i, j, k, m in ops:
        out += a[i:j] if tag == "equal" else b[k:m]
        back += a[i:j]
        if tag == "equal":
            assert a[i:j] == b[k:m]
    return out, back


@settings(max_examples=300, deadline=None)
@given(WORDS, WORDS)
def test_opcodes_turn_one_side_into_the_other(a, b):
    assert rebuilt(a, b, A.opcodes_of(a, b)) == (b, a)


def test_long_texts_are_aligned_as_short_ones_are():
    """Longer than any former limit: no cut at anchors, so edits are told as in a short pair."""
    rng = random.Random(1)
    a = [f"w{rng.randrange(9000)}" for _ in range(24_000)]
    b = [w if rng.random() > 0.02 else "x" for w in a]
    ops = A.opcodes_of(a, b)
    assert rebuilt(a, b, ops) == (b, a)
    assert sum(j - i for tag, i, j, _, _ in ops if tag == "equal") == sum(x == y for x, y in zip(a, b, strict=True))


def frame(spark, *pairs):
    return spark.createDataFrame([(str(k), x.split() if x is not None else None, y.split() if y is not None else None) for k, (x, y) in enumerate(pairs)], "pair string, a array<string>, b array<string>")


def errors(spark, heard, expected):
    pairs = frame(spark, (heard, expected))
    rows = A.differences(pairs).orderBy("err_id").collect()
    return [(r["type"], r["wrong"], r["correct"]) for r in rows]


def test_types(spark):
    assert errors(spark, "я очень рад", "я рад") == [("insertion", "очень", "")]
    assert errors(spark, "я рад", "я очень рад") == [("deletion", "", "очень")]
    assert errors(spark, "я рат", "я рад") == [("substitution", "рат", "рад")]
    assert errors(spark, "что ты раз", "ты что раз") == [("transposition", "что ты", "ты что")]
    assert errors(spark, "a x y z b", "a p b") == [("substitution", "x", "p"), ("insertion", "y", ""), ("insertion", "z", "")]
    assert errors(spark, "a b", "a b") == []
    assert errors(spark, None, "a") == [("deletion", "", "a")]
    assert errors(spark, None, None) == []


def test_every_differing_word_is_told_once(spark):
    rng = random.Random(2)
    pairs = [(" ".join(rng.choices("abcdef", k=rng.randrange(30))), " ".join(rng.choices("abcdef", k=rng.randrange(30)))) for _ in range(40)]
    df = frame(spark, *pairs)
    ops = A.align(df)
    rows = A.differences(df).groupBy("pair").agg(
        F.sum(F.when(F.col("type") == "transposition", 1).otherwise((F.col("wrong") != "").cast("int"))).alias("w"),
        F.sum(F.when(F.col("type") == "transposition", 1).otherwise((F.col("correct") != "").cast("int"))).alias("c"),
    )
    got = {r["pair"]: (r["w"], r["c"]) for r in rows.collect()}
    equal = {r["pair"]: (r["n_a"] - r["n_equal"], r["n_b"] - r["n_equal"]) for r in A.similarity(ops).collect()}
    assert all(got.get(k, (0, 0)) == v for k, v in equal.items())


def test_similarity_and_introduction(spark):
    df = frame(spark, ("студия икс представляет шёл дождь и было тихо", "шёл дождь и было тихо"), ("a b", "a b"), ("x", "y"))
    ops = A.align(df)
    ratio = {r["pair"]: r["ratio"] for r in A.similarity(ops).collect()}
    assert ratio["1"] == 1.0 and ratio["2"] == 0.0 and abs(ratio["0"] - 10 / 13) < 1e-9
    timed = df.select("pair", F.posexplode("a").alias("pos", "w")).select("pair", "pos", (F.col("pos") * 0.5).alias("t"))
    phantom = {r["pair"]: r["phantom"] for r in A.phantom_seconds(ops, timed).collect()}
    assert phantom == {"0": 1.5, "1": 0.0, "2": 0.0}
    rows = spark.createDataFrame([("0", 0.5), ("0", 1.5), ("2", 0.0)], "pair string, t double")
    assert A.skip_phantom(rows, A.phantom_seconds(ops, timed)).count() == 2 and A.skip_phantom(rows, 1.0).count() == 1


@settings(max_examples=300, deadline=None)
@given(st.permutations(range(12)), st.lists(st.integers(0, 20), max_size=14, unique=True), st.integers(0, 3))
def test_words_that_occur_once_are_aligned_as_difflib_does(a, b, more):
    a, b = ["q"] * more + [str(x) for x in a], [str(x) for x in b] + ["z"] * more
    assert A._blocks_of(a, b) is not None
    assert A.opcodes_of(a, b) == SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
    assert A._blocks_of(["a", "a"], ["a"]) is None and A._blocks_of(["a"], ["a", "a"]) is None


def test_time_follows_the_length_where_words_occur_once():
    """Many equal runs: to search all words again for each run would take minutes here."""
    b = [f"w{i}" for i in range(100_000)]
    a = [w if i % 20 else "x" for i, w in enumerate(b)]
    began = time.perf_counter()
    ops = A.opcodes_of(a, b)
    assert time.perf_counter() - began < 10
    assert len(ops) == 10_000 and rebuilt(a, b, ops) == (b, a)


def test_summaries_tell_what_the_operations_tell(spark):
    rng = random.Random(4)
    pairs = [(" ".join(rng.choices("abcdefgh", k=rng.randrange(40))), " ".join(rng.choices("abcdefgh", k=rng.randrange(40)))) for _ in range(40)]
    df = frame(spark, *pairs, ("студия шёл дождь и было", "шёл дождь и было"), (None, "a"))
    got = {r["pair"]: r for r in A.summaries(df).collect()}
    ops = A.align(df)
    for r in A.similarity(ops).collect():
        assert (got[r["pair"]]["n_equal"], got[r["pair"]]["n_a"], got[r["pair"]]["n_b"]) == (r["n_equal"], r["n_a"], r["n_b"])
    assert {r["pair"]: r["count"] for r in ops.groupBy("pair").count().collect()} == {k: r["n_ops"] for k, r in got.items() if r["n_ops"]}
    first = ops.where("tag = 'equal' AND a_hi - a_lo >= 4").groupBy("pair").agg(F.min("a_lo").alias("pos"))
    assert {r["pair"]: r["pos"] for r in first.collect()} == {k: r["begins"] for k, r in got.items() if r["begins"] is not None}
