import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from collatura.llm import mixing

SCHEMA = "doc_id long, text string, source string, size int, target double"


def plain_targets(sizes, share=1.5):
    """Share by weight; hold those above their limit; share the rest again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    limit = {s: 2 * sizes[s] for s in order}
    held = {}
    while True:
        open_ = [s for s in order if s not in held]
        left = share * sum(sizes.values()) - sum(held.values())
        given = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = [s for s in open_ if given[s] > limit[s]]
        if not above:
            return held | given
        held |= {s: limit[s] for s in above}


def make(rng, n, sources):
    rows = []
    for i in range(n):
        source = rng.choices(sources, [9] + [1] * (len(sources) - 1))[0]
        rows.append((i, " ".join(["w"] * rng.choice([0, 1, 3, 40, 90])) if rng.random() > 0.02 else None, source))
    return rows


@pytest.mark.parametrize("n_slots", [1 << 18, 500])
def test_targets_and_taken(spark, n_slots):
    rng = random.Random(4)
    rows = make(rng, 600, ["b", "a", None, "é", "Z", "", "zz"]) + [(7, "x y", "a"), (7, "x y", "a"), (None, "x y z", "b")]
    df = spark.createDataFrame([(*r, 3, 1.0) for r in rows], SCHEMA)
    got = mixing.mix(df, n_slots=n_slots)
    rows_out = got.collect()
    assert sorted(map(tuple, rows_out), key=str) == sorted(map(tuple, mixing.mix(df, n_slots=n_slots).collect()), key=str)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    want = plain_targets(sizes)
    ids = {(i, size(t)): s for i, t, s in rows}
    taken = defaultdict(int)
    assert len(rows_out) == len(rows)
    for r in rows_out:
        s = ids[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    block = -(-int(sum(want.values())) // n_slots)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= block + 1


def test_schedule_is_even_and_whole(spark):
    needs = {1: 50, 2: 9, 3: 1, 4: 0, 5: 940}
    goals = spark.createDataFrame(list(needs.items()), "source_no int, need long")
    rows = mixing.schedule(goals, 1000).orderBy("slot").collect()
    ranks = defaultdict(list)
    for r in rows:
        ranks[r["source_no"]].append(r["rank"])
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in needs.items() if n}
    first = [r["source_no"] for r in rows[:500]]
    for k, n in needs.items():
        assert abs(first.count(k) - n / 2) <= 12


def test_empty_and_blank(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(df).count() == 0 and mixing.take(df).count() == 0
    df = spark.createDataFrame([(1, None, "a", 1, 1.0), (2, " ", None, 1, 1.0)], SCHEMA)
    assert [r["taken"] for r in mixing.mix(df).collect()] == [0, 0]


def test_take_keeps_columns_and_rounds(spark):
    rows = make(random.Random(9), 300, ["a", "b", "c", "d"])
    df = spark.createDataFrame([(*r, 3, 1.0) for r in rows], SCHEMA)
    out = mixing.take(df)
    assert out.columns == df.columns
    copies = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    for r in mixing.mix(df).collect():
        assert copies.get(r["doc_id"], 0) == (int(r["taken"] / r["size"] + 0.5) if r["size"] else 0)


def test_take_leaves_columns_of_any_name(spark):
    """Names that the operator uses inside, and values that differ from row to row."""
    names = ["row", "own", "at", "cell", "since", "until", "times", "mix", "size", "taken", "target", "source_no", "last", "col", "__size", "__copy", "__id"]
    rows = make(random.Random(10), 200, ["a", None])
    df = spark.createDataFrame([(*r, *(f"{n} {r[0]}" for n in names)) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    out = mixing.take(df)
    assert out.columns == df.columns
    got = out.collect()
    assert got and all(r[n] == f"{n} {r['doc_id']}" for r in got for n in names)


def test_long_texts_and_repeated_rows(spark):
    rows = [(1, "w " * 300_000, "a"), (2, "x", "a")] + [(3, "y z", "b")] * 50 + [(4, "", "b"), (5, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for n_slots in (1 << 18, 7):
        got = mixing.mix(df, n_slots=n_slots).collect()
        assert len(got) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert {r["doc_id"] for r in mixing.take(df).collect()} <= {1, 2, 3}


def test_stretches_of_equal_copies_are_bounded(spark, monkeypatch):
    """What take broadcasts follows the slots and the cells, not the rows."""
    seen = []
    real = mixing.F.broadcast
    monkeypatch.setattr(mixing.F, "broadcast", lambda df: seen.append(df.count()) or real(df))
    monkeypatch.setattr(mixing, "CELL_BITS", 3)
    rows = make(random.Random(12), 3000, ["a", "b"])
    mixing.take(spark.createDataFrame(rows, "doc_id long, text string, source string"), n_slots=50).count()
    assert 0 < seen[0] <= 3 * 50 + 2 * 8


def test_main_path_is_native(spark, monkeypatch):
    """No Python runs for rows: everything that would start it fails."""
    from pyspark.sql.classic.dataframe import DataFrame

    def no(*a, **k):
        raise AssertionError("Python for rows")

    for name in ("mapInArrow", "mapInPandas", "toPandas", "toArrow", "rdd"):
        monkeypatch.setattr(DataFrame, name, property(no) if name == "rdd" else no)
    monkeypatch.setattr(mixing.F, "udf", no)
    monkeypatch.setattr(mixing.F, "pandas_udf", no)
    df = spark.createDataFrame([(1, "a b", "s", 1, 1.0)], SCHEMA)
    for out in (mixing.mix(df), mixing.take(df)):
        plan = out._jdf.queryExecution().toString()
        assert out.count() == 1 or out.count() == 2
        assert "Python" not in plan and "Arrow" not in plan
