import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from collatura.llm import collide
from collatura.llm.common import Scratch, bit_filter, in_filter
from tests.llm.test_simhash import plain_components


def by_one(bodies):
    """Ids are alike if they differ by 1, so a bucket's least id reaches few of the others directly."""
    x = bodies.to_numpy()
    return lambda i, others: np.abs(x[others] - x[i]) == 1


def found(spark, members, **tiles):
    df = collide.from_table(spark.createDataFrame(members, "key long, id long"))
    bodies = lambda ids, n: ids.select("id", F.col("id").alias("body"), F.lit(3).alias("size"))
    return {r["node"]: r["component"] for r in collide.classes(Scratch(spark, "test"), df, bodies, by_one, **tiles).collect()}


def wanted(members):
    held = {}
    for k, i in members:
        held.setdefault(k, set()).add(i)
    links = {(a, b) for ids in held.values() for a in ids for b in ids if b - a == 1}
    return plain_components(links, {x for e in links for x in e})


def test_shared_keys(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(40), rng.randrange(6)) for _ in range(120)] + [(50, 7)] * 9
    ids = {k: {i for q, i in rows if q == k} for k, _ in rows}
    got = collide.shared(Scratch(spark, "test"), collide.from_table(spark.createDataFrame(rows, "key long, id long"))).collect()
    assert sorted(map(tuple, got)) == sorted((k, i) for k, v in ids.items() if len(v) > 1 for i in v)


def test_classes_lose_no_link(spark):
    """In one tile, in tiles by rows and in tiles by size; buckets of the same ids too."""
    rng = random.Random(2)
    members = [(k, rng.randrange(60)) for k in range(12) for _ in range(14)] + [(99, i) for i in range(100, 130)] + [(98, 500)] + [(97, i) for i in range(100, 130)]
    members += [(96, 2 * i) for i in range(300, 330)]
    want = wanted(members)
    assert found(spark, members) == want
    assert found(spark, members, tile=4) == want
    assert found(spark, members, tile_size=20) == want
    assert found(spark, members[:0]) == {}


def test_a_dense_bucket_is_compared_once_a_row():
    n = 500
    asked = []

    def alike(i, others):
        asked.append(len(others))
        return np.ones(len(others), bool)

    out = collide.tile_forest(np.arange(n), np.arange(n), np.zeros(n, bool), alike)
    assert len(out) == sum(asked) == n - 1


def test_visitors_meet_only_the_tiles_own_rows():
    visits = np.array([False, False, True, True, False])
    seen = set()

    def alike(i, others):
        seen.update((i, int(j)) for j in others)
        return np.zeros(len(others), bool)

    assert collide.tile_forest(np.arange(5), np.array([0, 1, 2, 1, 4]), visits, alike) == []
    assert seen == {(2, 0), (2, 1), (2, 4), (3, 0), (3, 4)}


def test_bit_filter_knows_its_keys(spark):
    rng = random.Random(3)
    keys = [rng.getrandbits(64) - (1 << 63) for _ in range(3000)]
    made = bit_filter(spark.createDataFrame([(k,) for k in keys], "id long"), len(keys))
    assert in_filter(made, np.array(keys, np.int64).view(np.uint64)).all()
    other = np.array([rng.getrandbits(64) for _ in range(3000)], np.uint64)
    assert in_filter(made, other).mean() < 0.1


def test_two_of_each_key():
    rng = random.Random(4)
    for _ in range(200):
        keys, ids = (np.array([rng.randrange(k) for _ in range(50)]) for k in (12, 3))
        k, i = collide.two_of_each(keys.astype(np.uint64), ids)
        for key in set(keys.tolist()):
            own, got = set(ids[keys == key].tolist()), i[k == key].tolist()
            assert len(got) == len(set(got)) == min(len(own), 2) and set(got) <= own


def test_open_keys_in_packs(spark, monkeypatch):
    """Also where a task sorts its rows in parts, a range of keys spans several packs and a key has many rows."""
    rng = random.Random(5)
    hashed = lambda k: (k * 0x9E3779B97F4A7C15 + (1 << 63)) % (1 << 64) - (1 << 63)
    rows = [(hashed(rng.randrange(4000)), rng.randrange(-3, 3)) for _ in range(5000)] + [(hashed(5000), i) for i in range(900)] + [(hashed(5001), 7)] * 900
    ids = {}
    for k, i in rows:
        ids.setdefault(k, set()).add(i)
    df = spark.createDataFrame(rows, "key long, id long").repartition(3)
    whole = lambda it: it
    got = [r["key"] for r in collide.open_keys(df, whole).collect()]
    assert sorted(got) == sorted(k for k, v in ids.items() if len(v) > 1)
    assert collide.open_keys(df.limit(0), whole).count() == 0
    batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[at : at + 500])], names=["key", "id"]) for at in range(0, len(rows), 500)]
    monkeypatch.setattr(collide, "SORTED", 1000)
    monkeypatch.setattr(collide, "PACK", 16)
    packs = pa.Table.from_batches(collide._pack(iter(batches), 3)).sort_by("cell")
    assert packs.num_rows > 200 and max(map(len, packs["rows"].to_pylist())) == 256
    assert sum(map(len, packs["rows"].to_pylist())) <= 16 * len(rows)
    got = [k for b in collide._unpack(iter(packs.to_batches(max_chunksize=7))) for k in b.column(0).to_pylist()]
    assert sorted(got) == sorted(k for k, v in ids.items() if len(v) > 1)


def test_tiles_of_two_rows():
    yes = lambda i, others: np.ones(len(others), bool)
    for roots, visits, linked in (((1, 2), (0, 0), True), ((1, 1), (0, 0), False), ((1, 2), (0, 1), True), ((1, 2), (1, 0), True), ((1, 2), (1, 1), False)):
        out = collide.tile_forest(np.array([1, 2]), np.array(roots), np.array(visits, bool), yes)
        assert [set(x) for x in out] == [{1, 2}] * linked
