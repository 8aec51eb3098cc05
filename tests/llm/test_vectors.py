import numpy as np

from collatura.llm import vectors
from tests.llm.test_simhash import plain_components

SCHEMA = "vec_id long, embedding array<float>, label int, unit string, dim int"


def plain(rows, least=0.9):
    unit = {}
    for k, (_, v) in enumerate(rows):
        if v and None not in v and np.isfinite(v).all() and np.abs(v).max() > 0:
            x = np.array(np.array(v, np.float32), np.float64)
            unit[k] = x / np.linalg.norm(x)
    links = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least]
    n = [0] * len(rows)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    root = plain_components(links, range(len(rows)))
    least_id = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least_id[root[k]] = min(i, least_id.get(root[k], i))
    return sorted(((i, n[k], least_id.get(root[k]), i is not None and i == least_id.get(root[k])) for k, (i, _) in enumerate(rows)), key=str)


def near(rng, v, angle):
    d = rng.standard_normal(len(v))
    d -= d @ v * v
    return np.cos(angle) * v + np.sin(angle) * d / np.linalg.norm(d)


def test_links_counts_and_components(spark):
    rng = np.random.default_rng(1)
    base = [x / np.linalg.norm(x) for x in rng.standard_normal((30, 64))]
    rows = [v * rng.uniform(0.1, 9) for v in base]
    for v in base:
        rows += [near(rng, v, a) for a in (0.1, 0.3, 0.44, 0.46, 0.7)]
    rows += [base[0]] * 25  # copies
    rows = [(int(i), [float(np.float32(x)) for x in v]) for i, v in zip(rng.permutation(len(rows)), rows, strict=True)]
    rows += [(9001, None), (9002, []), (9003, [0.0] * 64), (9004, [None] * 64), (9005, [float("nan")] * 64), (9006, [float("inf")] + [0.0] * 63), (9007, [1.0, 0.0]), (9008, [2.0, 0.1]), (None, rows[0][1]), (rows[0][0], rows[0][1])]
    df = spark.createDataFrame([(*r, 1, "u", 5) for r in rows], SCHEMA)
    for tile in (8, 2048):
        got = sorted((tuple(r) for r in vectors.near_duplicates(df, tile=tile).collect()), key=str)
        assert got == plain(rows)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_estimates_are_unbiased_and_within_bounds():
    rng = np.random.default_rng(2)
    x, y = rng.standard_normal((2, 400, 64))
    x, y = (z / np.linalg.norm(z, axis=1, keepdims=True) for z in (x, y))
    y = np.array([near(rng, v, 0.4) for v in x])
    off, z = [], []
    for seed in range(6):
        turn = vectors.rotation(64, seed)
        guess, error = vectors.estimates(*vectors.encode(x, turn), y, turn)
        diff = np.diag(guess) - (x * y).sum(axis=1)
        off.append(diff.mean())
        z.append(diff / error)
    assert abs(np.mean(off)) < 0.01 and np.abs(np.concatenate(z)).max() < 4


def shuffled(spark, run):
    """Bytes that Spark shuffles while ``run`` runs."""
    context = spark.sparkContext

    def stages():
        context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        none = context._gateway.new_array(context._jvm.double, 0)
        found = context._jsc.sc().statusStore().stageList(None, False, False, none, context._jvm.java.util.ArrayList())
        return {found.apply(k).stageId(): found.apply(k).shuffleWriteBytes() for k in range(found.size())}

    last = max(stages(), default=-1)
    run()
    return sum(n for k, n in stages().items() if k > last)


def test_shuffle_follows_rows_not_pairs_of_tiles(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(rng.standard_normal((800, 64)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    few, many = (shuffled(spark, lambda t=t: vectors.near_duplicates(df, tile=t).collect()) for t in (400, 10))
    assert many < 2 * few  # 3 and some 3,000 pairs of tiles
    assert many < 4 * 800 * 64 * 4


def test_bound_misses_no_link_at_any_angle():
    rng = np.random.default_rng(4)
    for dim in (1, 2, 3, 8, 64):
        x = rng.standard_normal((2000, dim))
        x[:100] = np.sign(x[:100])  # a code may be its vector
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y = np.array([near(rng, v, rng.uniform(0, np.arccos(0.9))) for v in x]) if dim > 1 else x
        turn = vectors.rotation(dim)
        codes, factors = vectors.encode(x, turn)
        inner = (vectors.signs(codes, dim) * (y @ turn)).sum(axis=1)
        assert (inner >= vectors.reach(factors, 0.9) - 1e-6).all()


def test_one_dense_group_over_many_tiles(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal(16)
    rows = [(k, [float(x) for x in np.float32(near(rng, base / np.linalg.norm(base), rng.uniform(0.1, 0.5)))]) for k in range(240)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for tile in (16, 4096):
        got = sorted((tuple(r) for r in vectors.near_duplicates(df, tile=tile).collect()), key=str)
        assert got == plain(rows)
