import random

import numpy as np

from collatura.llm import quality

GOOD = ["The cat sat on the mat and looked at {} birds.", "Rain fell over {} hills all night, and by morning it was calm.", "She wrote a letter to {} friends, then went out for a walk."]


def texts(rng, n):
    out = []
    for i in range(n):
        kind = rng.choice(["good", "good", "good", "good", "caps", "bars", "run", "symbols"])
        words = [w for _ in range(8) for w in rng.choice(GOOD).format(rng.choice(["two", "many", "some", "old", "new", "few", "most"])).split()]
        rng.shuffle(words)
        text = " ".join(words)
        if kind == "caps":
            text = " ".join(w.upper() + "!!" for w in words)
        elif kind == "bars":
            text = " | ".join(words)
        elif kind == "run":
            text = " ".join([words[0]] * 60 + [words[1]] * 20)
        elif kind == "symbols":
            text = " ".join(w + "***" for w in words)
        out.append((i, text, kind == "good"))
    return out


def test_estimate_recovers_accuracies():
    rng = random.Random(1)
    patterns = {}
    truth = []
    for _ in range(4000):
        good = rng.random() < 0.85
        fault = rng.randrange(9)
        p = "".join("-" if rng.random() < 0.1 else "1" if good and rng.random() < 0.99 else "0" if (not good and (k == fault or rng.random() < 0.1)) or (good and rng.random() < 0.01) else "1" for k in range(9))
        patterns[p] = patterns.get(p, 0) + 1
        truth.append((p, good))
    posterior, rates, prior = quality.estimate(patterns)
    assert sum((posterior[p] >= 0.5) == good for p, good in truth) / len(truth) > 0.9
    assert 0.75 < prior < 0.95 and (rates[1, :, 1] > rates[0, :, 1]).all()


def test_scorer_learns_from_weak_labels_alone(spark):
    rows = texts(random.Random(2), 400)
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, votes string")
    got = {r["doc_id"]: r for r in quality.quality(df).collect()}
    right = sum((got[i]["predicted"] == 1) == good for i, _, good in rows)
    assert right / len(rows) > 0.95
    assert all(0 <= r["score"] <= 1 and len(r["votes"]) == len(quality.LABELLERS) for r in got.values())


def test_odd_rows(spark):
    schema = "doc_id long, text string, score double"
    rows = [(1, None, 0.0), (2, "", 0.0), (2, "", 0.0), (None, "A plain line of text.", 1.0), (4, "word " * 50_000, 1.0), (5, "| | |", 0.0), (6, "1234 5678", 0.0)]
    got = quality.quality(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 7 and len({r["score"] for r in got if r["doc_id"] in (1, 2)}) == 1
    assert quality.quality(spark.createDataFrame([], schema)).count() == 0
    assert quality.quality(spark.createDataFrame([(1, None, 0.0)], schema)).count() == 1


def test_query_against_plain_statistics_and_labels(spark):
    """Votes, posteriors and scores by plain loops over whole texts, and accuracy on labels that nothing learned from."""
    from collections import Counter
    from pathlib import Path

    import pytest

    from collatura.llm.queries import op5_quality

    folder = "/root/testdata/sf0.01"
    if not Path(folder).exists():
        pytest.skip("no test tables")
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    posterior, _, _ = quality.estimate(Counter(quality.votes(t) for t in texts.values()))
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = {r["doc_id"]: r for r in op5_quality(spark, folder).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        assert got[i]["votes"] == quality.votes(t) and got[i]["posterior"] == pytest.approx(posterior[got[i]["votes"]])
        assert got[i]["predicted"] == int(got[i]["score"] >= 0.5)
    right = [got[i]["predicted"] == y for i, y in labels.items()]
    weak = [(got[i]["posterior"] >= 0.5) == y for i, y in labels.items()]
    assert sum(right) / len(right) > 0.9 and sum(weak) / len(weak) > 0.9


def test_prior_is_outvoted_by_data():
    """The estimate on many texts is that of their shares, not of the prior; on few it keeps near the prior."""
    shares = {"1" * 9: 800, "0" + "1" * 8: 120, "00" + "1" * 7: 60, "1" * 8 + "0": 20}
    few, many = ({k: n * scale for k, n in shares.items()} for scale in (1, 1000))
    _, a, _ = quality.estimate(few)
    _, b, _ = quality.estimate(many)
    bad = np.array(quality.PRIOR)[0, 0]
    assert abs(a[0, 0, 0] - bad) < abs(b[0, 0, 0] - bad)


def test_calibration_finds_the_best_cut():
    rng = np.random.default_rng(3)
    z = rng.normal(2, 1, 500)
    y = (z + rng.normal(0, 0.3, 500) > 1.2).astype(float)
    slope, shift = quality.calibrate(z, y)
    best = max(np.mean((z > c) == (y > 0.5)) for c in np.linspace(-1, 4, 200))
    assert slope > 0 and np.mean((slope * z + shift > 0) == (y > 0.5)) >= best - 1e-9
    assert quality.calibrate(z, np.ones(500)) == (1.0, 0.0) == quality.calibrate(z[:0], y[:0])
