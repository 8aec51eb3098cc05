import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from collatura.llm import toxicity

SYLLABLES = ["ba", "ke", "lo", "mi", "nu", "ra", "se", "ti", "vo", "da"]
BAD = ["gragnor", "plimfug", "zwottek"]


def docs(rng, n, hide=False):
    out = []
    for i in range(n):
        words = ["".join(rng.choices(SYLLABLES, k=rng.randrange(1, 4))) for _ in range(40)]
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(2):
                w = rng.choice(BAD)
                if hide:
                    w = rng.choice([w.replace("o", "0"), w.replace("i", "1").replace("a", "@"), "".join(c * 3 if c == w[2] else c for c in w), " ".join(w), ".".join(w), w[:3] + "*" + w[3:]])
                words.insert(rng.randrange(40), w)
        out.append((i, " ".join(words), int(toxic)))
    return out


def model_of(words):
    counts = np.zeros((64, 64, 64), np.int64)
    for w in words:
        s = toxicity.symbols(f" {w} ")
        for a, b, c in zip(s, s[1:], s[2:]):
            counts[a, b, c] += 1
    return toxicity.language_model(counts)


def plain_decode(token, model):
    """Every path of the lattice, scored one by one."""
    best = {"": None}
    paths = [("", 0.0)]
    for i, ch in enumerate(token):
        again = i and ch == token[i - 1]
        if ch.isalpha():
            arcs = [(ch, toxicity.REPEAT if again else 0.0)] + ([("", toxicity.SQUEEZE)] if again else [])
        else:
            arcs = [(x, toxicity.SWAP) for x in toxicity.LOOKALIKES.get(ch, "")] + [("", toxicity.DROP / 2 if ch in toxicity.SEPARATORS else 3 * toxicity.DROP)]
        paths = [(out + x, cost + c) for out, cost in paths for x, c in arcs]
    best = {}
    for out, cost in paths:
        if out:
            s = toxicity.symbols(out).tolist()
            s = [0, 0, *s, 0]
            value = sum(float(model[a, b, c]) for a, b, c in zip(s, s[1:], s[2:])) - cost
            best[out] = max(best.get(out, -1e9), value)
    return max(best, key=lambda x: (best[x], x)) if best else None


def test_viterbi_finds_the_best_path():
    model = model_of(["idiot", "trash", "little", "test", "banal"] * 20)
    for token in ("1d10t", "tr@sh", "iidiott", "tra$$h", "i.d.i.o.t", "b4n4l", "l!ttle", "t3st", "0", "b__a", "ttt"):
        got = toxicity.decode(token, model)
        assert got[:1] == [plain_decode(token, model)], token


def test_restores_words():
    model = model_of(["idiot", "trash", "little", "test", "banal"] * 20)
    for token, word in (("1d10t", "idiot"), ("tr@sh", "trash"), ("iiidiooot", "idiot"), ("i-d-i-o-t", "idiot"), ("t.r.a.s.h", "trash")):
        assert word in toxicity.decode(token, model)


@pytest.mark.parametrize("hide", [False, True])
def test_held_out_accuracy(spark, hide):
    rng = random.Random(3)
    rows = docs(rng, 500) + [(i + 1000, t, y) for i, t, y in docs(rng, 300, hide)]
    table = spark.createDataFrame([(i, t, "en") for i, t, _ in rows], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(table, labels).collect()}
    test = [(got[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0 and i >= 1000]
    assert all(r["held_out"] for r, _ in test) and len(test) > 30
    assert sum(r["predicted"] == y for r, y in test) / len(test) > 0.9


def test_labels_of_held_out_rows_do_not_matter(spark):
    rows = docs(random.Random(4), 200)
    table = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    score = lambda flip: sorted(map(tuple, toxicity.toxicity(table, spark.createDataFrame([(i, 1 - y if flip and out(i) else y) for i, _, y in rows], "doc_id long, toxic int")).collect()))
    assert score(False) == score(True)


def test_odd_rows(spark):
    rows = docs(random.Random(5), 60) + [(900, None, 0), (901, "", 1), (None, "gragnor ba", 1), (902, "4" * 30_000 + " a" * 30_000, 0), (3, "again", 0)]
    table = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5, None), (6, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(table, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert toxicity.toxicity(table.limit(0), labels).count() == 0
    assert {r["predicted"] for r in toxicity.toxicity(table, labels.where("toxic = 0")).collect()} == {0}
    kept = toxicity.reject(table, toxicity.fit(table, labels))
    assert kept.columns == table.columns and kept.count() == sum(r["predicted"] == 0 for r in got)


def test_query_on_held_out_labels(spark):
    from collatura.llm.queries import op4_toxicity

    folder = "/root/testdata/sf0.001"
    if not Path(folder).exists():
        pytest.skip("no test tables")
    got = {r["doc_id"]: r for r in op4_toxicity(spark, folder).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    clean = [got[i]["predicted"] for i, y in labels.items() if y == 0]
    assert sum(clean) / len(clean) < 0.05


def test_all_features_with_evidence_get_a_weight(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    groups = [" ".join(word() for _ in range(500)) for _ in range(20)]
    docs = [(i, f"{groups[i % 20]} {word()}") for i in range(100)] + [(100 + i, f"plain {word()}") for i in range(100)]
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in docs], "doc_id long, toxic int")
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), labels)
    held = [t for i, t in docs[:100] if zlib.crc32(str(i).encode()) % 5]
    often = Counter(b for t in held for b in {b for w in t.split() for b in toxicity.buckets_of(w)})
    want = {b for b, n in often.items() if n >= 3}
    assert len(want) > 20_000 and len(want - set(model.weights)) < 0.02 * len(want)


def test_decoder_equals_all_paths_on_any_token():
    """The shipped search against every path of the lattice, where it branches at the start, inside, at the end or not at all."""
    rng = random.Random(9)
    model = toxicity.language_model(np.random.default_rng(9).integers(0, 40, (64, 64, 64)))
    for alphabet in ("abcdef013!|+", "abc", "ab#%*-", "aаеo†", "ab_0éß"):
        for _ in range(300):
            token = "".join(rng.choices(alphabet, k=rng.randrange(1, 9)))
            if not any(x in toxicity.TWINS for x in token):
                assert (toxicity.decode(token, model)[:1] or [None]) == [plain_decode(token, model)], token
            assert len(toxicity.decode("x" * 50 + token + "y" * 50, model)) >= 1


def test_every_disguise_is_decoded():
    words = ["idiot", "trash", "little", "test", "banal"]
    own = toxicity.Restorer(model_of(words * 20))
    for token, word in (("!diot", "idiot"), ("idi0+", "idiot"), ("trrash", "trash"), ("†rash", "trash"), ("trаsh", "trash"), ("***trash", "trash"), ("(1d10t)", "idiot"), ("tr@sh!!!", "trash"), ("i-d-i-o-t", "idiot")):
        assert toxicity.buckets_of(word)[0] in own.features(f"banal {token} test"), token


def test_other_labels_teach_nothing(spark):
    rows = docs(random.Random(6), 120)
    table = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    some = [(i, y) for i, _, y in rows if i % 3]
    odd = [(i, y) for i, _, _ in rows if not i % 3 for y in (2, -1)]
    score = lambda marks: sorted(map(tuple, toxicity.toxicity(table, spark.createDataFrame(marks, "doc_id long, toxic int")).collect()))
    assert score(some) == score(some + odd)


def test_memory_of_tokens_keeps_its_bound(monkeypatch):
    monkeypatch.setattr(toxicity, "REMEMBERED", 20)
    own = toxicity.Restorer(model_of(["test"]))
    for k in range(200):
        text = f"w{k} common tes{k % 7}t " + "long" * 20
        assert own.features(text) == toxicity.Restorer(own.model).features(text)
        assert len(own.known) + len(own.older) <= 21 and all(len(x) <= toxicity.LONG for x in own.known)


def plain_readings(token, model):
    """Viterbi over every character and all states, with no shortcuts."""
    states = {(0, 0, ""): (0.0, "")}
    for i, ch in enumerate(token):
        new = {}
        for (a, b, last), (value, out) in states.items():
            for letter, cost in toxicity._arcs(ch, i > 0 and ch == token[i - 1]):
                c = int(toxicity.symbols(letter)[0]) if letter else 0
                key, better = ((b, c, letter), (value - cost + float(model[a, b, c]), out + letter)) if letter else ((a, b, last), (value - cost, out))
                if key not in new or new[key][0] < better[0]:
                    new[key] = better
        states = new
    ended = sorted(((v + float(model[a, b, 0]), out) for (a, b, _), (v, out) in states.items() if out), reverse=True)
    return list(dict.fromkeys(out for _, out in ended))


def test_scores_equal_plain_ones_and_hold_on_held_out_labels(spark):
    """Every token of every whole text decoded without shortcuts, memory or masks."""
    from collatura.llm.queries import op4_toxicity

    folder = "/root/testdata/sf0.001"
    if not Path(folder).exists():
        pytest.skip("no test tables")
    table, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.fit(table, labels)
    got = {r["doc_id"]: r["score"] for r in op4_toxicity(spark, folder).collect()}
    known = {}

    def buckets(token):
        if token not in known:
            words = toxicity._WORD.findall(token) + plain_readings(token, model.language)[: toxicity.READINGS]
            known[token] = {b for w in words for b in toxicity.buckets_of(w)}
        return known[token]

    spaced = toxicity.Restorer(model.language)
    for r in table.collect():
        text = (r["text"] or "").lower()
        found = set().union(*map(buckets, set(text.split()))) if text.split() else set()
        for x in set(toxicity._SPACED.findall(text)):
            joined = "".join(c for c in x if c not in " .-_*")
            for part in (joined, joined[1:], joined[:-1]):
                found |= set(spaced._buckets(toxicity.decode(part, model.language, 2)))
        z = model.bias + sum(model.weights.get(b, 0.0) for b in found)
        assert abs(got[r["doc_id"]] - 1 / (1 + np.exp(-z))) < 1e-6, r["doc_id"]


def test_held_out_labels_of_the_tables(spark):
    from collatura.llm.queries import op4_toxicity

    folder = "/root/testdata/sf0.01"
    if not Path(folder).exists():
        pytest.skip("no test tables")
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [(r["score"], toxic[r["doc_id"]]) for r in op4_toxicity(spark, folder).collect() if r["held_out"] and r["doc_id"] in toxic]
    bad, good = [s for s, y in rows if y], [s for s, y in rows if not y]
    assert len(bad) >= 3 and len(good) > 30
    assert sum((a > b) + 0.5 * (a == b) for a in bad for b in good) / len(bad) / len(good) > 0.9
    assert sum(s >= 0.5 for s in good) / len(good) < 0.05 and sum(s >= 0.5 for s in bad) / len(bad) >= 0.5
