import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from collatura.llm import decontaminate


def plain_words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain(docs, items, size=8):
    out = []
    for doc_id, text in docs:
        words, hit, found = plain_words(text), set(), set()
        for item, body in items:
            own = plain_words(body)
            if item is None or not own:
                continue
            n = min(size, len(own))
            windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)}
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found.add(str(item))
        out.append((doc_id, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    return sorted(out, key=str)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_words(text):
    text = text.encode("utf-8", "ignore").decode()
    assert [w.decode() for w in decontaminate.words_of(text.encode())] == plain_words(text)


def test_random_texts_over_a_small_alphabet():
    rng = random.Random(5)
    for size in (1, 2, 3, 8):
        for _ in range(60):
            items = [(i, " ".join(rng.choices("abc", k=rng.randrange(0, 14)))) for i in range(4)]
            words = rng.choices("abc", k=60)
            found, owners = decontaminate.searchers([(str(i), t.encode()) for i, t in items], size)
            spans, got = decontaminate.scan([w.encode() for w in words], found, owners)
            (_, _, n_hit, n, digest, _) = plain([(0, " ".join(words))], items, size)[0]
            assert (sum(b - a for a, b in spans), len(got), decontaminate.digest(list(got))) == (n_hit, n, digest)


def test_table_in_one_pass_and_in_several(spark):
    rng = random.Random(6)
    items = [(i, " ".join(rng.choices(["a", "b", "c", "D"], k=rng.randrange(0, 30)))) for i in range(20)] + [(None, "a b"), (7, None), (3, "!!"), (4, "x, y")]
    docs = [(i, " ".join(rng.choices(["A", "b", "c", "d", "x-y"], k=rng.randrange(0, 80)))) for i in range(40)] + [(1, None), (None, "x y"), (5, ""), (6, "x y"), (6, "x y")]
    a = spark.createDataFrame([(*d, "k", 1) for d in docs], "doc_id long, text string, items string, n_words int")
    b = spark.createDataFrame([(*i, 9) for i in items], "item_id long, text string, doc_id long")
    want = plain(docs, items)
    for most in (10**6, 60):
        got = decontaminate.contamination(a, b, pass_bytes=most)
        assert sorted((tuple(r) for r in got.collect()), key=str) == want
        bad = {w[:3] for w in want if w[5]}
        left = decontaminate.reject(a, b, pass_bytes=most).collect()
        assert len(left) == sum(not w[5] for w in want) and left[0].__fields__ == a.columns and bad
    empty = a.limit(0)
    assert decontaminate.contamination(empty, b).count() == 0
    assert [tuple(r)[2:4] for r in decontaminate.contamination(a, b.limit(0)).distinct().select("doc_id", "n_words", "n_hit", "n_items").distinct().collect()][0] == (0, 0)
