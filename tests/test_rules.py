import random

import pytest
from pyspark.sql import functions as F

from collatura.operators import filters, rules, tracker
from collatura.operators.evaluation import golden_matches, recall, words_match
from collatura.plans import chapters
from tests import fixtures

S = "substitution"


@pytest.fixture(scope="module")
def own(spark):
    pairs = spark.createDataFrame(fixtures.PAIRS, "heard string, correct string, kind string")
    return filters.Dictionaries(
        lexicon=fixtures.lexicon(spark).cache(),
        pairs=filters.golden_guard(pairs, fixtures.golden(spark)).cache(),
        names=spark.createDataFrame(fixtures.NAMES, "form string").cache(),
        protected=spark.createDataFrame(fixtures.PROTECTED, "word string").cache(),
    )


#: (type, heard, expected, words before and after, whether a sentence just ended) -> the rule that decides.
CASES = [
    ((S, "делал", "делая"), "verb_grnd_protected"),
    ((S, "делали", "делал"), "different_num_protected"),
    ((S, "ключ", "ключа"), "smart_protected"),
    ((S, "делает", "делал"), "smart_protected"),
    ((S, "побежал", "бежал"), "smart_protected"),
    ((S, "а", "и"), "conjunction_protected"),
    ((S, "Дом", "дом"), "learned_identical"),
    ((S, "иван", "аранви"), "learned_name"),
    ((S, "делал", "сделал"), "smart_aspect_pair"),
    ((S, "мылся", "мыл"), "reflexive"),
    ((S, "двое", "два"), "numeral"),
    ((S, "набежал", "бежал"), "smart_prefix"),
    ((S, "малако", "молоко"), "smart_homophone"),
    ((S, "красивово", "красивого"), "learned_lemma"),
    ((S, "щас", "сейчас"), "yandex_typical"),
    ((S, "вас", "нас"), None),  # the guard keeps a verified error out of the dictionary
    (("transposition", "он был", "был он"), "safe_transposition"),
    (("insertion", "эх", ""), "interjection"),
    (("deletion", "", "в"), "alignment_artifact"),
    (("deletion", "", "в", "", "", True), None),
    (("deletion", "", "совсем"), None),
    (("deletion", "", "гильдия"), "protected_word"),
    ((S, "тёмно-синий", "тёмносиний"), "compound_word"),
    ((S, "быстро", "быстрый"), "adverb_adjective"),
    ((S, "вильгельн", "вильгельм"), "yandex_name_error"),
    (("insertion", "дом", "", "дом", ""), "duplicate_word_insertion"),
    (("insertion", "и", "", "", "делая"), "yandex_conjunction_before_gerund"),
    (("insertion", "и", "", "", "дом", True), "sentence_start_conjunction"),
    ((S, "и", "я", "", "", True), "yandex_i_ya_boundary"),
    ((S, "и", "я", "ушёл", ""), "yandex_i_ya_after_verb"),
    (("insertion", "ив", "", "", "ана"), None),  # shorter than a split name may be
    (("insertion", "виль", "", "", "гельм"), "split_name_insertion"),
    (("deletion", "", "ли", "сам", ""), "yandex_particle_deletion"),  # the documented list of short deletions has no "ли"
    (("deletion", "", "то", "кто", "дом"), "compound_particle_to"),
    ((S, "чайник", "собака"), None),
]


@pytest.fixture(scope="module")
def judged(spark, own):
    rows = [(f"{k:03d}", k, 0.0, *case[:3], "", *(case[3:5] if len(case) > 3 else ("", "")), bool(case[5]) if len(case) > 5 else False) for k, (case, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "chapter_id string, err_id long, t double, type string, wrong string, correct string, context string, before string, after string, after_stop boolean")
    out = rules.filter_errors(filters.enrich(df, own)).select("err_id", "rule", "filter_reason").collect()
    return {r["err_id"]: r for r in out}


@pytest.mark.parametrize("k", range(len(CASES)), ids=lambda k: f"{CASES[k][0][1] or '-'}/{CASES[k][0][2] or '-'}")
def test_rule(judged, k):
    assert judged[k]["rule"] == CASES[k][1]


def test_protections_keep(judged):
    keepers = {r.label for r in rules.registered_rules() if r.protects}
    for k, (_, label) in enumerate(CASES):
        assert judged[k]["filter_reason"] == (None if label in keepers else label)


def test_golden_errors_all_survive(spark, own):
    g = fixtures.golden(spark)
    rows = g.select("chapter_id", F.monotonically_increasing_id().alias("err_id"), F.col("time_seconds").cast("double").alias("t"), "type", "wrong", "correct", "context", F.lit(0).alias("marker_pos"), F.lit("").alias("transcript_context"))
    out = chapters.judge(rows, own)
    matches = golden_matches(g, out.where("filter_reason IS NULL"))
    total = {r["chapter_id"]: r for r in recall(matches).collect()}["total"]
    assert total["n_found"] == total["n_golden"] == len(fixtures.GOLDEN_ROWS), matches.where("NOT found").collect()
    # What isn't golden goes: a rule set that keeps everything would pass the check above.
    noise = fixtures.errors(spark, [(S, "щас", "сейчас"), (S, "малако", "молоко"), ("insertion", "эх", ""), (S, "иван", "ивана")])
    assert chapters.judge(noise, own).where("filter_reason IS NULL").count() == 1  # another case of a name is kept


def test_no_dictionary_pair_is_golden(spark, own):
    assert tracker.conflicts(own.pairs, fixtures.golden(spark)).count() == 0


def test_null_and_empty_words(spark, own):
    rows = fixtures.errors(spark, [(S, None, None), (S, "", ""), (None, "а", "б"), ("odd", "x", None)])
    assert chapters.judge(rows, own).count() == 4
    assert chapters.judge(rows.limit(0), own).count() == 0


def test_registry_and_order(spark):
    made = rules.register_rule(rules.Rule(0.01, "own_rule", lambda k: F.col("x") > 1))
    assert rules.registered_rules()[0] is made
    rules.unregister_rule("own_rule")
    assert "own_rule" not in {r.label for r in rules.registered_rules()}
    two = [rules.Rule(1, "a", lambda k: F.col("x") > 1), rules.Rule(2, "b", lambda k: F.col("x") > 0), rules.Rule(3, "keep", lambda k: F.col("x") == 0, protects=True)]
    got = rules.filter_errors(spark.createDataFrame([(0,), (1,), (2,), (None,)], "x int"), rules=two).collect()
    assert [(r["rule"], r["filter_reason"]) for r in got] == [("keep", None), ("b", "b"), ("a", "a"), (None, None)]


def test_config():
    assert rules.Config.load('{"chain_seconds": 1.5}').chain_seconds == 1.5
    with pytest.raises(ValueError):
        rules.Config.load('{"no_such": 1}')


def test_early_drop_keeps_what_is_unsure(spark, own):
    rows = fixtures.errors(spark, [(S, "малако", "молоко"), (S, "набежал", "бежал"), (S, "чайник", "собака")])
    left = rules.early_drop(filters.enrich(rows, own))
    assert {r["wrong"] for r in left.collect()} == {"набежал", "чайник"}


def test_chains(spark):
    rows = [("1", 1, 0.0, "один", "совершенно"), ("1", 2, 1.0, "два", "один"), ("1", 3, 2.0, "три", "два"), ("1", 4, 60.0, "пять", "три"), ("2", 5, 0.0, "кот", "кит"), ("2", 6, 1.0, "дом", "кот")]
    df = spark.createDataFrame(rows, "chapter_id string, err_id long, t double, wrong string, correct string")
    got = {r["err_id"]: r["in_chain"] for r in filters.chains(df).collect()}
    assert got == {1: True, 2: True, 3: True, 4: False, 5: False, 6: False}


def test_reason_counts(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "filter_reason string")
    assert {r["reason"]: (r["n"], round(r["share"], 3)) for r in rules.reason_counts(df).collect()} == {"a": (2, 0.667), "kept": (1, 0.333), "total": (3, 1.0)}


def test_golden_errors_meet_on_time_and_words_as_if_all_were_compared(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("абя-", k=rng.randrange(7)))
    some = lambda f: None if rng.random() < 0.03 else f()
    kind = lambda: some(lambda: rng.choice(["insertion", "deletion", "substitution"]))
    golden = [(some(lambda: rng.choice("12")), kind(), some(word), some(word), some(lambda: rng.randrange(-9, 60))) for _ in range(250)]
    golden += golden[:20]
    kept = [(some(lambda: rng.choice("12")), kind(), some(word), some(word), some(lambda: rng.randrange(-18, 120) * 0.5)) for _ in range(250)]
    kept += [(c, t, w, x, float(at + 5)) for c, t, w, x, at in golden[:40] if at is not None]
    kept += [(c, t, w, x and x + "я", at - 4.5) for c, t, w, x, at in golden[40:120] if at is not None]
    g = spark.createDataFrame(golden, "chapter_id string, type string, wrong string, correct string, time_seconds int")
    k = spark.createDataFrame(kept, "chapter_id string, type string, wrong string, correct string, t double")
    match = lambda a, b: words_match(F.col(f"g.{a}"), F.col(f"k.{b}"))
    near = F.abs(F.col("g.time_seconds") - F.col("k.t")) <= 5
    all_ = g.alias("g").join(k.alias("k"), (F.col("g.chapter_id") == F.col("k.chapter_id")) & (F.col("g.type") == F.col("k.type")) & match("wrong", "wrong") & match("correct", "correct") & near)
    found = {tuple(r) for r in all_.select("g.*").collect()}
    assert 40 < len(found) < len(set(golden))
    got = golden_matches(g, k)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((*r, r in found)) for r in golden)
    # The join is on all of these, so no chapter is compared with itself as a whole.
    keys = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join LeftSemi" in line]
    assert len(keys) == 1 and "_at" in keys[0] and "_key" in keys[0]
