import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from collatura.functions import text as X


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if not isinstance(v, (int, float)) else 'double'}" for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("make", "want"),
    [
        (lambda: X.clean(F.lit("Ёлка, «дом»! кто-то")), "ёлка дом кто-то"),
        (lambda: X.norm_word(F.lit("Ёлка!")), "елка"),
        (lambda: X.words(F.lit("Кот, 2 кота и cat's")), ["кот", "кота", "и", "cat", "s"]),
        (lambda: X.dialogue_dashes(F.lit("— Да.\n – Нет - да")), "Да.\nНет - да"),
        (lambda: X.spaced_dashes(F.lit("он — тот, кто-то")), "он тот, кто-то"),
        (lambda: X.split_hyphens(F.lit("темно-синий")), "темно синий"),
        (lambda: X.split_hyphens(F.lit("кто-то"), ("кто-то",)), "кто-то"),
        (lambda: X.expand_abbreviations(F.lit("и т.д. и т. п."), {"т.д.": "так далее", "т. п.": "тому подобное"}), "и так далее и тому подобное"),
        (lambda: X.without(F.array(F.lit("ах"), F.lit("он")), ("ах",)), ["он"]),
        (lambda: X.similarity(F.lit("кот"), F.lit("кит")), 2 / 3),
        (lambda: X.similarity(F.lit(""), F.lit("")), 1.0),
        (lambda: X.within(F.lit("свиток"), F.lit("цветок"), 2), True),
        (lambda: X.within(F.lit("свиток"), F.lit("цветок"), 1), False),
        (lambda: X.duration(F.lit(125.9)), "2:05"),
        (lambda: X.seconds_of(F.lit("2:05")), 125),
        (lambda: X.seconds_of(F.lit("1:02:05")), 3725),
        (lambda: X.stamp(F.lit("12.5s")), 12.5),
        (lambda: X.word_position(F.lit("Он, конечно, ушёл"), F.lit("ушел")), 2),
        (lambda: X.word_position(F.lit("конечно"), F.lit("он")), -1),
        (lambda: X.marker(F.lit("substitution"), F.lit("a"), F.lit("b")), "a -> b"),
        (lambda: X.marker(F.lit("deletion"), F.lit(""), F.lit("b")), "- b"),
        (lambda: X.chapter_id(F.lit("Глава2.txt")), "02"),
        (lambda: X.chapter_id(F.lit("ch123")), "123"),
        (lambda: X.chapter_id(F.lit("none")), ""),
        (lambda: X.common_prefix(F.lit("abcd"), F.lit("abxy")), 2),
        (lambda: X.common_prefix(F.lit("abc"), F.lit("abcd")), 3),
        (lambda: X.common_prefix(F.lit("abc"), F.lit("abc")), 3),
        (lambda: X.with_unit(F.lit(21), ("миллилитр", "миллилитра", "миллилитров")), "миллилитр"),
        (lambda: X.with_unit(F.lit(12), ("миллилитр", "миллилитра", "миллилитров")), "миллилитров"),
        (lambda: X.with_unit(F.lit(3), ("миллилитр", "миллилитра", "миллилитров")), "миллилитра"),
    ],
)
def test_expressions(spark, make, want):
    got = one(spark, make())
    assert got == (pytest.approx(want) if isinstance(want, float) else want)


def test_sounds(spark):
    key = lambda w: one(spark, X.phonetic_key(F.lit(w)))
    for a, b in (("лестница", "лесница"), ("молоко", "малако"), ("дуб", "дуп"), ("сердце", "серце"), ("поздно", "позно")):
        assert key(a) == key(b), (a, b)
    for a, b in (("дом", "дым"), ("кот", "кит"), ("балка", "палка")):
        assert key(a) != key(b), (a, b)


@pytest.mark.parametrize(
    ("n", "want"),
    [
        (0, "ноль"), (1, "один"), (11, "одиннадцать"), (21, "двадцать один"), (40, "сорок"), (100, "сто"), (999, "девятьсот девяносто девять"),
        (1000, "одна тысяча"), (2000, "две тысячи"), (5011, "пять тысяч одиннадцать"), (21_000, "двадцать одна тысяча"), (1_000_000, "один миллион"),
        (-7, "минус семь"), (2_000_003, "два миллиона три"),
    ],
)
def test_numbers_in_words(n, want):
    assert X.number_in_words(n) == want


def test_numbers_agree():
    assert X.number_in_words(2, "f") == "две"
    assert X.number_in_words(5, genitive=True) == "пяти"
    assert X.number_in_words(14, genitive=True) == "четырнадцати"
    assert X.number_in_words(2000, genitive=True) == "двух тысяч"
    assert [X.plural_form(n) for n in (1, 2, 5, 11, 14, 21, 104, 111)] == [0, 1, 2, 2, 2, 0, 1, 2]


@settings(max_examples=200)
@given(st.integers(0, 10**9))
def test_numbers_in_words_are_distinct_and_of_known_words(n):
    words = X.number_in_words(n)
    assert words and words != X.number_in_words(n + 1) and "  " not in words


def test_number_words_column(spark):
    rows = spark.createDataFrame([(1,), (None,), (25,)], "n long").select(X.number_words("n").alias("x")).collect()
    assert [r["x"] for r in rows] == ["один", None, "двадцать пять"]
