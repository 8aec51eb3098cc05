"""Text functions as column expressions; all run inside whole-stage code but the number words."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters of any script; ``\\w`` knows ASCII only.
LETTERS = r"(\p{L}+)"
VOWELS = "аеёиоуыэюя"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean(text: Column | str) -> Column:
    """Lower case, without punctuation other than hyphens inside words."""
    return F.regexp_replace(F.lower(_c(text)), r"[^\p{L}\p{N}\s-]", "")


def norm_word(word: Column | str) -> Column:
    """The one form in which words are compared: lower case, ё as е, no punctuation."""
    return F.translate(F.regexp_replace(F.lower(_c(word)), r"[^\p{L}\p{N}-]", ""), "ё", "е")


def words(text: Column | str) -> Column:
    """Runs of letters, lower-cased, as an array."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(LETTERS), 1)


def dialogue_dashes(text: Column | str) -> Column:
    """Without the dash that opens a line of dialogue."""
    return F.regexp_replace(_c(text), r"(?m)^\s*[–—-]\s*", "")


def spaced_dashes(text: Column | str) -> Column:
    """A dash between spaces becomes a space."""
    return F.regexp_replace(_c(text), r"\s+[–—-]\s+", " ")


def split_hyphens(word: Column | str, keep: tuple[str, ...] = ()) -> Column:
    """Hyphens inside a word become spaces, unless the word is to keep them."""
    w = _c(word)
    return F.when(F.lower(w).isin(*keep), w).otherwise(F.regexp_replace(w, "[-‐‑]", " ")) if keep else F.regexp_replace(w, "[-‐‑]", " ")


def expand_abbreviations(text: Column | str, full: dict[str, str]) -> Column:
    """Abbreviations in full, longest first, where no letter is beside them."""
    order = sorted(full, key=lambda k: (-len(k), k))
    quote = lambda s: "".join("\\" + c if c in r"\.[]{}()*+-?^$|" else c for c in s)
    return reduce(lambda c, k: F.regexp_replace(c, rf"(?i)(?<!\p{{L}}){quote(k)}(?!\p{{L}})", full[k]), order, _c(text))


def without(tokens: Column | str, words_: tuple[str, ...]) -> Column:
    """An array of words without those listed."""
    listed = F.array(*[F.lit(w) for w in words_]) if words_ else F.array().cast("array<string>")
    return F.filter(_c(tokens), lambda w: ~F.array_contains(listed, w))


# Number words (fixed values): units by gender, teens, tens, hundreds, and thousands by plural form.
_UNITS = {
    "m": ["", "один", "два", "три", "четыре", "пять", "шесть", "семь", "восемь", "девять"],
    "f": ["", "одна", "две", "три", "четыре", "пять", "шесть", "семь", "восемь", "девять"],
    "n": ["", "одно", "два", "три", "четыре", "пять", "шесть", "семь", "восемь", "девять"],
}
_UNITS_GEN = {
    "m": ["", "одного", "двух", "трёх", "четырёх", "пяти", "шести", "семи", "восьми", "девяти"],
    "f": ["", "одной", "двух", "трёх", "четырёх", "пяти", "шести", "семи", "восьми", "девяти"],
    "n": ["", "одного", "двух", "трёх", "четырёх", "пяти", "шести", "семи", "восьми", "девяти"],
}
_TEENS = ["десять", "одиннадцать", "двенадцать", "тринадцать", "четырнадцать", "пятнадцать", "шестнадцать", "семнадцать", "восемнадцать", "девятнадцать"]
_TENS = ["", "", "двадцать", "тридцать", "сорок", "пятьдесят", "шестьдесят", "семьдесят", "восемьдесят", "девяносто"]
_TENS_GEN = ["", "", "двадцати", "тридцати", "сорока", "пятидесяти", "шестидесяти", "семидесяти", "восьмидесяти", "девяноста"]
_HUNDREDS = ["", "сто", "двести", "триста", "четыреста", "пятьсот", "шестьсот", "семьсот", "восемьсот", "девятьсот"]
_HUNDREDS_GEN = ["", "ста", "двухсот", "трёхсот", "четырёхсот", "пятисот", "шестисот", "семисот", "восьмисот", "девятисот"]
_GROUPS = [("тысяча", "тысячи", "тысяч", "f"), ("миллион", "миллиона", "миллионов", "m"), ("миллиард", "миллиарда", "миллиардов", "m")]


def plural_form(n: int) -> int:
    """0, 1 or 2: which of (one, few, many) agrees with a number."""
    n = abs(n) % 100
    if 11 <= n <= 14:
        return 2
    return 0 if n % 10 == 1 else 1 if 2 <= n % 10 <= 4 else 2


def _below_thousand(n: int, gender: str, genitive: bool) -> list[str]:
    units, tens, hundreds = (_UNITS_GEN, _TENS_GEN, _HUNDREDS_GEN) if genitive else (_UNITS, _TENS, _HUNDREDS)
    out = [hundreds[n // 100]]
    n %= 100
    if 10 <= n <= 19:
        out.append(_TEENS[n - 10][:-1] + "и" if genitive else _TEENS[n - 10])
    else:
        out += [tens[n // 10], units[gender][n % 10]]
    return [w for w in out if w]


def number_in_words(n: int, gender: str = "m", genitive: bool = False) -> str:
    """A whole number below 10^12 in words, in the nominative or the genitive."""
    if n == 0:
        return "нуля" if genitive else "ноль"
    if n < 0:
        return "минус " + number_in_words(-n, gender, genitive)
    out: list[str] = []
    for k in range(len(_GROUPS), 0, -1):
        part = n // 1000**k % 1000
        if part:
            one, few, many, own = _GROUPS[k - 1]
            name = (few if plural_form(part) == 0 else many) if genitive else (one, few, many)[plural_form(part)]
            if genitive and k == 1 and plural_form(part) == 0:
                name = "тысячи"
            out += [*_below_thousand(part, own, genitive), name]
    return " ".join(out + _below_thousand(n % 1000, gender, genitive))


def number_words(n: Column | str) -> Column:
    """Whole numbers in words; null stays null.  Agreement needs Python, in Arrow batches."""

    def run(n: pd.Series) -> pd.Series:
        return n.map(lambda x: None if pd.isna(x) else number_in_words(int(x)))

    return F.pandas_udf(run, "string")(_c(n).cast("long"))


def with_unit(n: Column | str, forms: tuple[str, str, str]) -> Column:
    """The form of a unit (one, few, many) that agrees with a whole number."""
    n = F.abs(_c(n))
    teen = F.pmod(n, F.lit(100)).between(11, 14)
    last = F.pmod(n, F.lit(10))
    return F.when(teen, forms[2]).when(last == 1, forms[0]).when(last.between(2, 4), forms[1]).otherwise(forms[2])


def similarity(a: Column | str, b: Column | str) -> Column:
    """1 less the edit distance over the longer length; two empty words are alike."""
    a, b = _c(a), _c(b)
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.levenshtein(a, b) / longer)


def within(a: Column | str, b: Column | str, k: int) -> Column:
    """Whether the edit distance is at most k; the bounded form gives -1 beyond it."""
    return F.levenshtein(_c(a), _c(b), k) >= 0


#: Silent consonants in clusters, and pairs of sounds that fall together (fixed values).
CLUSTERS = (("стн", "сн"), ("здн", "зн"), ("лнц", "нц"), ("рдц", "рц"), ("вств", "ств"), ("тся", "ца"), ("ться", "ца"), ("сч", "щ"), ("зч", "щ"))
VOICED, VOICELESS = "бвгджз", "пфктшс"


def phonetic_key(word: Column | str) -> Column:
    """How a Russian word sounds, roughly: silent consonants go, unstressed vowels reduce, final and clustered consonants lose voice."""
    w = F.translate(F.lower(_c(word)), "ёъь", "е")
    for heard, said in CLUSTERS:
        w = F.regexp_replace(w, heard.replace("ь", ""), said)
    w = F.translate(w, "оея", "аии")
    for loud, soft in zip(VOICED, VOICELESS, strict=True):
        w = F.regexp_replace(w, f"{loud}(?=[пфктшсхцчщ]|$)", soft)
    return F.regexp_replace(w, r"(\p{L})\1+", "$1")


def duration(seconds: Column | str) -> Column:
    """Seconds as M:SS."""
    s = F.floor(_c(seconds)).cast("long")
    return F.format_string("%d:%02d", F.floor(s / 60).cast("long"), F.pmod(s, F.lit(60)))


def seconds_of(time: Column | str) -> Column:
    """M:SS or H:MM:SS as seconds."""
    return F.aggregate(F.split(_c(time), ":"), F.lit(0).cast("long"), lambda s, x: s * 60 + x.cast("long"))


def stamp(time: Column | str) -> Column:
    """Seconds of a stamp such as "12.5s" or "12.5"."""
    return F.regexp_replace(_c(time), "s$", "").cast("double")


def word_position(context: Column | str, word: Column | str) -> Column:
    """Position (from 0) of a whole word among the context's words, -1 if it isn't there; compared in normal form."""
    parts = F.transform(F.split(F.trim(_c(context)), r"\s+"), norm_word)
    return F.coalesce(F.array_position(parts, norm_word(word)), F.lit(0)).cast("int") - 1


def marker(type_: Column | str, wrong: Column | str, correct: Column | str) -> Column:
    """A difference as readers see it, by type."""
    t, w, c = _c(type_), _c(wrong), _c(correct)
    return (
        F.when(t == "substitution", F.concat(w, F.lit(" -> "), c))
        .when(t == "transposition", F.concat(w, F.lit(" <-> "), c))
        .when(t == "insertion", F.concat(F.lit("+ "), w))
        .when(t == "deletion", F.concat(F.lit("- "), c))
    )


def chapter_id(name: Column | str) -> Column:
    """The first number in a name, two digits at least; "" without one."""
    found = F.regexp_extract(_c(name), r"(\d+)", 1)
    return F.when(F.length(found) >= 2, found).when(F.length(found) == 1, F.concat(F.lit("0"), found)).otherwise("")


def cache_key(*parts: Column | str) -> Column:
    """SHA-256 of the parts, separated by a zero byte."""
    return F.sha2(F.concat_ws("\x00", *[_c(p).cast("string") for p in parts]), 256)


def pair_key(a: Column | str, b: Column | str) -> Column:
    """An unordered pair as an array, least first."""
    return F.array(F.least(_c(a), _c(b)), F.greatest(_c(a), _c(b)))


def common_prefix(a: Column | str, b: Column | str) -> Column:
    """Length of the longest common prefix."""
    a, b = _c(a), _c(b)
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.least(F.coalesce(F.array_position(same, False), F.lit(0)) - 1 + F.when(F.array_position(same, False) == 0, F.size(same) + 1).otherwise(0), F.length(a), F.length(b)).cast("int")
