"""Features of a word pair, for telling false positives from errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collatura.functions import morphology as M
from collatura.functions import text as X
from collatura.operators.filters import prefix_variant

TEXT_FEATURES = ("len_a", "len_b", "len_diff", "len_ratio", "edits", "edits_norm", "sound_edits", "sound_same", "is_prefix", "is_short", "common_letters", "first_same", "last_same")
GRAMMAR_FEATURES = ("lemma_same", "lemma_edits", "pos_same", "number_same", "case_same", "gender_same", "aspect_pair", "smart_rule")
ALL_FEATURES = TEXT_FEATURES + GRAMMAR_FEATURES


def text_features(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``pairs`` with the features that words alone give."""
    x, y = F.col(a), F.col(b)
    n, m = F.length(x), F.length(y)
    longer = F.greatest(n, m, F.lit(1))
    letters = lambda w: F.array_distinct(F.filter(F.split(w, ""), lambda s: s != ""))
    both = F.size(F.array_intersect(letters(x), letters(y)))
    any_ = F.size(F.array_union(letters(x), letters(y)))
    bit = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return pairs.withColumns({
        "len_a": n.cast("double"),
        "len_b": m.cast("double"),
        "len_diff": F.abs(n - m).cast("double"),
        "len_ratio": F.least(n, m) / longer,
        "edits": F.levenshtein(x, y).cast("double"),
        "edits_norm": F.levenshtein(x, y) / longer,
        "sound_edits": F.levenshtein(X.phonetic_key(x), X.phonetic_key(y)).cast("double"),
        "sound_same": bit(X.phonetic_key(x) == X.phonetic_key(y)),
        "is_prefix": bit(prefix_variant(x, y)),
        "is_short": bit(F.greatest(n, m) <= 3),
        "common_letters": F.when(any_ > 0, both / any_).otherwise(0.0),
        "first_same": bit(F.left(x, F.lit(1)) == F.left(y, F.lit(1))),
        "last_same": bit(F.right(x, F.lit(1)) == F.right(y, F.lit(1))),
    })


def pair_features(pairs: DataFrame, lexicon: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``pairs`` with all features; unknown words give 0 where a feature compares grammar."""
    rows = M.analyse(M.analyse(text_features(pairs, a, b), a, lexicon, "_am"), b, lexicon, "_bm")
    p, q = F.col("_am"), F.col("_bm")
    bit = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    smart = M.aspect_pair(p, q) | M.lemma_match(p, q) | (F.col("sound_same") == 1.0)
    rows = rows.withColumns({
        "lemma_same": bit(M.same(p, q, "lemma")),
        "lemma_edits": F.coalesce(F.levenshtein(p["lemma"], q["lemma"]), F.col("edits")).cast("double"),
        "pos_same": bit(M.same(p, q, "pos")),
        "number_same": bit(M.same(p, q, "number")),
        "case_same": bit(M.same(p, q, "case")),
        "gender_same": bit(M.same(p, q, "gender")),
        "aspect_pair": bit(M.aspect_pair(p, q)),
        "smart_rule": bit(smart),
    })
    return rows.drop("_am", "_bm")
