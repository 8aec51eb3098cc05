"""Pairs of distinct words within one edit, by an equi-join on deletion keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def deletions(word: Column) -> Column:
    """A word and all it becomes without one of its letters; words one edit apart share one of these."""
    without = lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word)))
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.length(word)), lambda i: F.when(i == 0, word).otherwise(without(i))))


def near_pairs(words: DataFrame, other: DataFrame | None = None, least_length: int = 1) -> DataFrame:
    """(a, b): words of ``words`` (word) and ``other`` (or, with a < b, of the same table) one edit apart.

    Words one edit apart share a key among the word and its one-letter
    deletions, so an equality join finds every pair; the edit distance then
    drops those that only share a key.  Keys of a word number its length plus
    one; nothing is compared that shares none.
    """
    own = other is None
    keyed = lambda df: (
        df.select("word").distinct().where(F.length("word") >= least_length)
        .withColumn("key", F.explode(deletions(F.col("word"))))
    )
    a = keyed(words).withColumnRenamed("word", "a")
    b = (a.withColumnRenamed("a", "b")) if own else keyed(other).withColumnRenamed("word", "b")
    pairs = a.join(b, "key").where("a < b" if own else "a <> b").select("a", "b").distinct()
    return pairs.where(F.levenshtein("a", "b") == 1)
