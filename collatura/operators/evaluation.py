"""How well a run does: golden recall, totals, trends and differences between versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from collatura.functions.text import norm_word
from collatura.operators.pairs import deletions


def words_match(a: Column, b: Column, short: int = 3, edits: int = 1) -> Column:
    """Equal in normal form; words longer than ``short`` may differ by ``edits``."""
    a, b = norm_word(a), norm_word(b)
    near = F.levenshtein(a, b, edits).between(0, edits) & (F.least(F.length(a), F.length(b)) > short)
    return (a == b) | near


def golden_matches(golden: DataFrame, kept: DataFrame, seconds: float = 5.0) -> DataFrame:
    """``golden`` with ``found``: whether a kept error of its chapter and type has its words within ``seconds``.

    Errors meet on equality, so no chapter is compared with itself as a whole:
    a stretch of time, and a key among the decisive word and its one-letter
    deletions, one of which words that match share.
    """
    key, names = ["chapter_id", "type", "wrong", "correct"], ["_ch", "_ty", "_w", "_c"]
    span = max(4.0 * seconds, 1.0)
    stretch = lambda t: F.floor(t.cast("double") / span)
    word = lambda type_, wrong, correct: norm_word(F.when(type_ == "insertion", wrong).otherwise(correct))
    g = golden.select(*key, "time_seconds").distinct()
    g = g.withColumns({"_at": stretch(F.col("time_seconds")), "_key": F.explode(deletions(word(F.col("type"), F.col("wrong"), F.col("correct"))))})
    k = kept.select(*[F.col(a).alias(b) for a, b in zip(key, names, strict=True)], F.col("t").alias("_t")).distinct()
    # More than ``seconds`` at either side, so that rounding loses nothing.
    near = F.sequence(stretch(F.col("_t").cast("double") - 0.375 * span), stretch(F.col("_t").cast("double") + 0.375 * span))
    k = k.withColumn("_at", F.explode(near)).withColumn("_key", F.explode(deletions(word(F.col("_ty"), F.col("_w"), F.col("_c")))))
    k = k.withColumnsRenamed({"_at": "_at2", "_key": "_key2"})
    test = (F.col("chapter_id") == F.col("_ch")) & (F.col("type") == F.col("_ty")) & (F.col("_at") == F.col("_at2")) & (F.col("_key") == F.col("_key2"))
    test &= words_match(F.col("wrong"), F.col("_w")) & words_match(F.col("correct"), F.col("_c")) & (F.abs(F.col("time_seconds") - F.col("_t")) <= seconds)
    found = g.join(k, test, "left_semi").select(*[F.col(c).alias(f"_{c}") for c in (*key, "time_seconds")]).distinct().withColumn("_f", F.lit(True))
    same = [F.col(c) == F.col(f"_{c}") for c in (*key, "time_seconds")]
    return golden.join(found, same, "left").withColumn("found", F.coalesce("_f", F.lit(False))).select(*golden.columns, "found")


def recall(matches: DataFrame, by: str = "chapter_id") -> DataFrame:
    """(by, n_golden, n_found, recall) with a row "total"."""
    out = matches.rollup(by).agg(F.count("*").alias("n_golden"), F.count_if("found").alias("n_found"))
    return out.select(F.coalesce(F.col(by), F.lit("total")).alias(by), "n_golden", "n_found", (F.col("n_found") / F.col("n_golden")).alias("recall"))


def totals(rows: DataFrame, by: str, value: Column) -> DataFrame:
    """(by, n, total) for each value of a column and for all."""
    return rows.rollup(by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.coalesce(F.col(by), F.lit("total")).alias(by), "n", "total")


def trend(runs: DataFrame, by: str, at: str, value: str, steps: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``runs`` with the values of earlier runs and the change since the last."""
    order = Window.partitionBy(by).orderBy(at)
    out = runs.withColumns({f"{value}_{k}_before": F.lag(value, k).over(order) for k in steps})
    return out.withColumn("change", F.col(value) - F.col(f"{value}_{steps[0]}_before"))


def delta(old: DataFrame, new: DataFrame, on: str, values: list[str]) -> DataFrame:
    """(on, value_old, value_new, value_delta ...) of two runs; a side without a row counts 0."""
    a = old.select(F.col(on), *[F.col(v).alias(f"{v}_old") for v in values])
    b = new.select(F.col(on), *[F.col(v).alias(f"{v}_new") for v in values])
    out = a.join(b, on, "full").na.fill(0)
    return out.withColumns({f"{v}_delta": F.col(f"{v}_new") - F.col(f"{v}_old") for v in values})


def feature_rate(pairs: DataFrame, feature: str, label: str) -> DataFrame:
    """(feature, n, rate): how often a feature's value goes with a false positive."""
    return pairs.groupBy(feature).agg(F.count("*").alias("n"), F.avg(F.col(label).cast("double")).alias("rate"))


def correspondence(a: Column, b: Column, least: float = 0.3) -> tuple[Column, Column]:
    """Share of distinct words two texts have in common (Jaccard), and whether that is too little for one chapter."""
    both, any_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    share = F.when(any_ > 0, both / any_).otherwise(1.0)
    return share, share < least
