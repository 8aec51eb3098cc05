"""False positives over time: accumulate, rank, classify, resolve, and watch for regressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAIR = ["wrong", "correct", "type"]


def accumulate(occurrences: DataFrame, keys: list[str] = PAIR, source: str = "source", seen: str = "seen_at") -> DataFrame:
    """(keys, count, sources, first_seen, last_seen) of each pattern; sources sorted."""
    return occurrences.groupBy(*keys).agg(
        F.count("*").alias("count"),
        F.sort_array(F.collect_set(source)).alias("sources"),
        F.min(seen).alias("first_seen"),
        F.max(seen).alias("last_seen"),
    )


def top(patterns: DataFrame, n: int, by: str = "count", ties: list[str] | None = None) -> DataFrame:
    """The n most frequent; ties by key, so that reruns agree."""
    return patterns.orderBy(F.col(by).desc(), *(ties or PAIR)).limit(n)


def first_errors(errors: DataFrame, n: int) -> DataFrame:
    return errors.orderBy("t", "err_id").limit(n)


def without_golden(rows: DataFrame, golden: DataFrame, on: list[str] = PAIR) -> DataFrame:
    """Rows that are no verified error."""
    return rows.join(golden.select(*on).distinct(), on, "left_anti")


def regressions(rows: DataFrame, resolved: DataFrame, on: list[str] = PAIR) -> DataFrame:
    """Rows whose pattern was resolved before."""
    return rows.join(resolved.select(*on).distinct(), on, "left_semi")


def latest(events: DataFrame, by: list[str], at: str, ties: list[str]) -> DataFrame:
    """The last event of each key; of events at one time, the last by ``ties``."""
    order = Window.partitionBy(*by).orderBy(F.col(at).desc(), *[F.col(x).desc() for x in ties])
    return events.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def search(patterns: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Patterns with the text in any of the columns, whatever its case."""
    test: Column = F.lit(False)
    for name in columns:
        test = test | F.lower(name).contains(text.lower())
    return patterns.where(test)


def mark_golden(patterns: DataFrame, golden: DataFrame, on: list[str] = PAIR) -> DataFrame:
    """``patterns`` with ``is_golden``."""
    known = golden.select(*on).distinct().withColumn("_g", F.lit(True))
    return patterns.join(known, on, "left").withColumn("is_golden", F.coalesce("_g", F.lit(False))).drop("_g")


def migrate(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both stores' occurrences; columns one lacks are null."""
    return old.unionByName(new, allowMissingColumns=True)


def conflicts(pairs: DataFrame, golden: DataFrame) -> DataFrame:
    """Dictionary pairs (heard, correct, kind) that are verified errors, in either direction."""
    g = golden.select(F.col("wrong").alias("heard"), "correct")
    both = g.unionByName(g.select(F.col("correct").alias("heard"), F.col("heard").alias("correct"))).distinct()
    return pairs.join(both, ["heard", "correct"]).select(*pairs.columns)


def classify(wrong: Column, correct: Column, prefixes: tuple[str, ...] = ("не", "на", "по", "от", "у", "вы", "за"), short: int = 2, shared: int = 3) -> Column:
    """The class of a pattern by its words alone; the first that fits."""
    more = lambda x, y: x.isin(*[F.concat(F.lit(p), y) for p in prefixes]) if prefixes else F.lit(False)
    plain = lambda x: F.regexp_replace(x, "[ -]", "")
    return (
        F.when((wrong == "") | (correct == ""), "alignment_artifact")
        .when((plain(wrong) == plain(correct)) & (wrong != correct), "compound_word")
        .when(more(wrong, correct) | more(correct, wrong), "prefix_variant")
        .when(F.greatest(F.length(wrong), F.length(correct)) <= short, "short_word")
        .when((F.left(wrong, F.lit(shared)) == F.left(correct, F.lit(shared))) & (F.length(wrong) > shared) & (F.length(correct) > shared), "grammar_ending")
        .when(F.levenshtein(wrong, correct) <= 1, "phonetic")
        .otherwise("unknown")
    )


def stats(patterns: DataFrame, category: Column, resolved: Column) -> DataFrame:
    """(category, resolved, n_patterns, n_seen)."""
    return patterns.groupBy(category.alias("category"), resolved.alias("resolved")).agg(F.count("*").alias("n_patterns"), F.sum("count").alias("n_seen"))


def update_analysis(patterns: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Patterns with lemma, part of speech and aspect of the expected word, looked up anew."""
    from collatura.functions.morphology import analyse

    kept = patterns.drop("lemma", "pos", "aspect")
    return analyse(kept, "correct", lexicon, "_m").withColumns({f: F.col(f"_m.{f}") for f in ("lemma", "pos", "aspect")}).drop("_m")


def contexts(errors: DataFrame, sources: dict[str, DataFrame], on: list[str]) -> DataFrame:
    """Errors with a context from each source (on, context), and the first one present."""
    out = errors
    for name, table in sources.items():
        out = out.join(table.select(*on, F.col("context").alias(f"{name}_context")), on, "left")
    return out.withColumn("best_context", F.coalesce(*[F.col(f"{name}_context") for name in sources], F.lit("")))


def suggestion(kind: Column) -> Column:
    """What to do about a pattern of a class."""
    return (
        F.when(kind == "grammar_ending", "add an ending pair")
        .when(kind == "prefix_variant", "add a prefix")
        .when(kind == "phonetic", "add a homophone pair")
        .when(kind == "alignment_artifact", "list the short word")
        .when(kind == "compound_word", "list the compound")
        .otherwise("review")
    )
