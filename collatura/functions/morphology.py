"""Grammar by lookup: each distinct word is joined once with a lexicon, then joined back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ("lemma", "pos", "number", "gender", "case", "aspect", "voice", "tense")
#: Endings that mark a gerund where the lexicon knows no part of speech (fixed values).
GERUND_ENDINGS = ("вши", "вшись", "ая", "яя", "ив", "ав")
#: Prefixes that a verb gets without becoming another verb for the listener (fixed values).
PREFIXES = ("не", "на", "по", "от", "у", "вы", "за")


def first_choice(lexicon: DataFrame) -> DataFrame:
    """One analysis a form: that of the least rank, ties by lemma and part of speech."""
    order = Window.partitionBy("form").orderBy(F.col("rank").asc_nulls_last(), "lemma", "pos")
    return lexicon.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "rank")


def analyse(df: DataFrame, word: str, lexicon: DataFrame, name: str) -> DataFrame:
    """``df`` with a struct column ``name``: the analysis of its column ``word``, null fields if unknown.

    An unknown word whose ending is a gerund's gets that part of speech.  The
    lexicon is a table of the user's: Spark broadcasts it if its measured size
    is below the session's threshold, and else joins it by hash.
    """
    found = first_choice(lexicon).select(F.col("form").alias("_form"), *[F.col(f).alias(f"_{f}") for f in FIELDS])
    joined = df.join(found, F.col(word) == F.col("_form"), "left")
    guess = F.when(F.col(word).rlike("(" + "|".join(GERUND_ENDINGS) + ")$") & (F.length(word) > 4), F.lit("GRND"))
    values = [F.coalesce("_pos", guess).alias("pos") if f == "pos" else F.col(f"_{f}").alias(f) for f in FIELDS]
    return joined.withColumn(name, F.struct(*values)).drop("_form", *[f"_{f}" for f in FIELDS])


def distinct_analysis(df: DataFrame, columns: list[str], lexicon: DataFrame) -> DataFrame:
    """(word, a): every distinct word of the columns with its analysis, looked up once however often it occurs."""
    each = df.select(F.explode(F.array(*columns)).alias("word")).where("word <> ''").distinct()
    return analyse(each, "word", lexicon, "a")


def hit_rate(df: DataFrame, word: str) -> DataFrame:
    """(n_words, n_distinct, hit_rate): the share of lookups that remembering words saves."""
    # Counts by word first: a distinct count then sums over groups instead of carrying all words to one task.
    counts = df.where(F.col(word).isNotNull()).groupBy(word).agg(F.count("*").alias("n"))
    out = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_words"), F.count("*").alias("n_distinct"))
    return out.withColumn("hit_rate", F.when(F.col("n_words") > 0, F.lit(1.0) - F.col("n_distinct") / F.col("n_words")))


def same(a: Column, b: Column, field: str) -> Column:
    return F.coalesce(a[field] == b[field], F.lit(False))


def differs(a: Column, b: Column, field: str) -> Column:
    """Whether both are known and not the same."""
    return F.coalesce(a[field] != b[field], F.lit(False))


def stem(lemma: Column) -> Column:
    """A lemma without the prefix and the suffixes that make a verb's aspect."""
    bare = F.regexp_replace(lemma, r"^(?:по|на|за|вы|от|про|при|у|с)(?=\p{L}{4})", "")
    return F.regexp_replace(bare, r"(?:ивать|ывать|вать|ать|ять|ить|еть|нуть|ть)$", "")


def is_verb(a: Column) -> Column:
    return F.coalesce(a["pos"].isin("VERB", "INFN", "GRND", "PRTF", "PRTS"), F.lit(False))


def same_verb_base(a: Column, b: Column) -> Column:
    """Verbs of one stem."""
    return is_verb(a) & is_verb(b) & F.coalesce(stem(a["lemma"]) == stem(b["lemma"]), F.lit(False))


def aspect_pair(a: Column, b: Column) -> Column:
    """Verbs of one stem that differ in aspect; pairs of different stems are not known as such."""
    return same_verb_base(a, b) & differs(a, b, "aspect")


def lemma_match(a: Column, b: Column) -> Column:
    """One lemma, with no known difference in case or tense."""
    return same(a, b, "lemma") & ~differs(a, b, "case") & ~differs(a, b, "tense")


def same_grammar(a: Column, b: Column) -> Column:
    """One lemma and part of speech, with no known difference in any of the fields."""
    out = same(a, b, "lemma") & same(a, b, "pos")
    for field in ("number", "gender", "case", "aspect", "voice", "tense"):
        out = out & ~differs(a, b, field)
    return out


def case_forms(base: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(base, form): every form of the lemmas in ``base`` (base), the lemma itself included."""
    forms = lexicon.select(F.col("lemma").alias("base"), "form")
    return base.join(forms, "base").unionByName(base.select("base", F.col("base").alias("form"))).distinct()


def proper_names(tokens: DataFrame, known: DataFrame | None = None, lexicon: DataFrame | None = None) -> DataFrame:
    """(name, n_words, n): capitalised words inside sentences, and pairs of successive ones, with counts.

    ``tokens`` has (doc, pos, word, starts_sentence).  With a lexicon, single
    words whose part of speech is not a name's are left out; names in
    ``known`` (name) are left out.
    """
    w = Window.partitionBy("doc").orderBy("pos")
    capital = F.col("word").rlike(r"^\p{Lu}\p{Ll}+$") & ~F.col("starts_sentence")
    marked = tokens.withColumn("cap", capital)
    marked = marked.withColumns({"next": F.lead("word").over(w), "next_cap": F.coalesce(F.lead("cap").over(w), F.lit(False))})
    one = marked.where("cap").select(F.col("word").alias("name"), F.lit(1).alias("n_words"))
    two = marked.where("cap AND next_cap").select(F.concat_ws(" ", "word", "next").alias("name"), F.lit(2).alias("n_words"))
    found = one.unionByName(two).groupBy("name", "n_words").agg(F.count("*").alias("n"))
    if lexicon is not None:
        names = lexicon.where(F.col("pos").isin("Name", "Surn", "Patr", "Geox")).select(F.col("form").alias("f")).distinct()
        found = found.join(names, F.lower("name") == F.col("f"), "left").where("n_words = 2 OR f IS NOT NULL").drop("f")
    return found.join(known.select("name").distinct(), "name", "left_anti") if known is not None else found
