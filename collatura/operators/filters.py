"""The rules: protections, learned and smart rules, legacy levels, and those that look at neighbours.

Word lists here are small and our own; users pass tables of theirs to ``enrich``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from collatura.functions import morphology as M
from collatura.functions import text as X
from collatura.operators.pairs import near_pairs
from collatura.operators.rules import Config, rule

# Word lists (fixed values).
INTERJECTIONS = ("а", "ах", "ай", "ой", "ох", "ух", "эх", "эй", "хм", "гм", "мм", "угу", "ага", "ну")
WEAK_WORDS = ("тот", "так", "эти", "то", "несколько", "эдак", "же", "ли", "бы", "вот", "ведь", "уж", "это", "там", "тут")
SHORT_DELETIONS = ("в", "о", "у", "к", "с", "но", "ни", "им", "на", "до", "же", "да", "х", "не", "так")
PARTICLES = ("же", "ли", "ль")
PRONOUNS = ("я", "ты", "он", "она", "оно", "мы", "вы", "они", "кто", "что", "это", "тот", "все", "сам")
ADVERBS = ("так", "как", "где", "там", "тут", "куда", "когда", "едва", "почти", "вряд")
CONJUNCTIONS = ("и", "а", "но", "или")
ENDINGS = (("ый", "ой"), ("ий", "ей"), ("ие", "ые"), ("ого", "его"), ("ому", "ему"), ("ться", "тся"), ("ние", "нье"), ("ия", "ья"), ("ию", "ью"))
NUMERALS = (("два", "двое"), ("три", "трое"), ("четыре", "четверо"), ("пять", "пятеро"), ("оба", "обе"), ("двести", "двухсот"))
COMPOUND_PREFIXES = ("пол", "полу", "само", "все", "пере", "недо", "свежее")


@dataclass
class Dictionaries:
    """Tables of the user's; any may be missing.

    pairs (heard, correct, kind), names (form), protected (word), lexicon (schemas.LEXICON).
    """

    lexicon: DataFrame
    pairs: DataFrame | None = None
    names: DataFrame | None = None
    protected: DataFrame | None = None


def golden_guard(pairs: DataFrame, golden: DataFrame) -> DataFrame:
    """Dictionary pairs (heard, correct, ...) without those that are verified errors, in either direction."""
    g = golden.select(F.col("wrong").alias("_w"), F.col("correct").alias("_c"))
    both = g.unionByName(g.select(F.col("_c").alias("_w"), F.col("_w").alias("_c"))).distinct()
    return pairs.join(both, (F.col("heard") == F.col("_w")) & (F.col("correct") == F.col("_c")), "left_anti")


def _flag(df: DataFrame, word: str, table: DataFrame | None, key: str, name: str) -> DataFrame:
    if table is None:
        return df.withColumn(name, F.lit(False))
    found = table.select(X.norm_word(key).alias("_k")).distinct().withColumn("_f", F.lit(True))
    return df.join(found, F.col(word) == F.col("_k"), "left").withColumn(name, F.coalesce("_f", F.lit(False))).drop("_k", "_f")


def _near_flag(df: DataFrame, words: tuple[str, ...], table: DataFrame | None, key: str, names: tuple[str, ...]) -> DataFrame:
    """``df`` with flags: which of its columns ``words`` are at most one edit away from a word of ``table``."""
    if table is None:
        return df.withColumns({n: F.lit(False) for n in names})
    each = df.select(F.explode(F.array(*words)).alias("word")).where("word IS NOT NULL").distinct()
    known = table.select(X.norm_word(key).alias("word")).distinct()
    found = near_pairs(each, known).select(F.col("a").alias("_k")).unionByName(each.join(known, "word", "left_semi").select(F.col("word").alias("_k"))).distinct()
    for word, name in zip(words, names, strict=True):
        df = df.join(found.withColumn("_f", F.lit(True)), F.col(word) == F.col("_k"), "left").withColumn(name, F.coalesce("_f", F.lit(False))).drop("_k", "_f")
    return df


def enrich(errors: DataFrame, own: Dictionaries) -> DataFrame:
    """Error rows with what the rules read: normal forms, analyses, dictionary kinds, names and neighbours.

    Neighbours are the chapter's errors before and after by time, and the words
    around the error where the rows bring them (``before``, ``after``,
    ``after_stop``: whether a sentence ended just before).
    """
    rows = errors.withColumns({"wrong": F.coalesce("wrong", F.lit("")), "correct": F.coalesce("correct", F.lit(""))})
    rows = rows.withColumns({"w": X.norm_word("wrong"), "c": X.norm_word("correct")})
    for name, default in (("before", ""), ("after", "")):
        rows = rows.withColumn(name, X.norm_word(F.coalesce(name, F.lit(default))) if name in errors.columns else F.lit(default))
    if "after_stop" not in errors.columns:
        rows = rows.withColumn("after_stop", F.lit(False))
    known = M.distinct_analysis(rows, ["w", "c", "after"], own.lexicon)  # a word is looked up once, however often it occurs
    for word, name in (("w", "wm"), ("c", "cm"), ("after", "am")):
        found = known.select(F.col("word").alias("_k"), F.col("a").alias(name))
        rows = rows.join(found, F.col(word) == F.col("_k"), "left").drop("_k")
    if own.pairs is not None:
        kinds = own.pairs.groupBy(X.norm_word("heard").alias("_h"), X.norm_word("correct").alias("_e")).agg(F.collect_set("kind").alias("_k"))
        rows = rows.join(kinds, (F.col("w") == F.col("_h")) & (F.col("c") == F.col("_e")), "left").withColumn("kinds", F.coalesce("_k", F.array().cast("array<string>"))).drop("_h", "_e", "_k")
    else:
        rows = rows.withColumn("kinds", F.array().cast("array<string>"))
    rows = _flag(rows, "w", own.names, "form", "w_name")
    rows = _flag(rows, "c", own.names, "form", "c_name")
    rows = _flag(rows, "c", own.protected, "word", "guarded")
    order = Window.partitionBy("chapter_id").orderBy("t", "err_id")
    for name, column, step in (("prev_w", "w", -1), ("next_w", "w", 1), ("prev_c", "c", -1), ("next_c", "c", 1), ("prev_type", "type", -1), ("next_type", "type", 1)):
        rows = rows.withColumn(name, (F.lag if step < 0 else F.lead)(column).over(order))
    inserted = lambda x: F.when((F.col("type") == "insertion") & (F.length(x) >= 6), x)
    rows = rows.withColumns({"_joined1": inserted(F.concat("w", F.col("after"))), "_joined2": inserted(F.concat(F.col("before"), F.col("w")))})
    rows = _near_flag(rows, ("_joined1", "_joined2"), own.names, "form", ("joins_after", "joins_before")).drop("_joined1", "_joined2")
    verbs = F.size(F.filter(F.split(F.coalesce("context", F.lit("")), r"\s+"), lambda x: F.lower(x).rlike(r"(л|ла|ло|ли|лся|лась|лись|ет|ут|ют|ит|ат|ят|ешь|ишь|ем|им|ете|ите)$") & (F.length(x) > 3)))
    return rows.withColumn("n_verbs", verbs)


class _Columns:
    """Columns of the enriched rows by name; made on use, as columns need a session."""

    def __getattr__(self, name: str) -> Column:
        return F.col(name)


col = _Columns()


def _is(kind: str) -> Column:
    return F.col("type") == kind


def _swap() -> Column:
    return _is("substitution")


def _kind(name: str) -> Column:
    return F.array_contains("kinds", name)


def _either(values: tuple[str, ...]) -> Column:
    return (_swap() & col.w.isin(*values) & col.c.isin(*values)) | (_is("insertion") & col.w.isin(*values)) | (_is("deletion") & col.c.isin(*values))


def _listed(pairs: tuple[tuple[str, str], ...]) -> Column:
    both = X.pair_key(col.w, col.c)
    out = F.lit(False)
    for a, b in pairs:
        out = out | (both == F.array(*[F.lit(x) for x in sorted((a, b))]))
    return out


# --- protections come before every filter -------------------------------------------------


@rule(0.1, "verb_grnd_protected", protects=True)
def _(k: Config) -> Column:
    return _swap() & ((col.wm["pos"] == "VERB") & (col.cm["pos"] == "GRND") | (col.wm["pos"] == "GRND") & (col.cm["pos"] == "VERB"))


@rule(0.2, "different_num_protected", protects=True)
def _(k: Config) -> Column:
    return _swap() & M.same(col.wm, col.cm, "lemma") & M.differs(col.wm, col.cm, "number")


@rule(0.3, "smart_protected", protects=True)
def _(k: Config) -> Column:
    """Another case or tense of one lemma is a real error, and so is a verb with or without "по"."""
    po = (col.w == F.concat(F.lit("по"), col.c)) | (col.c == F.concat(F.lit("по"), col.w))
    case = F.lit(k.protect_case) & M.differs(col.wm, col.cm, "case")
    return _swap() & (M.same(col.wm, col.cm, "lemma") & (case | M.differs(col.wm, col.cm, "tense")) | po)


@rule(0.4, "conjunction_protected", protects=True)
def _(k: Config) -> Column:
    return _swap() & _listed((("а", "и"), ("но", "и"), ("или", "и")))


# --- learned rules ------------------------------------------------------------------------


@rule(1.0, "learned_identical", confidence=0.99)
def _(k: Config) -> Column:
    return _swap() & (col.w == col.c)


@rule(1.1, "learned_name", confidence=0.95)
def _(k: Config) -> Column:
    return _swap() & F.col("w_name") & F.col("c_name")


@rule(1.2, "learned_phonetic", confidence=0.95)
def _(k: Config) -> Column:
    return _swap() & (X.phonetic_key(col.w) == X.phonetic_key(col.c)) & M.same(col.wm, col.cm, "pos")


@rule(1.3, "learned_lemma", confidence=0.9)
def _(k: Config) -> Column:
    """Forms that grammar does not tell apart; where it does, the smart rules decide."""
    return _swap() & M.same_grammar(col.wm, col.cm)


@rule(1.4, "learned_similar_lemma", confidence=0.85)
def _(k: Config) -> Column:
    """Lemmas a letter apart, unless both are known words of their own."""
    near = X.within(col.wm["lemma"], col.cm["lemma"], 1) & ~M.same(col.wm, col.cm, "lemma")
    return _swap() & near & ~(col.wm["lemma"].isNotNull() & col.cm["lemma"].isNotNull() & M.same(col.wm, col.cm, "pos"))


# --- smart rules --------------------------------------------------------------------------


@rule(2.0, "smart_aspect_pair", confidence=0.9)
def _(k: Config) -> Column:
    return _swap() & M.aspect_pair(col.wm, col.cm)


@rule(2.1, "smart_safe_case", confidence=0.9)
def _(k: Config) -> Column:
    """One case and number of a lemma in another gender, say."""
    return _swap() & _one_lemma() & M.same(col.wm, col.cm, "case") & M.same(col.wm, col.cm, "number")


@rule(2.2, "reflexive", confidence=0.9)
def _(k: Config) -> Column:
    more = lambda a, b: a.isin(F.concat(b, F.lit("ся")), F.concat(b, F.lit("сь")))
    return _swap() & (more(col.w, col.c) | more(col.c, col.w))


@rule(2.3, "smart_participle", confidence=0.9)
def _(k: Config) -> Column:
    one = lambda a, b: (a["pos"] == "VERB") & b["pos"].isin("PRTF", "PRTS")
    return _swap() & (one(col.wm, col.cm) | one(col.cm, col.wm)) & M.same_verb_base(col.wm, col.cm)


@rule(2.4, "numeral", confidence=0.9)
def _(k: Config) -> Column:
    return _swap() & _listed(NUMERALS)


@rule(2.5, "smart_prefix", confidence=0.85)
def _(k: Config) -> Column:
    return _swap() & prefix_variant(col.w, col.c)


@rule(2.6, "smart_phonetic", confidence=0.95)
def _(k: Config) -> Column:
    return _swap() & (X.similarity(X.phonetic_key(col.w), X.phonetic_key(col.c)) >= k.phonetic) & M.same(col.wm, col.cm, "lemma")


@rule(2.7, "smart_lemma", confidence=0.9)
def _(k: Config) -> Column:
    """Other forms of a lemma, but not another case, number or tense."""
    return F.lit(k.use_lemmas) & _swap() & _one_lemma() & ~M.differs(col.wm, col.cm, "case") & ~M.differs(col.wm, col.cm, "number") & ~M.differs(col.wm, col.cm, "tense")


@rule(2.8, "smart_homophone", confidence=0.95)
def _(k: Config) -> Column:
    """Words that sound alike; of single letters the neighbours decide."""
    return F.lit(k.use_homophones) & _swap() & (X.phonetic_key(col.w) == X.phonetic_key(col.c)) & (F.least(F.length(col.w), F.length(col.c)) > 1)


@rule(2.9, "smart_levenshtein", confidence=0.85)
def _(k: Config) -> Column:
    """Close lemmas, one of them of no known word (which is then its own lemma); two known words are told apart by readers too."""
    a, b = F.coalesce(col.wm["lemma"], col.w), F.coalesce(col.cm["lemma"], col.c)
    one_known = col.wm["lemma"].isNull() != col.cm["lemma"].isNull()
    long_ = F.least(F.length(a), F.length(b)) >= k.lemma_length
    return _swap() & ~col.w.isin(*PRONOUNS) & ~col.c.isin(*PRONOUNS) & one_known & long_ & (a != b) & X.within(a, b, k.edit_distance)


@rule(2.95, "smart_grammar", confidence=0.85)
def _(k: Config) -> Column:
    return _swap() & ending_pair(col.w, col.c)


# --- the exact dictionary beats the levels below ------------------------------------------


@rule(3.0, "yandex_typical", confidence=1.0)
def _(k: Config) -> Column:
    return _swap() & _kind("typical")


@rule(3.1, "safe_transposition", confidence=0.9)
def _(k: Config) -> Column:
    return _is("transposition") & _kind("transposition")


# --- legacy levels ------------------------------------------------------------------------


@rule(4.01, "interjection")
def _(k: Config) -> Column:
    return _either(INTERJECTIONS) & ~F.col("w").isin("а") & ~F.col("c").isin("а")


@rule(4.02, "context_artifact")
def _(k: Config) -> Column:
    """One more or one fewer "и" in an enumeration that has another beside it."""
    return ((_is("insertion") & (col.w == "и")) | (_is("deletion") & (col.c == "и"))) & F.coalesce("context", F.lit("")).rlike(r"(?:^|\s)и\s+\p{L}+,?\s+и\s")


@rule(4.025, "levenshtein_protected")
def _(k: Config) -> Column:
    """A long protected word heard one letter off; all else that is protected stays."""
    long_ = (F.length(col.w) >= k.protected_length) & (F.length(col.c) >= k.protected_length)
    changed = M.differs(col.wm, col.cm, "number") | M.differs(col.wm, col.cm, "case") | M.differs(col.wm, col.cm, "lemma")
    return _swap() & F.col("guarded") & X.within(col.w, col.c, k.protected_distance) & long_ & ~changed


@rule(4.03, "protected_word", protects=True)
def _(k: Config) -> Column:
    return F.col("guarded")


@rule(4.04, "alignment_artifact")
def _(k: Config) -> Column:
    return alignment_artifact()


@rule(4.05, "weak_words_same_lemma")
def _(k: Config) -> Column:
    return _swap() & col.w.isin(*WEAK_WORDS) & col.c.isin(*WEAK_WORDS) & ((col.w == col.c) | M.same(col.wm, col.cm, "lemma"))


@rule(4.07, "compound_word")
def _(k: Config) -> Column:
    return _swap() & (fused("wrong") == fused("correct"))


@rule(4.08, "split_compound")
def _(k: Config) -> Column:
    """The heard word and the next one together are the expected word."""
    return _swap() & ((F.concat(col.w, F.coalesce("next_w", col.after)) == F.regexp_replace(col.c, "-", "")) | (F.concat(F.coalesce("prev_w", col.before), col.w) == F.regexp_replace(col.c, "-", "")))


@rule(4.11, "case_form")
def _(k: Config) -> Column:
    """Decides where ``protect_case`` is off; another case is a real error otherwise."""
    return _swap() & M.same(col.wm, col.cm, "lemma") & (col.wm["pos"] == "NOUN") & M.differs(col.wm, col.cm, "case")


@rule(4.12, "adverb_adjective")
def _(k: Config) -> Column:
    return _swap() & _parts("ADVB", "ADJF") & (X.common_prefix(col.w, col.c) >= 4)


@rule(4.13, "short_full_adjective")
def _(k: Config) -> Column:
    return _swap() & _parts("ADJS", "ADJF") & M.same(col.wm, col.cm, "lemma")


@rule(4.18, "yandex_name_error")
def _(k: Config) -> Column:
    return _swap() & name_error(col.w, col.c, F.col("w_name"), F.col("c_name"), k.name_share)


@rule(4.185, "character_name_unrecognized")
def _(k: Config) -> Column:
    return _swap() & F.col("c_name") & col.wm["lemma"].isNull() & ~F.col("w_name") & _kind("name")


@rule(4.20, "split_word_insertion")
def _(k: Config) -> Column:
    """An inserted piece that, with its neighbour, is a word expected beside it."""
    return _is("insertion") & (F.length(col.w) > 1) & (F.concat(col.w, F.coalesce("next_w", F.lit(""))).eqNullSafe(F.col("next_c")) | F.concat(F.coalesce("prev_w", F.lit("")), col.w).eqNullSafe(F.col("prev_c")))


# --- rules that look at neighbours --------------------------------------------------------


@rule(5.02, "split_name_insertion")
def _(k: Config) -> Column:
    return _is("insertion") & (F.length(col.w) + F.greatest(F.length(col.after), F.length(col.before)) >= 6) & (F.col("joins_after") | F.col("joins_before")) & ~col.w.isin(*CONJUNCTIONS, *SHORT_DELETIONS)


@rule(5.03, "split_name")
def _(k: Config) -> Column:
    return _kind("split_name")


@rule(5.04, "compound_prefix")
def _(k: Config) -> Column:
    return _is("insertion") & col.w.isin(*COMPOUND_PREFIXES) & F.coalesce(F.col("next_c").startswith(col.w), F.lit(False))


@rule(5.05, "compound_particle_to")
def _(k: Config) -> Column:
    return (_is("insertion") & (col.w == "то") | _is("deletion") & (col.c == "то")) & col.before.isin("кто", "что", "как", "где", "когда", "куда", "какой") & (F.coalesce(col.am["pos"], F.lit("")) != "VERB")


@rule(5.06, "duplicate_word_insertion")
def _(k: Config) -> Column:
    return _is("insertion") & (col.w != "") & ((col.w == col.before) | (col.w == col.after))


@rule(5.07, "yandex_i_ya_boundary")
def _(k: Config) -> Column:
    return _i_ya() & F.col("after_stop")


@rule(5.08, "yandex_i_ya_after_verb")
def _(k: Config) -> Column:
    return _i_ya() & (col.before.rlike(r"\p{L}(л|ла|лся|лась|ли)$") | col.after.rlike(r"\p{L}(ю|у|юсь|усь)$"))


@rule(5.09, "yandex_i_ya_verb_context")
def _(k: Config) -> Column:
    return _i_ya() & (F.col("n_verbs") >= k.verbs_around)


@rule(5.10, "yandex_particle_deletion")
def _(k: Config) -> Column:
    return _is("deletion") & col.c.isin(*PARTICLES) & col.before.isin(*PRONOUNS, *ADVERBS)


@rule(5.11, "yandex_conjunction_before_gerund")
def _(k: Config) -> Column:
    return _is("insertion") & col.w.isin("и", "а") & (col.am["pos"] == "GRND")


@rule(5.12, "yandex_merge_artifact")
def _(k: Config) -> Column:
    """A one-letter word merged with the word after or before it."""
    return _swap() & (F.concat(col.c, col.after).eqNullSafe(col.w) | F.concat(col.before, col.c).eqNullSafe(col.w)) & (F.length(col.c) == 1)


@rule(5.13, "yandex_truncate_artifact")
def _(k: Config) -> Column:
    """One of а, и, я lost from a word's end."""
    return _swap() & (F.length(col.c) >= 4) & (F.concat(col.w, F.right(col.c, F.lit(1))) == col.c) & F.right(col.c, F.lit(1)).isin("а", "и", "я") & (col.before.isin("и", "а", "я") | col.after.isin("и", "а", "я"))


@rule(5.14, "yandex_expand_artifact")
def _(k: Config) -> Column:
    return _swap() & (F.length(col.w) >= 4) & (F.concat(col.c, F.right(col.w, F.lit(1))) == col.w) & F.right(col.w, F.lit(1)).isin("а", "и", "я") & (col.before.isin("и", "а", "я") | col.after.isin("и", "а", "я"))


@rule(5.15, "sentence_start_conjunction")
def _(k: Config) -> Column:
    return _is("insertion") & col.w.isin("и", "а") & F.col("after_stop")


# --- predicates that are operators of their own -------------------------------------------


def _one_lemma() -> Column:
    return M.same(col.wm, col.cm, "lemma") & M.same(col.wm, col.cm, "pos")


def _i_ya() -> Column:
    return _swap() & _listed((("и", "я"),))


def _parts(a: str, b: str) -> Column:
    return (col.wm["pos"] == a) & (col.cm["pos"] == b) | (col.wm["pos"] == b) & (col.cm["pos"] == a)


def alignment_artifact(type_: Column | None = None, correct: Column | None = None, starts: Column | None = None, words: tuple[str, ...] = SHORT_DELETIONS) -> Column:
    """A listed short word that is missing, other than at the start of a sentence."""
    type_, correct = F.col("type") if type_ is None else type_, col.c if correct is None else correct
    return (type_ == "deletion") & correct.isin(*words) & ~(F.col("after_stop") if starts is None else starts)


def fused(word: Column | str) -> Column:
    return F.regexp_replace(X.norm_word(word), "-", "")


def prefix_variant(a: Column, b: Column, prefixes: tuple[str, ...] = M.PREFIXES) -> Column:
    """One word is the other behind one of the prefixes."""
    more = lambda x, y: F.lit(False) if not prefixes else x.isin(*[F.concat(F.lit(p), y) for p in prefixes])
    return (a != "") & (b != "") & (more(a, b) | more(b, a))


def ending_pair(a: Column, b: Column, endings: tuple[tuple[str, str], ...] = ENDINGS) -> Column:
    """Words alike but for endings listed as a pair, in either order, after two letters in common at least."""
    out = F.lit(False)
    for x, y in endings:
        for p, q in ((x, y), (y, x)):
            cut = lambda s, e: F.expr("true") & s.endswith(e)
            same = F.regexp_replace(a, f"{p}$", "") == F.regexp_replace(b, f"{q}$", "")
            out = out | (cut(a, p) & cut(b, q) & same & (F.length(a) >= len(p) + 2))
    return out & (a != b)


def name_error(a: Column, b: Column, a_name: Column, b_name: Column, share: float = 0.5) -> Column:
    """Both are names, or one is and the words are within max(3, share of the longer) edits."""
    most = F.greatest(F.lit(3), F.floor(F.greatest(F.length(a), F.length(b)) * share))
    return (a_name & b_name) | ((a_name | b_name) & (F.levenshtein(a, b) <= most))


def chains(errors: DataFrame, seconds: float = 3.0, distance: int = 3) -> DataFrame:
    """``errors`` with ``in_chain``: runs in which each heard word is what the next row expected.

    Rows follow within ``seconds``; words of two letters or fewer start no
    link; the run's first row must be no near miss (more than ``distance``
    edits, or more than half its longer word).
    """
    order = Window.partitionBy("chapter_id").orderBy("t", "err_id")
    follows = (F.lag("wrong").over(order) == F.col("correct")) & (F.col("t") - F.lag("t").over(order) <= seconds) & (F.length("correct") > 2)
    rows = errors.withColumn("_new", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1))
    rows = rows.withColumn("_run", F.sum("_new").over(order))
    run = Window.partitionBy("chapter_id", "_run")
    far = F.levenshtein("wrong", "correct")
    odd = (far > distance) | (far > F.greatest(F.length("wrong"), F.length("correct")) * 0.5)
    first = F.first(odd).over(run.orderBy("t", "err_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("in_chain", (F.count("*").over(run) > 1) & first).drop("_new", "_run")


def islands(rows: DataFrame, by: str, at: str, gap: Column) -> DataFrame:
    """``rows`` with ``island``: a number that grows where ``gap`` (a predicate over lag) holds."""
    order = Window.partitionBy(by).orderBy(at)
    return rows.withColumn("island", F.sum(F.when(F.coalesce(gap, F.lit(True)), 1).otherwise(0)).over(order))
