import io
import json
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from collatura.functions import morphology as M
from collatura.operators import evaluation, features, pairs, tracker
from collatura.operators.filters import Dictionaries
from collatura.plans import chapters, classifier
from collatura.schemas import OCCURRENCE
from collatura.sources import readers, sinks
from collatura.streaming import incremental
from tests import fixtures


def test_lookup_takes_the_first_choice_and_guesses_gerunds(spark):
    words = spark.createDataFrame([("дома",), ("увидевши",), ("нет",), (None,)], "w string")
    got = {r["w"]: r["m"] for r in M.analyse(words, "w", fixtures.lexicon(spark), "m").collect()}
    assert got["дома"]["pos"] == "NOUN" and got["дома"]["case"] == "gent"
    assert got["увидевши"]["pos"] == "GRND" and got["нет"]["pos"] is None and got[None]["lemma"] is None


def test_grammar_predicates(spark):
    df = spark.createDataFrame([("делал", "сделал"), ("делал", "делали"), ("проводит", "проходит"), ("x", "y")], "a string, b string")
    lex = fixtures.lexicon(spark)
    df = M.analyse(M.analyse(df, "a", lex, "x"), "b", lex, "y")
    x, y = F.col("x"), F.col("y")
    got = [tuple(r) for r in df.orderBy("a", "b").select("a", "b", M.aspect_pair(x, y), M.same(x, y, "lemma"), M.differs(x, y, "number"), M.lemma_match(x, y)).collect()]
    assert got == [("делал", "делали", False, True, True, True), ("делал", "сделал", True, False, False, False), ("проводит", "проходит", False, False, False, False), ("x", "y", False, False, False, False)] or sorted(got, key=str)


def test_names(spark):
    base = spark.createDataFrame([("иван",), ("пётр",)], "word string")
    assert {r["form"] for r in readers.expanded_names(base, fixtures.lexicon(spark)).collect()} == {"иван", "ивана", "ивану", "пётр"}
    tokens = [(1, 0, "Вчера", True), (1, 1, "Иван", False), (1, 2, "Петров", False), (1, 3, "ушёл", False), (1, 4, "Иван", False)]
    df = spark.createDataFrame(tokens, "doc int, pos int, word string, starts_sentence boolean")
    got = {(r["name"], r["n"]) for r in M.proper_names(df).collect()}
    assert got == {("Иван", 2), ("Петров", 1), ("Иван Петров", 1)}
    known = spark.createDataFrame([("Петров",)], "name string")
    assert {r["name"] for r in M.proper_names(df, known, fixtures.lexicon(spark)).collect()} == {"Иван", "Иван Петров"}


def test_hit_rate(spark):
    row = M.hit_rate(spark.createDataFrame([("a",), ("a",), ("b",), (None,), ("a",)], "w string"), "w").first()
    assert tuple(row) == (4, 2, 0.5)
    assert tuple(M.hit_rate(spark.createDataFrame([], "w string"), "w").first()) == (0, 0, None)


def test_near_pairs_equal_brute_force(spark):
    import random

    rng = random.Random(1)
    words = sorted({"".join(rng.choices("abc", k=rng.randrange(1, 6))) for _ in range(120)})
    df = spark.createDataFrame([(w,) for w in words], "word string")

    def one(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    want = {(a, b) for a in words for b in words if a < b and one(a, b)}
    assert {tuple(r) for r in pairs.near_pairs(df).collect()} == want


def test_tracker(spark):
    seen = [("щас", "сейчас", "substitution", "01", datetime(2025, 1, 1)), ("щас", "сейчас", "substitution", "02", datetime(2025, 1, 3)), ("чо", "что", "substitution", "02", datetime(2025, 1, 2))]
    rows = spark.createDataFrame(seen, OCCURRENCE)
    patterns = tracker.accumulate(rows)
    best = tracker.top(patterns, 1).first()
    assert (best["wrong"], best["count"], best["sources"], best["first_seen"], best["last_seen"]) == ("щас", 2, ["01", "02"], datetime(2025, 1, 1), datetime(2025, 1, 3))
    resolved = spark.createDataFrame([("чо", "что", "substitution")], "wrong string, correct string, type string")
    assert tracker.regressions(rows, resolved).count() == 1 and tracker.without_golden(rows, resolved).count() == 2
    assert {r["wrong"]: r["is_golden"] for r in tracker.mark_golden(patterns, resolved).collect()} == {"щас": False, "чо": True}
    assert tracker.search(patterns, "ЩА", ["wrong"]).count() == 1
    events = rows.withColumn("state", F.col("source"))
    assert tracker.latest(events, ["wrong"], "seen_at", ["source"]).where("wrong = 'щас'").first()["state"] == "02"
    marked = tracker.update_analysis(spark.createDataFrame([("делала", "делал", "substitution", 1)], "wrong string, correct string, type string, count int"), fixtures.lexicon(spark)).first()
    assert (marked["lemma"], marked["pos"], marked["aspect"]) == ("делать", "VERB", "impf")
    assert "| щас | сейчас |" in sinks.markdown(patterns)


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [("", "x", "alignment_artifact"), ("кто то", "кто-то", "compound_word"), ("побежал", "бежал", "prefix_variant"), ("я", "и", "short_word"), ("дома", "домов", "grammar_ending"), ("кот", "кит", "phonetic"), ("лес", "дорога", "unknown")],
)
def test_pattern_classes(spark, a, b, want):
    row = spark.range(1).select(tracker.classify(F.lit(a), F.lit(b)).alias("k")).select("k", tracker.suggestion(F.col("k")).alias("s")).first()
    assert row["k"] == want and row["s"]


def test_evaluation(spark):
    g = fixtures.golden(spark)
    kept = g.select("chapter_id", "type", F.upper("wrong").alias("wrong"), "correct", (F.col("time_seconds") + 1.0).alias("t")).where("time_seconds <> 8")
    total = {r["chapter_id"]: r for r in evaluation.recall(evaluation.golden_matches(g, kept)).collect()}["total"]
    assert (total["n_golden"], total["n_found"]) == (9, 8)
    late = kept.withColumn("t", F.col("t") + 60)
    assert {r["found"] for r in evaluation.golden_matches(g, late).collect()} == {False}
    old = spark.createDataFrame([("01", 5), ("02", 3)], "ch string, n int")
    new = spark.createDataFrame([("01", 4), ("03", 1)], "ch string, n int")
    assert {r["ch"]: r["n_delta"] for r in evaluation.delta(old, new, "ch", ["n"]).collect()} == {"01": -1, "02": -3, "03": 1}


def test_classifiers(spark, tmp_path):
    good = [("делал", "сделал"), ("молоко", "малако"), ("дом", "дома"), ("красивого", "красивово"), ("бежал", "побежал")]
    bad = [("кот", "дорога"), ("лес", "чайник"), ("окно", "поле"), ("рука", "стул"), ("мир", "вечность")]
    rows = spark.createDataFrame([(*p, 1) for p in good * 6] + [(*p, 0) for p in bad * 6], "a string, b string, label int")
    table = features.pair_features(rows, fixtures.lexicon(spark)).cache()
    assert set(features.ALL_FEATURES) <= set(table.columns) and len(features.ALL_FEATURES) == 21
    for kind in classifier.KINDS:
        model = classifier.FalsePositiveClassifier(kind).fit(table)
        assert classifier.accuracy(model.predict(table)) > 0.95
    model.save(str(tmp_path / "m"))
    again = classifier.FalsePositiveClassifier.load(str(tmp_path / "m"), kind)
    assert again.predict(table).select("predicted").collect() == model.predict(table).select("predicted").collect()
    train, test = classifier.split(table, "a", "b")
    assert train.join(test, ["a", "b"], "left_semi").count() == 0 and train.count() + test.count() == 60
    assert {r["label"]: r["n"] for r in classifier.class_distribution(table).collect()} == {0: 30, 1: 30}


def transcript(words, t=0.0):
    return {"chunks": [{"alternatives": [{"text": " ".join(words), "words": [{"word": w, "startTime": f"{t + k / 2}s", "endTime": f"{t + k / 2 + 0.4}s"} for k, w in enumerate(words)]}]}]}


def test_readers(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    two = transcript(["Студия", "читает"])
    two["chunks"] += [{"alternatives": []}, transcript(["Шёл", "дождь"], 10)["chunks"][0]]
    (folder / "01_transcript.json").write_text(json.dumps(two, ensure_ascii=False), encoding="utf-8")
    (folder / "02_transcript.json").write_text('{"chunks": []}')
    (folder / "03_transcript.json").write_text("{ no json")
    (folder / "04_transcript.json").write_text('{"chunks": [{"alternatives": [{"text": "x"}]}]}')
    path = str(folder / "*_transcript.json")
    got = [(r["chapter_id"], r["pos"], r["norm"], r["t_start"]) for r in readers.transcripts(spark, path).orderBy("chapter_id", "pos").collect()]
    assert got == [("01", 0, "студия", 0.0), ("01", 1, "читает", 0.5), ("01", 2, "шел", 10.0), ("01", 3, "дождь", 10.5)]
    broken = {r["chapter_id"]: r["problem"] for r in readers.broken_transcripts(spark, path).collect()}
    assert broken == {"02": "no chunks", "03": "no transcript", "04": "no words"}
    (folder / "05_normalized.txt").write_text("— Да, кто-то\nшёл — тихо.", encoding="utf-8")
    got = [(r["pos"], r["norm"], r["original_text"]) for r in readers.originals(spark, str(folder / "05_normalized.txt")).orderBy("pos").collect()]
    assert got == [(0, "да", "Да,"), (1, "кто", "кто-то"), (2, "то", "кто-то"), (3, "шел", "шёл"), (4, "тихо", "тихо.")]
    files = readers.chapter_files(spark, str(folder))
    assert {(r["chapter_id"], r["stage"]) for r in files.collect()} == {("01", "transcript"), ("02", "transcript"), ("03", "transcript"), ("04", "transcript"), ("05", "normalized")}
    assert {r["problem"] for r in readers.valid_inputs(files, ("txt",)).collect()} == {"extension", None}
    (folder / "names.txt").write_text("Иван\n# note\n\nПётр # son\n", encoding="utf-8")
    assert {r["word"] for r in readers.word_list(spark, str(folder / "names.txt")).collect()} == {"Иван", "Пётр"}


def test_docx(spark, tmp_path):
    body = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Шёл </w:t></w:r><w:r><w:t>дождь</w:t></w:r></w:p><w:p><w:r><w:t>Тихо</w:t></w:r></w:p></w:body></w:document>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "Глава7.docx").write_bytes(data.getvalue())
    (tmp_path / "Глава8.docx").write_bytes(b"none")
    got = {r["chapter_id"]: r["text"] for r in readers.docx(spark, str(tmp_path)).collect()}
    assert got == {"07": "Шёл дождь\nТихо", "08": None}


def test_providers_limits_and_retries(spark):
    assert readers.list_providers() == ["files", "mock"]
    rows = readers.get_provider("mock", chapters={"01": "Шёл дождь"}).words(spark).orderBy("pos").collect()
    assert [(r["norm"], r["t_start"]) for r in rows] == [("шел", 0.0), ("дождь", 0.5)]
    with pytest.raises(KeyError):
        readers.get_provider("none")
    now = [0.0]
    limiter = readers.RateLimiter(1.0, 3, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    assert [limiter.acquire() for _ in range(5)] == [0, 0, 0, 1, 1]
    calls, waits = [], []

    def call():
        calls.append(1)
        raise readers.ServiceError(503 if len(calls) < 3 else 400)

    with pytest.raises(readers.ServiceError):
        readers.retry(call, sleep=waits.append, jitter=lambda: 1.0)
    assert len(calls) == 3 and waits == [1.0, 2.0]


def test_whole_job(spark, tmp_path):
    heard = readers.get_provider("mock", chapters={"01": "студия читает щас он шёл домой и пел песню долго", "02": "он ушёл чайник вечером домой один"}).words(spark)
    texts = spark.createDataFrame([("01", "Сейчас он шёл домой и пел песню долго."), ("02", "Он ушёл собака вечером домой один")], "chapter_id string, text string")
    own = Dictionaries(fixtures.lexicon(spark), pairs=spark.createDataFrame(fixtures.PAIRS, "heard string, correct string, kind string"))
    out = chapters.run(heard, readers.original_words(texts), own).cache()
    kept = {(r["chapter_id"], r["wrong"], r["correct"]) for r in out.where("filter_reason IS NULL").collect()}
    assert ("02", "чайник", "собака") in kept and not any(c == "01" for c, _, _ in kept)
    fixed = chapters.run(heard, readers.original_words(texts), own, phantom=0.0)
    assert fixed.where("chapter_id = '01' AND filter_reason = 'yandex_typical'").count() + fixed.where("chapter_id = '01' AND type = 'insertion'").count() > 0
    path = str(tmp_path / "compared")
    sinks.compared(out, path)
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.compared(out, path)
    sinks.compared(out, path, force=True)
    sinks.filtered(out, str(tmp_path / "filtered"))
    assert spark.read.json(str(tmp_path / "filtered")).count() == len(kept)
    assert [r["line"] for r in sinks.book_report(out).collect()][0].startswith("# ")
    assert {r["chapter_id"] for r in sinks.batch_report(out).collect()} == {r["chapter_id"] for r in out.select("chapter_id").distinct().collect()}
    sinks.export(tracker.accumulate(out.withColumns({"source": F.col("chapter_id"), "seen_at": F.current_timestamp()})), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() > 0
    pairs_ = chapters.paired(heard, readers.original_words(texts))
    assert chapters.mismatched(pairs_, 0.9).count() == 2 and chapters.mismatched(pairs_, 0.05).count() == 0


def test_stores_and_streams(spark, tmp_path):
    seen = spark.createDataFrame([("щас", "сейчас", "substitution", "01", datetime(2025, 1, 1))], OCCURRENCE)
    store, folder = str(tmp_path / "store"), str(tmp_path / "new")
    sinks.append_occurrences(seen, folder)
    assert incremental.track_occurrences(spark, folder, str(tmp_path / "mark"), store) == 1
    assert incremental.track_occurrences(spark, folder, str(tmp_path / "mark"), store) == 0
    sinks.append_occurrences(seen, folder)
    assert incremental.track_occurrences(spark, folder, str(tmp_path / "mark"), store) == 1
    assert tracker.accumulate(spark.read.parquet(store)).first()["count"] == 2
    verdicts = spark.createDataFrame([("01", 1, "false_positive"), ("01", 2, "odd")], "chapter_id string, err_id long, verdict string")
    sinks.append_verdicts(verdicts, str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).count() == 1
    files = spark.createDataFrame([("01", datetime(2025, 1, 2)), ("02", datetime(2025, 1, 2)), ("03", datetime(2025, 1, 2))], "chapter_id string, modified timestamp")
    made = spark.createDataFrame([("01", datetime(2025, 1, 3)), ("02", datetime(2025, 1, 1))], "chapter_id string, modified timestamp")
    assert {r["chapter_id"] for r in chapters.stale(files, made).collect()} == {"02", "03"}
