"""Transcripts, book texts, dictionaries and settings as DataFrames."""

from __future__ import annotations

import io
import re
import time
import zipfile
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from random import random
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from collatura.functions import text as X
from collatura.schemas import LEXICON, TRANSCRIPT

AUDIO = ("mp3", "wav", "ogg", "m4a", "flac")
TEXTS = ("txt", "docx")


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(chapter_id, pos, word, norm, t_start, t_end): the timed words of transcript files.

    The chapter is the number in the file's name; positions follow chunks and
    words.  Empty chunks and chunks without words give nothing; a file that is
    no transcript gives nothing here and a row in ``broken_transcripts``.
    """
    rows = _transcript_files(spark, path).select("chapter_id", F.posexplode_outer("chunks").alias("chunk_no", "chunk"))
    rows = rows.select("chapter_id", "chunk_no", F.get(F.col("chunk.alternatives"), F.lit(0)).alias("best"))
    rows = rows.select("chapter_id", "chunk_no", F.posexplode(F.col("best.words")).alias("word_no", "w"))
    # Words are numbered within the file's own array, not by a window over the chapter.
    before = _transcript_files(spark, path).select(
        "chapter_id",
        F.transform(F.col("chunks"), lambda x: F.coalesce(F.size(F.get(x["alternatives"], F.lit(0))["words"]), F.lit(0))).alias("sizes"),
    )
    before = before.select("chapter_id", F.posexplode("sizes").alias("chunk_no", "n"), "sizes").select(
        "chapter_id", "chunk_no", F.aggregate(F.slice("sizes", 1, F.col("chunk_no")), F.lit(0), lambda s, x: s + F.greatest(x, F.lit(0))).alias("offset")
    )
    rows = rows.join(before, ["chapter_id", "chunk_no"])
    return rows.select(
        "chapter_id", (F.col("offset") + F.col("word_no")).alias("pos"), F.col("w.word").alias("word"), X.norm_word("w.word").alias("norm"),
        X.stamp("w.startTime").alias("t_start"), X.stamp("w.endTime").alias("t_end"),
    )


def _transcript_files(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(TRANSCRIPT).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.select("*", X.chapter_id(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1)).alias("chapter_id"))


def broken_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(chapter_id, problem) of files that are no JSON, have no chunks, or no words."""
    rows = _transcript_files(spark, path)
    words = F.aggregate("chunks", F.lit(0), lambda s, x: s + F.greatest(F.coalesce(F.size(F.get(x["alternatives"], F.lit(0))["words"]), F.lit(0)), F.lit(0)))
    problem = F.when(F.col("_corrupt").isNotNull() | F.col("chunks").isNull(), "no transcript").when(F.size("chunks") == 0, "no chunks").when(words == 0, "no words")
    return rows.select("chapter_id", problem.alias("problem")).where("problem IS NOT NULL")


def originals(spark: SparkSession, path: str, keep_hyphens: tuple[str, ...] = ()) -> DataFrame:
    """(chapter_id, pos, word, norm, original_text): book words; each keeps the token it came from.

    A hyphenated token gives several words, all with that token, so both
    numberings stay in step.
    """
    files = spark.read.text(path, wholetext=True)
    chapter = X.chapter_id(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1))
    return original_words(files.select(chapter.alias("chapter_id"), F.col("value").alias("text")), keep_hyphens)


def original_words(texts: DataFrame, keep_hyphens: tuple[str, ...] = ()) -> DataFrame:
    """The same of a table (chapter_id, text)."""
    text = X.spaced_dashes(X.dialogue_dashes("text"))
    tokens = F.filter(F.split(text, r"\s+"), lambda t: t.rlike(r"[\p{L}\p{N}]"))
    pieces = lambda t: F.filter(F.split(X.split_hyphens(F.regexp_replace(t, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""), keep_hyphens), " "), lambda s: s != "")
    flat = F.flatten(F.transform(tokens, lambda t: F.transform(pieces(t), lambda s: F.struct(s.alias("word"), t.alias("original_text")))))
    rows = texts.select("chapter_id", F.posexplode(flat).alias("pos", "x"))
    return rows.select("chapter_id", "pos", F.col("x.word").alias("word"), X.norm_word("x.word").alias("norm"), F.col("x.original_text").alias("original_text"))


def docx_text(content: bytes) -> str:
    """The paragraphs of a DOCX file's body, by lines."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(f"{space}t")) for p in root.iter(f"{space}p"))


def docx(spark: SparkSession, path: str) -> DataFrame:
    """(chapter_id, text) of DOCX files; a file that isn't one has a null text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for content in batch["content"]:
                try:
                    texts.append(docx_text(content))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    texts.append(None)
            yield pd.DataFrame({"path": batch["path"], "text": texts})

    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select("path", "content").mapInPandas(run, "path string, text string")
    return rows.select(X.chapter_id(F.regexp_extract("path", r"([^/]+)$", 1)).alias("chapter_id"), "text")


def word_list(spark: SparkSession, path: str, name: str = "word") -> DataFrame:
    """A dictionary file with a word a line; blank lines and comments (#) go."""
    word = F.trim(F.regexp_replace("value", "#.*$", ""))
    return spark.read.text(path).select(word.alias(name)).where(f"{name} <> ''").distinct()


def pair_list(spark: SparkSession, path: str) -> DataFrame:
    """(heard, correct, kind) of JSON lines."""
    return spark.read.schema("heard string, correct string, kind string").json(path)


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """A lexicon kept as Parquet, in the common shape."""
    return spark.read.schema(LEXICON).parquet(path)


def expanded_names(base: DataFrame, lex: DataFrame) -> DataFrame:
    """(form): base names (word) in all forms the lexicon knows."""
    from collatura.functions.morphology import case_forms

    return case_forms(base.select(F.col("word").alias("base")), lex).select("form").distinct()


def chapter_files(spark: SparkSession, path: str, stage: str = "*", extension: str = "*") -> DataFrame:
    """(chapter_id, stage, extension, path, size, modified) of files named {chapter}_{stage}.{extension}."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", f"*_{stage}.{extension}").load(path).select("path", "length", "modificationTime")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    part = lambda k: F.regexp_extract(name, r"^(.*?)_([^_.]+)\.([^.]+)$", k)
    return rows.select(X.chapter_id(part(1)).alias("chapter_id"), part(2).alias("stage"), part(3).alias("extension"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def latest_files(files: DataFrame) -> DataFrame:
    """The newest file of each chapter and stage."""
    return files.groupBy("chapter_id", "stage").agg(F.max_by(F.struct("path", "size", "modified"), F.struct("modified", "path")).alias("f")).select("chapter_id", "stage", "f.*")


def related_files(files: DataFrame, report_chapter: str) -> DataFrame:
    """The newest file of each stage of one chapter."""
    return latest_files(files.where(F.col("chapter_id") == report_chapter))


def valid_inputs(files: DataFrame, extensions: tuple[str, ...] = TEXTS + AUDIO) -> DataFrame:
    """``files`` with ``problem``: empty, or of a kind that isn't read; null if neither."""
    return files.withColumn("problem", F.when(F.col("size") == 0, "empty").when(~F.lower("extension").isin(*extensions), "extension"))


class TranscriptionProvider(ABC):
    """Where transcripts come from; a provider returns (chapter_id, pos, word, norm, t_start, t_end)."""

    @abstractmethod
    def words(self, spark: SparkSession) -> DataFrame: ...


_PROVIDERS: dict[str, Callable[..., TranscriptionProvider]] = {}


def register_provider(name: str, make: Callable[..., TranscriptionProvider]) -> None:
    _PROVIDERS[name] = make


def get_provider(name: str, **settings) -> TranscriptionProvider:
    if name not in _PROVIDERS:
        raise KeyError(f"no provider {name!r}; there are {list_providers()}")
    return _PROVIDERS[name](**settings)


def list_providers() -> list[str]:
    return sorted(_PROVIDERS)


class FileProvider(TranscriptionProvider):
    """Transcripts that lie in files already."""

    def __init__(self, path: str):
        self.path = path

    def words(self, spark: SparkSession) -> DataFrame:
        return transcripts(spark, self.path)


class MockProvider(TranscriptionProvider):
    """Given words, half a second each, for tests."""

    def __init__(self, chapters: dict[str, str], step: float = 0.5):
        self.chapters, self.step = chapters, step

    def words(self, spark: SparkSession) -> DataFrame:
        rows = [(c, k, w, k * self.step, (k + 1) * self.step) for c, text in self.chapters.items() for k, w in enumerate(text.split())]
        df = spark.createDataFrame(rows, "chapter_id string, pos int, word string, t_start double, t_end double")
        return df.select("chapter_id", "pos", "word", X.norm_word("word").alias("norm"), "t_start", "t_end")


register_provider("files", FileProvider)
register_provider("mock", MockProvider)


class RateLimiter:
    """A token bucket on the driver: ``rate`` calls a second, ``burst`` at once."""

    def __init__(self, rate: float = 1.0, burst: int = 3, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.burst, self.clock, self.sleep = rate, burst, clock, sleep
        self.left, self.at = float(burst), clock()

    def acquire(self) -> float:
        """Wait for a call's turn; returns the seconds waited."""
        now = self.clock()
        self.left = min(self.burst, self.left + (now - self.at) * self.rate)
        self.at = now
        wait = max(0.0, (1 - self.left) / self.rate)
        if wait:
            self.sleep(wait)
            self.at = now + wait
            self.left += wait * self.rate
        self.left -= 1
        return wait


class ServiceError(Exception):
    def __init__(self, status: int):
        super().__init__(f"status {status}")
        self.status = status


def retry(call: Callable, tries: int = 3, least: float = 1.0, most: float = 10.0, sleep: Callable[[float], None] = time.sleep, jitter: Callable[[], float] = random):
    """Call again after 429 or a server's error, waiting twice as long each time, with jitter."""
    for k in range(tries):
        try:
            return call()
        except ServiceError as e:
            if k == tries - 1 or not (e.status == 429 or 500 <= e.status < 600):
                raise
            sleep(min(most, least * 2**k) * (0.5 + jitter() / 2))


def chapter_number(name: str) -> str:
    """The same rule as ``functions.text.chapter_id``, for names on the driver."""
    m = re.search(r"\d+", name)
    return m[0].zfill(2) if m else ""
