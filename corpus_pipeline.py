"""A training corpus from documents: five stages, each written and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from collatura.llm import decontaminate, mixing, simhash, tokens, toxicity
from collatura.llm.common import Scratch
from collatura.llm.queries import tokenizer

#: The columns of documents; extra ones stay behind.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.col(f"`{c}`") for c in COLUMNS])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit on the training folds of the labels, over the rows of this stage, and keep what scores below 0.5.

    A null text scores as an empty one; rows without a doc_id teach nothing but
    are scored; repeated rows share a verdict; an empty table gives no rows.
    """
    docs = _documents(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.reject(docs, toxicity.fit(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: that of the smallest doc_id.

    Of rows that share that doc_id one stays, the least by text.  Of rows
    without a doc_id, linked to none that has one, a row of each fingerprint
    stays.
    """
    docs = _documents(docs)
    found = simhash.near_duplicates(docs)
    row = F.min(F.struct(*COLUMNS)).alias("row")
    kept = found.where("component_id = doc_id").select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(row).select("row.*")
    alone = found.where("doc_id IS NULL AND component_id IS NULL").select("fp").distinct()
    if not alone.limit(1).count():
        return named
    nameless = simhash.with_print(docs.where("doc_id IS NULL"))
    return named.unionByName(nameless.join(alone, "fp", "left_semi").groupBy("fp").agg(row).select("row.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold passages of two or more benchmark items go.

    Null and empty texts and repeated rows stay; an empty table gives no rows.
    """
    return decontaminate.reject(_documents(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: its words of a document over the document's size, rounded.

    Blocks cut a few documents of each source; rounding makes them whole.
    Texts without words do not come; a null source is a source of its own,
    repeated rows share evenly, and an empty table gives no rows.
    """
    return mixing.take(_documents(docs))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus as token files, reported as they read back.

    A null or empty text is its end id alone; null doc_ids come first, repeated
    rows each count, very long texts are encoded whole, and an empty table
    gives no rows.  Workers that ran the other stages remember less than a
    query of its own would.
    """
    return tokens.token_files(docs, tokenizer(), end_id=0, remember=400_000, kept=60_000)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]

#: Hashing, learning and tokenizing are beyond SQL; the tests hold each stage against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each returns is written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
