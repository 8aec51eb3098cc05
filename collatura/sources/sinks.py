"""Where results go; existing results are only replaced when told to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collatura.functions import text as X


def _mode(force: bool) -> str:
    return "overwrite" if force else "errorifexists"


def compared(errors: DataFrame, path: str, force: bool = False) -> None:
    """All differences, a folder a chapter."""
    errors.write.mode(_mode(force)).partitionBy("chapter_id").parquet(path)


def filtered(errors: DataFrame, path: str, force: bool = False) -> None:
    """The differences kept, as JSON lines, a folder a chapter."""
    errors.where("filter_reason IS NULL").write.mode(_mode(force)).partitionBy("chapter_id").json(path)


def normalized(texts: DataFrame, path: str, force: bool = False) -> None:
    """Normal texts (chapter_id, text), a folder a chapter."""
    texts.select("chapter_id", "text").write.mode(_mode(force)).partitionBy("chapter_id").text(path)


def reader_report(errors: DataFrame) -> DataFrame:
    """(chapter_id, line_no, line): what the narrator reads, in order of time."""
    from pyspark.sql import Window

    order = Window.partitionBy("chapter_id").orderBy("t", "err_id")
    line = F.format_string("%s  %s  (%s)", X.duration("t"), X.marker("type", "wrong", "correct"), F.coalesce("context", F.lit("")))
    return errors.where("filter_reason IS NULL").select("chapter_id", F.row_number().over(order).alias("line_no"), line.alias("line"))


def book_report(errors: DataFrame) -> DataFrame:
    """(line): the reports of all chapters in one, each under its heading."""
    lines = reader_report(errors)
    heads = lines.select("chapter_id").distinct().select("chapter_id", F.lit(0).alias("line_no"), F.concat(F.lit("# "), "chapter_id").alias("line"))
    return lines.unionByName(heads).orderBy("chapter_id", "line_no").select("line")


def export(rows: DataFrame, path: str, format: str = "csv", force: bool = False) -> None:
    """Patterns or features as CSV (arrays as JSON) or JSON lines."""
    if format == "csv":
        nested = {c: F.to_json(F.col(c)) for c, t in rows.dtypes if t.startswith(("array", "struct", "map"))}
        rows = rows.withColumns(nested) if nested else rows
        rows.write.mode(_mode(force)).option("header", True).csv(path)
    elif format == "json":
        rows.write.mode(_mode(force)).json(path)
    else:
        raise ValueError(f"no export as {format!r}")


def batch_report(errors: DataFrame) -> DataFrame:
    """(chapter_id, n_errors, n_kept, n_substitution, ...) of each chapter."""
    from collatura.schemas import ERROR_TYPES

    counts = [F.count_if(F.col("type") == t).alias(f"n_{t}") for t in ERROR_TYPES]
    return errors.groupBy("chapter_id").agg(F.count("*").alias("n_errors"), F.count_if(F.col("filter_reason").isNull()).alias("n_kept"), *counts)


def append_history(run: DataFrame, path: str) -> None:
    """One more test run (run_ts, chapter_id, golden_found, golden_total, total, comment)."""
    run.write.mode("append").parquet(path)


def append_occurrences(rows: DataFrame, path: str) -> None:
    """False positives marked by a reader; the store only ever grows."""
    rows.write.mode("append").parquet(path)


def append_verdicts(rows: DataFrame, path: str) -> None:
    """Verdicts (chapter_id, err_id, verdict, at): false positive, or for the reader."""
    rows.where(F.col("verdict").isin("false_positive", "for_reader")).write.mode("append").parquet(path)


def markdown(patterns: DataFrame, n: int = 50) -> str:
    """The most frequent patterns as a Markdown table; n bounds what reaches the driver."""
    rows = patterns.orderBy(F.col("count").desc(), "wrong", "correct").limit(n).collect()
    lines = ["| heard | expected | type | count |", "|---|---|---|---|"]
    return "\n".join(lines + [f"| {r['wrong']} | {r['correct']} | {r['type']} | {r['count']} |" for r in rows])
