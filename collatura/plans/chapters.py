"""From heard and expected words to filtered errors, for all chapters in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from collatura.operators import align as A
from collatura.operators.evaluation import correspondence
from collatura.operators.filters import Dictionaries, chains, enrich
from collatura.operators.rules import Config, filter_errors


def paired(heard: DataFrame, expected: DataFrame) -> DataFrame:
    """(pair, a, b, times, tokens): each chapter's words on both sides, in order.

    A chapter is the unit of work and its length the bound of a row.
    """
    side = lambda df, *extra: df.groupBy("chapter_id").agg(F.sort_array(F.collect_list(F.struct("pos", "norm", *extra))).alias("s"))
    a = side(heard, "t_start").select(F.col("chapter_id").alias("pair"), F.col("s.norm").alias("a"), F.col("s.t_start").alias("times"))
    b = side(expected, "original_text").select(F.col("chapter_id").alias("pair"), F.col("s.norm").alias("b"), F.col("s.original_text").alias("tokens"))
    return a.join(b, "pair", "full")


def compare(pairs: DataFrame, around: int = 4, phantom: float | None = None) -> DataFrame:
    """Error rows of each pair: typed, timed, with context, from the end of the introduction on.

    ``phantom``: seconds to skip; None finds them, from the first run of
    matched words.
    """
    rows = A.in_context(pairs, around).withColumn("marker_pos", F.least("b_pos", F.lit(around)).cast("int"))
    rows = rows.where("t >= phantom") if phantom is None else A.skip_phantom(rows, phantom)
    columns = ["err_id", "t", "type", "wrong", "correct", "context", "marker_pos", "transcript_context", "before", "after", "after_stop"]
    return rows.select(F.col("pair").alias("chapter_id"), *columns)


def judge(errors: DataFrame, own: Dictionaries, config: Config | None = None) -> DataFrame:
    """``errors`` with ``filter_reason``: the rules, then chains of shifted words among what they keep."""
    config = config or Config()
    rows = filter_errors(enrich(errors, own), config)
    protected = F.col("rule").isNotNull() & F.col("filter_reason").isNull()
    linked = chains(rows, config.chain_seconds, config.chain_distance)
    reason = F.coalesce("filter_reason", F.when(F.col("in_chain") & (F.col("type") == "substitution") & ~protected, F.lit("alignment_chain")))
    keep = [c for c in errors.columns if c not in ("before", "after", "after_stop")]
    return linked.withColumn("filter_reason", reason).select(*keep, "filter_reason")


def run(heard: DataFrame, expected: DataFrame, own: Dictionaries, config: Config | None = None, phantom: float | None = None) -> DataFrame:
    """The whole job; every chapter is a row until its differences are known."""
    return judge(compare(paired(heard, expected), phantom=phantom), own, config)


def with_previous(rows: DataFrame, by: str, at: str, value: str, name: str, most: int = 20_000) -> DataFrame:
    """``rows`` with ``name``: ``value`` of the row before by the number ``at`` among those alike in ``by``; first rows go.

    Rows are ordered within stretches of ``at`` of some ``most`` rows, so no
    task holds all rows of a group.  The first of a stretch follows the last
    of the stretch before it that has rows of its group.
    """
    n = max(rows.count() // most, 1)
    cuts = rows.agg(F.percentile_approx(at, [k / n for k in range(1, n)], max(10_000, 20 * n))).first()[0] if n > 1 else None
    edges = F.array(*[F.lit(c) for c in sorted(set(cuts or []))]).cast("array<double>")
    rows = rows.withColumn("_part", F.size(F.filter(edges, lambda x: x <= F.col(at))))
    order = Window.partitionBy(by, "_part").orderBy(at, value)
    rows = rows.withColumns({name: F.lag(value).over(order), "_first": F.row_number().over(order) == 1, "_last": F.lead(F.lit(1)).over(order).isNull()})
    inside = rows.where("NOT _first")
    ends = rows.where("_last").select(F.col(by).alias("_by"), F.lead("_part").over(Window.partitionBy(by).orderBy("_part")).alias("_next"), F.col(value).alias("_value"))
    begins = rows.where("_first").join(ends, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_next")))
    return inside.unionByName(begins.withColumn(name, F.col("_value")).select(*inside.columns)).drop("_part", "_first", "_last").where(F.col(name).isNotNull())


def mismatched(pairs: DataFrame, least: float = 0.3) -> DataFrame:
    """(pair, share) of chapters whose two sides have too few words in common to belong together."""
    share, bad = correspondence(F.coalesce("a", F.array().cast("array<string>")), F.coalesce("b", F.array().cast("array<string>")), least)
    return pairs.where(bad).select("pair", share.alias("share"))


def stale(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """(chapter_id) whose newest input is newer than its newest output, or that has none."""
    i = inputs.groupBy("chapter_id").agg(F.max("modified").alias("changed"))
    o = outputs.groupBy("chapter_id").agg(F.max("modified").alias("made"))
    return i.join(o, "chapter_id", "left").where("made IS NULL OR made < changed").select("chapter_id")
