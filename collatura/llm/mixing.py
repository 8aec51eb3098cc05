"""Mix sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from collatura.llm.common import Scratch

#: Weights dealt to the sources in turn, the mix's share of all words, and how often a word may be taken.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Slots that the schedule aims at, rows of a source that one task orders, and bits of the hash by which rows look up their copies.
SLOTS, ROWS, CELL_BITS = 1 << 18, 20_000, 12


def n_words(text: Column) -> Column:
    """Runs without ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source_no, source, source_size, target) of each row (source, source_size).

    Sources by code point, null last, get the weights in turn.  Sharing a total
    by weight, holding sources at ``most`` times their size and resharing the
    excess ends at a level: a source gets its weight times the level, or its
    limit if that is less.  The windows run over a row a source.
    """
    rows = sizes.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("source_no") - 1, F.lit(len(weights))) + 1)
    rows = rows.withColumns({"weight": weight, "limit": F.col("source_size") * F.lit(float(most)), "all": F.sum("source_size").over(Window.partitionBy())})
    before = Window.orderBy(F.col("limit") / F.col("weight"), "source_no").rowsBetween(Window.unboundedPreceding, -1)
    onwards = Window.orderBy(F.col("limit") / F.col("weight"), "source_no").rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("all") * F.lit(float(share)) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(onwards)
    rows = rows.withColumns({"level": level, "at": F.col("limit") / F.col("weight")})
    fits = F.col("level") <= F.col("at")
    level = F.coalesce(F.min_by(F.when(fits, F.col("level")), F.when(fits, F.struct("at", "source_no"))).over(Window.partitionBy()), F.max("at").over(Window.partitionBy()))
    return rows.select("source_no", "source", "source_size", F.least("limit", F.col("weight") * level).alias("target"))


def schedule(goals: DataFrame, n_slots: int) -> DataFrame:
    """(slot, source_no, rank) of each slot: which source's next block it takes.

    ``goals`` has (source_no, need): how many blocks each source gives, in all
    ``n_slots``.  Slot i sits at the van der Corput point of i (its binary
    digits reversed), mapped through the cumulative needs, so every stretch of
    the schedule holds each source near its share.  Slots of a source beyond
    its need go; what a source lacks follows at the end.
    """
    digits = max(1, (n_slots - 1).bit_length())
    turned = F.conv(F.reverse(F.lpad(F.bin("id"), digits, "0")), 2, 10).cast("long")
    slots = goals.sparkSession.range(n_slots).select(F.col("id").alias("slot"), F.shiftright(turned * F.lit(n_slots), digits).alias("point"))
    reach = F.sum("need").over(Window.orderBy("source_no"))
    cell = max(1, n_slots // 4096)
    spans = goals.where("need > 0").select("source_no", "need", (reach - F.col("need")).alias("lo"), reach.alias("hi"))
    cells = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor((F.col("hi") - 1) / cell))))
    dealt = slots.withColumn("cell", F.floor(F.col("point") / cell)).join(cells, "cell").where("lo <= point AND point < hi")
    # Ranks in two steps: slots are ordered within chunks, and chunks within the source.
    dealt = dealt.select("slot", "source_no", "need", F.shiftright("slot", 16).alias("chunk"))
    chunks = dealt.groupBy("source_no", "chunk").agg(F.count("*").alias("n"))
    chunks = chunks.select("source_no", "chunk", (F.sum("n").over(Window.partitionBy("source_no").orderBy("chunk")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("source_no", "chunk").orderBy("slot")) - 1
    ranked = dealt.withColumn("own", own).join(chunks, ["source_no", "chunk"]).select("slot", "source_no", "need", (F.col("before") + F.col("own")).alias("rank"))
    given = ranked.groupBy("source_no").agg(F.count("*").alias("given"))
    short = spans.join(given, "source_no", "left").select("source_no", "need", F.coalesce("given", F.lit(0)).alias("given")).where("given < need")
    tail = short.select("source_no", F.explode(F.sequence("given", F.col("need") - 1)).alias("rank"))
    tail = tail.select((F.lit(n_slots) * (F.col("source_no") + 1) + F.col("rank")).alias("slot"), "source_no", "rank")
    return ranked.where("rank < need").select("slot", "source_no", "rank").unionByName(tail)


def _key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The hash by which the documents of a source are shuffled."""
    return F.xxhash64(doc_id, text)


def _top(key: str, bits: int) -> Column:
    """The first bits of a long, which keep its order."""
    return F.shiftright(key, 64 - bits) if bits else F.lit(0).cast("long")


def _mixed(scratch: Scratch, docs: DataFrame, weights: tuple, share: float, most: float, n_slots: int) -> DataFrame:
    """(source, source_no, mix, doc_id, size, source_size, target, taken) of each row."""
    sized = docs.select(F.col("doc_id"), F.col("source"), n_words(F.col("text")).alias("size"), _key().alias("mix"))
    sized = scratch.table(sized, "sized")
    goals = scratch.table(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    total = goals.agg(F.sum("source_size"), F.sum("target")).first()
    block = max(1, -(-int(total[1] or 0) // n_slots))
    n_blocks = F.ceil(F.col("source_size") / block).cast("long")
    passes = F.least(F.floor(F.col("target") / F.greatest("source_size", F.lit(1))), F.lit(int(most))).cast("long")
    rest = F.least(F.round((F.col("target") - passes * F.col("source_size")) / block).cast("long"), n_blocks)
    need = F.least(passes * n_blocks + rest, F.lit(int(most)) * n_blocks)
    goals = scratch.table(goals.select("*", n_blocks.alias("n_blocks"), need.alias("need")), "goals")
    n = goals.agg(F.sum("need")).first()[0] or 0
    slots = schedule(goals.select("source_no", "need"), n).join(goals.select("source_no", "n_blocks"), "source_no")
    times = slots.groupBy("source_no", F.pmod("rank", "n_blocks").alias("block")).agg(F.count("*").alias("times"))

    # Positions in two steps too: rows within ranges of the hash, ranges within the source.
    bits = max(0, (sized.count() // ROWS).bit_length())
    known = goals.select(F.col("source").alias("name"), "source_no", "source_size", "target")
    rows = sized.withColumn("bucket", _top("mix", bits)).join(known, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    held = rows.groupBy("source_no", "bucket").agg(F.sum("size").alias("n"))
    held = held.select("source_no", "bucket", (F.sum("n").over(Window.partitionBy("source_no").orderBy("bucket")) - F.col("n")).alias("before"))
    own = F.sum("size").over(Window.partitionBy("source_no", "bucket").orderBy("mix", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("own", own).join(held, ["source_no", "bucket"])
    rows = rows.withColumn("lo", F.col("before") + F.col("own") - F.col("size")).drop("bucket", "own", "before")
    worded = rows.where("size > 0").withColumn("hi", F.col("lo") + F.col("size"))
    pieces = worded.withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))))
    over = F.least("hi", (F.col("block") + 1) * F.lit(block)) - F.greatest("lo", F.col("block") * F.lit(block))
    pieces = pieces.join(times, ["source_no", "block"], "left").withColumn("words", over * F.coalesce("times", F.lit(0)))
    columns = ["source", "source_no", "mix", "doc_id", "size", "source_size", "target"]
    taken = pieces.groupBy(*columns, "lo").agg(F.sum("words").cast("long").alias("taken")).drop("lo")
    return taken.unionByName(rows.where("size = 0").drop("lo").withColumn("taken", F.lit(0).cast("long")))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, n_slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each row of ``docs`` (doc_id, text, source).

    Each source's documents, shuffled by a hash, lie end to end and are cut
    into blocks of equally many words; the schedule takes whole blocks, passing
    over a source again if its target is larger than the source.  ``taken``
    counts the words of the row that the mix takes, repeats counted; it is at
    most ``most`` (a whole number) times the size.  A source's taken words miss
    its target by a block at most.  Null or blank texts have size 0 and are not
    taken; a null source is a source of its own, repeated rows count each, and
    an empty table gives no rows.  Only DataFrame functions run.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    out = _mixed(scratch, docs, weights, share, most, n_slots).select("doc_id", "size", "source_size", "target", "taken")
    return scratch.finish(out, "sized", "targets", "goals")


def take(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, n_slots: int = SLOTS) -> DataFrame:
    """The rows of ``docs``, columns as they are, as often as the mix takes them.

    A row comes round(taken / size) times, halves up, so that the few rows a
    block cuts stay whole; rows without words do not come.  Rows equal in
    doc_id, text and source share what is taken of them evenly.  Nulls, empty
    and very long texts count as in ``mix``; columns of any name stay as they
    are, and an empty table gives no rows.

    Texts do not move: a source's rows lie in the order of their hash, and what
    lies in one block comes equally often, so the copies are constant between
    the hashes at which a block begins or ends.  Those stretches are at most
    three for each of the ``n_slots`` blocks that are taken, and one for each
    source and 1 / 4,096 of the hashes, whatever the number of rows; so they are
    broadcast, and rows look theirs up.
    """
    scratch = Scratch(docs.sparkSession, "take")
    found = _mixed(scratch, docs, weights, share, most, n_slots)
    found = found.where("size > 0").groupBy("source", "source_no", "mix").agg((F.sum("taken") / F.sum("size")).alias("part"))
    times = F.floor(F.col("part") + 0.5).cast("int")
    found = found.select("source", "source_no", "mix", _top("mix", CELL_BITS).alias("cell"), times.alias("times"))
    order = Window.partitionBy("source_no", "cell").orderBy("mix")
    starts = found.withColumn("last", F.lag("times").over(order)).where("last IS NULL OR last <> times")
    spans = starts.withColumn("until", F.lead("mix").over(order)).where("times > 0")
    spans = scratch.table(spans.select("source", "cell", F.col("mix").alias("since"), "until", "times"), "spans")
    scratch.drop("sized", "targets", "goals")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("source").alias("own"), _key().alias("mix"))
    rows = rows.where(F.col("row.text").rlike(r"[^\x20\x09-\x0D]")).withColumn("at", _top("mix", CELL_BITS))
    inside = (F.col("mix") >= F.col("since")) & (F.col("until").isNull() | (F.col("mix") < F.col("until")))
    rows = rows.join(F.broadcast(spans), F.col("own").eqNullSafe(F.col("source")) & (F.col("at") == F.col("cell")) & inside)
    return rows.select("row", F.explode(F.sequence(F.lit(1), "times"))).select("row.*")
