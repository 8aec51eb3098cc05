"""Row types shared by sources, operators and sinks."""

from __future__ import annotations

from pyspark.sql import types as T

ERROR_TYPES = ("substitution", "transposition", "insertion", "deletion")

#: One difference between heard and expected text; the absent side is "", not null.
ERROR = T.StructType([
    T.StructField("chapter_id", T.StringType()),
    T.StructField("err_id", T.LongType()),
    T.StructField("t", T.DoubleType()),
    T.StructField("type", T.StringType()),
    T.StructField("wrong", T.StringType()),
    T.StructField("correct", T.StringType()),
    T.StructField("context", T.StringType()),
    T.StructField("marker_pos", T.IntegerType()),
    T.StructField("transcript_context", T.StringType()),
    T.StructField("filter_reason", T.StringType()),
])

#: One verified difference.
GOLDEN = T.StructType([
    T.StructField("chapter_id", T.StringType()),
    T.StructField("time", T.StringType()),
    T.StructField("time_seconds", T.IntegerType()),
    T.StructField("type", T.StringType()),
    T.StructField("wrong", T.StringType()),
    T.StructField("correct", T.StringType()),
    T.StructField("context", T.StringType()),
])

#: A transcript file; times may end in "s".
TRANSCRIPT = T.StructType([
    T.StructField("chunks", T.ArrayType(T.StructType([
        T.StructField("alternatives", T.ArrayType(T.StructType([
            T.StructField("text", T.StringType()),
            T.StructField("words", T.ArrayType(T.StructType([
                T.StructField("word", T.StringType()),
                T.StructField("startTime", T.StringType()),
                T.StructField("endTime", T.StringType()),
            ]))),
        ]))),
    ]))),
    T.StructField("_corrupt", T.StringType()),
])

#: A form's analysis; ``rank`` 1 is the first choice among homonyms.
LEXICON = T.StructType([T.StructField(c, T.StringType()) for c in ("form", "lemma", "pos", "number", "gender", "case", "aspect", "voice", "tense")] + [T.StructField("rank", T.IntegerType())])

#: One sighting of a false positive.
OCCURRENCE = T.StructType([
    T.StructField("wrong", T.StringType()),
    T.StructField("correct", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("seen_at", T.TimestampType()),
])
