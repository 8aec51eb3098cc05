"""The pipeline's stages against plain versions, each on what the one before kept."""

from pathlib import Path

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import zlib  # noqa: E402

from pyspark.sql import functions as F  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

import corpus_pipeline  # noqa: E402
from collatura.llm import mixing, toxicity  # noqa: E402
from collatura.llm.queries import tokenizer  # noqa: E402
from tests.llm.test_decontaminate import plain as plain_contamination  # noqa: E402
from tests.llm.test_simhash import plain_components, plain_print  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    if not Path(FOLDER).exists():
        pytest.skip("no test tables")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontamination", "mixing", "tokens"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, kept[-1], FOLDER).write.parquet(str(tmp_path / name))
        kept.append(spark.read.parquet(str(tmp_path / name)))
    assert all(k.columns == docs.columns for k in kept[:-1])
    rows = [[tuple(r) for r in k.collect()] for k in kept]

    scores = toxicity.toxicity(docs, labels).where("predicted = 0").select("doc_id").collect()
    assert sorted(r[0] for r in rows[1]) == sorted(r[0] for r in scores)

    prints = {r[0]: plain_print(r[1]) for r in rows[1]}
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    roots = set(plain_components(links, set(prints)).values())
    assert sorted(rows[2]) == sorted(r for r in rows[1] if r[0] in roots)

    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {x[0] for x in plain_contamination([r[:2] for r in rows[2]], items) if x[5]}
    assert sorted(rows[3]) == sorted(r for r in rows[2] if r[0] not in bad)

    times = {r["doc_id"]: int(r["taken"] / r["size"] + 0.5) if r["size"] else 0 for r in mixing.mix(kept[3]).collect()}
    assert sorted(rows[4]) == sorted(r for r in rows[3] for _ in range(times[r[0]]))

    whole, at = Tokenizer.from_file(tokenizer()), 0
    last = kept[5].orderBy("start").collect()
    for row, doc in zip(last, sorted(rows[4]), strict=True):
        ids = [*whole.encode(doc[1], add_special_tokens=False).ids, 0]
        assert tuple(row) == (doc[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_odd_rows_and_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, component_id string, size string"
    rows = [(1, "a plain line of words", "en", "s", 21, "x", "y"), (1, "a plain line of words", "en", "s", 21, "x", "y"), (2, None, None, None, None, None, None), (None, "no id here at all", "en", "s", 3, "x", "y"), (4, "", "en", "t", 0, "x", "y"), (5, "word " * 20_000, "en", None, 1, "x", "y")]
    folder = tmp_path / "in"
    spark.createDataFrame(rows, schema).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(1, 0, 1), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(folder)).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(str(folder / f"{name}.parquet")).limit(0).write.parquet(str(tmp_path / "none" / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_one_document_of_a_group_stays(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(7, "one two three four five", "en", "b", 1), (3, "One  two three four five", "en", "a", 1), (3, "one two three four five", "en", "a", 1), (None, "one two three four five", "en", "c", 1), (None, "quite another text with words", "en", "c", 1), (None, "quite another text with words", "en", "d", 1)]
    out = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, schema), "")
    assert sorted(((r["doc_id"], r["lang"]) for r in out.collect()), key=str) == [(3, "en"), (None, "en")]
    assert out.where(F.col("doc_id").isNull()).first()["text"].startswith("quite")
