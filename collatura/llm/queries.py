"""The registered queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from collatura.llm import decontaminate, lines, mixing, passages, pii, quality, simhash, tokens, toxicity, vectors


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The demonstration key of op1; production passes its own secret.
PII_KEY = b"collatura demonstration key"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms for their personal data."""
    return pii.pseudonymise(_table(spark, sf_dir, "documents"), PII_KEY)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of all documents by SimHash, at 3 differing bits."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the benchmark occurs in each document."""
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each document, learned from the training folds of the labels."""
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each document, learned from weak labels alone."""
    return quality.quality(_table(spark, sf_dir, "documents"))


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that repeat across documents, and which occurrences go."""
    return passages.repeated_passages(_table(spark, sf_dir, "documents"))


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words the mix takes of each document."""
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines repeated within two edits, and which of them go, by document."""
    return lines.line_duplicates(_table(spark, sf_dir, "documents"))


def tokenizer() -> str:
    """The tokenizer's file; it stays where it is installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written to files and read back."""
    return tokens.token_files(_table(spark, sf_dir, "documents"), tokenizer(), end_id=0)


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate embeddings at a cosine of 0.9."""
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_simhash, op3_decontaminate, op4_toxicity, op5_quality, op6_passages, op7_mix, op8_lines, op9_tokens, op10_vectors)}

#: Hashing, learning, files and a shuffled schedule are beyond SQL; tests hold those queries against plain versions.
ORACLE: dict[str, str] = {
    "op3_decontaminate": r"""
WITH low AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, coalesce(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM low),
ilow AS (SELECT item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM benchmark WHERE item_id IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM ilow),
iw AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(ws, p, p + k - 1), ' ') AS w
       FROM (SELECT item_id, ws, least(8, len(ws)) AS k, unnest(range(1, len(ws) - least(8, len(ws)) + 2)) AS p FROM i WHERE len(ws) > 0)),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT doc_id, k, p, array_to_string(list_slice(ws, p, p + k - 1), ' ') AS w
       FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM d CROSS JOIN ks WHERE len(ws) >= k)),
hit AS (SELECT doc_id, k, p, item_id FROM dw JOIN iw USING (k, w)),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op10_vectors": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS s FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) >= 0.9 * a.s * b.s),
r AS (SELECT vec_id, vec_id AS x FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.x),
c AS (SELECT vec_id, min(x) AS component_id FROM r GROUP BY vec_id),
k AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN k USING (vec_id)""",
}
