"""The queries of this subpackage: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brasswork.llm import byte_bpe, filter_audit, language_id, lsh_forest, near_duplicates, ogg, packing, periodic_runs, pii, quality, repeats, toxicity, vector_index
from brasswork.llm.common import held_out, labelled_sample, read_table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = toxicity.fit_sample(labelled_sample(spark, sf_dir, "toxic", max_rows=8000))
    return toxicity.score_documents(read_table(spark, sf_dir, "documents"), model)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest_documents(spark, read_table(spark, sf_dir, "documents"))


def op3_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.digest_documents(read_table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.digest_documents(read_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates.jaccard_classes(spark, read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "n_links")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")  # the vocabulary of byte_bpe_50k.json, as ranks
    return packing.pack_documents(spark, read_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language_id.predict_documents(documents.select("doc_id", "text"), language_id.fit_documents(documents))
    return found.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest_documents(spark, read_table(spark, sf_dir, "documents"), passage=repeats.PASSAGE)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = quality.fit_sample(labelled_sample(spark, sf_dir, "quality", max_rows=3000))
    return quality.score_documents(read_table(spark, sf_dir, "documents"), model)


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_index.top_k(spark, read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest_documents(read_table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op13_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_components(spark, read_table(spark, sf_dir, "documents"))


OP10_SQL = """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_toxicity, op2_pii, op3_ogg, op4_byte_bpe, op5_jaccard_join, op6_packing, op7_language_id, op8_suffix_dedup, op9_quality, op10_top_k, op11_periodic_runs, op12_filter_audit, op13_minhash_forest)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op10_top_k": OP10_SQL, "op12_filter_audit": filter_audit.SQL}
