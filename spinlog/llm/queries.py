"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spinlog.llm import (
    bitplane, decontaminate, filter_audit, katz, license, pii, quality, repeats, sentencepiece_sa, simhash, spelling, topk, toxicity,
)
from spinlog.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def op1_bitplane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of byte planes, read back."""
    return (bitplane.token_files(table(spark, sf_dir, "documents"), BYTE_BPE)
            .select("doc_id", "start", "n_tokens", "ids_crc32", "shard"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (sentencepiece_sa.encode_documents(table(spark, sf_dir, "documents"), PIECE_BPE)
            .select("doc_id", "n_pieces", "ids_crc32", "n_decoded", "same"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best of all vectors for each whose id is divisible by 100."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP8_SQL = """
WITH q AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) AS score
    FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def op9_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Katz log probability of every text, and that of counted words with one added."""
    return katz.score(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each filter removes in each order of the five, by source."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, the near word each leads to, and the last one on that way."""
    return spelling.group(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_bitplane": op1_bitplane,
    "op2_decontaminate": op2_decontaminate,
    "op3_repeats": op3_repeats,
    "op4_simhash": op4_simhash,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_pii": op6_pii,
    "op7_quality": op7_quality,
    "op8_topk": op8_topk,
    "op9_license": op9_license,
    "op10_toxicity": op10_toxicity,
    "op11_katz": op11_katz,
    "op12_filter_audit": op12_filter_audit,
    "op13_spelling": op13_spelling,
}
ORACLE: dict[str, str] = {"op2_decontaminate": decontaminate.ORACLE, "op8_topk": OP8_SQL, "op12_filter_audit": filter_audit.ORACLE}
