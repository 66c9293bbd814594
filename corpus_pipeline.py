"""Cleans a corpus in five stages: toxicity, near duplicates, benchmark passages, personal data, token ids.

Each stage takes (spark, docs, sf_dir), reads all that its predecessor kept and
returns a DataFrame; all but the last return the columns of documents.  Stages
are written as Parquet to the shared scratch folder and read again.  Null and empty texts pass
every stage (one of several empty texts stays); an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spinlog.llm import decontaminate, pii, sentencepiece_sa, simhash, toxicity
from spinlog.llm.common import save, table
from spinlog.llm.queries import PIECE_BPE


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return docs.filter(model.column(F.col("text")) < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays; fingerprints of four-word shingles are linked at 4 or fewer differing bits."""
    return simhash.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kind; n_chars follows the text."""
    out = docs.withColumn("text", pii.redact(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, ids, same: SentencePiece ids, and whether they decode to the text."""
    return sentencepiece_sa.encode_documents(docs, PIECE_BPE).select("doc_id", "n_pieces", "ids_crc32", "ids", "same")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("decontaminate", drop_benchmark),
    ("pii", redact_personal_data),
    ("sentencepiece", encode),
]
ORACLE_SQL = None  # a trained classifier and fingerprints have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), name)
    return docs
