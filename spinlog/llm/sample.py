"""A bounded, balanced sample of labelled rows to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(doc_id, parts: int):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts


def labelled(docs: DataFrame, labels: DataFrame, label: str, parts: int, held: int, per_class: tuple[int, int]):
    """(sample, share): up to `per_class[k]` training texts of class k, and the share of class 1 among all training labels.

    Rows of the held-out part never enter.  Which rows are taken depends on a
    hash of doc_id alone.  The ids taken, at most the sum of `per_class`, are broadcast
    to the scan of the texts; no text is shuffled.  Documents labelled more than
    once, or with a null, count once, or not at all.
    """
    known = (labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (fold("doc_id", parts) != held))
             .groupBy("doc_id").agg(F.max(label).cast("int").alias("label")))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    picked = [known.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class[k]) for k in (0, 1)]
    picked = picked[0].union(picked[1])
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "text", "label"), share
