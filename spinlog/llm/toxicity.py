"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct hashed n-grams of 4 to 7 bytes of its lower-cased form,
each with the value r = log of the smoothed ratio of its rates in toxic and other
training texts, shrunk by SIGMAS standard errors; those that nothing is left of are no features.  Logistic weights for these
values are fitted by numpy gradient descent.  While fitting, a text's own count is left out of its ratios: rare n-grams
of a training text would else look surer than they are in a text never seen.

Counted and fitted on a bounded sample (at most `per_class[k]` texts of class k); counts are added up in Spark, and only
features with a value come to the driver.  Everything scored is scored whole.  An empty or null text has the score of the
bias alone.  A document labelled twice counts once, with the larger label; null labels and ids don't count; repeated
rows are scored one by one; other columns are not read, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spinlog.llm.common import save
from spinlog.llm.grams import Distinct, gram_ids, padded
from spinlog.llm.sample import fold, labelled

PER_CLASS = (3500, 1500)
SIZES = range(4, 8)
BITS = 20
SIGMAS = 4.0
RATE = 0.2


@dataclass
class ToxicityModel:
    weights: np.ndarray  # weight times ratio, per bucket
    bias: float
    bits: int = BITS

    def scorer(self):
        distinct = Distinct(self.bits)

        def score(text: str | None) -> float:
            buckets = features(text, self.bits)
            buckets = distinct(buckets[self.weights[buckets] != 0])
            z = float(self.weights[buckets].sum(dtype=np.float64)) + self.bias
            return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))

        return score

    def column(self, text: Column) -> Column:
        return F.pandas_udf(_iterator(self), "double")(text)


def _iterator(model: ToxicityModel):
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = model.scorer()
        for texts in batches:
            yield pd.Series([score(t) for t in texts], dtype="float64")

    return toxicity


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    return np.concatenate(gram_ids(padded(text), SIZES, bits))


def _counted(sample: DataFrame, bits: int) -> DataFrame:
    """bucket, c0, c1: texts of either class that hold an n-gram of the bucket, for all buckets that occur."""

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        distinct, held = Distinct(bits), np.zeros((2, 1 << bits), np.int32)
        for frame in batches:
            for label, text in zip(frame["label"], frame["text"], strict=True):
                held[int(label)][distinct(features(text, bits))] += 1
        buckets = np.flatnonzero(held.any(0))
        for k in range(0, len(buckets), 100_000):
            some = buckets[k:k + 100_000]
            yield pd.DataFrame({"bucket": some.astype(np.int32), "c0": held[0][some].astype(np.int64), "c1": held[1][some].astype(np.int64)})

    rows = sample.select("label", "text").mapInPandas(counts, "bucket int, c0 long, c1 long")
    return rows.groupBy("bucket").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def shrunk(c0: np.ndarray, c1: np.ndarray, texts: tuple[int, int]) -> np.ndarray:
    """Smoothed log ratio of rates, nearer to zero by what chance alone gives."""
    ratio = np.log((c1 + 1) / (texts[1] + 2)) - np.log((c0 + 1) / (texts[0] + 2))
    error = np.sqrt(1 / (c0 + 1) + 1 / (c1 + 1))
    return np.sign(ratio) * np.maximum(0, np.abs(ratio) - SIGMAS * error)


def _kept(counted: DataFrame, texts: tuple[int, int]) -> DataFrame:
    """The buckets whose ratio is not zero; the rest never leaves the executors.  Same formula as `shrunk`."""
    ratio = F.log((F.col("c1") + 1) / (texts[1] + 2)) - F.log((F.col("c0") + 1) / (texts[0] + 2))
    return counted.where(F.abs(ratio) > SIGMAS * F.sqrt(1 / (F.col("c0") + 1) + 1 / (F.col("c1") + 1)))


def fit(sample: DataFrame, share: float, bits: int = BITS, rounds: int = 12) -> ToxicityModel:
    """`sample` (doc_id, text, label) is bounded; its features, not its texts, come to the driver."""
    sample = save(sample, "toxic-sample")
    by_label = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    texts = (by_label.get(0, 0), by_label.get(1, 0))
    rate = min(max(share, 1e-3), 1 - 1e-3)
    if not all(texts):  # nothing to tell apart
        return ToxicityModel(np.zeros(1 << bits, np.float32), float(np.log(rate / (1 - rate))), bits)
    kept = _kept(_counted(sample, bits), texts).orderBy("bucket").collect()
    buckets, c0, c1 = (np.array([r[c] for r in kept], np.int64) for c in ("bucket", "c0", "c1"))
    place = np.full(1 << bits, -1, np.int32)
    place[buckets] = np.arange(len(buckets), dtype=np.int32)

    def known_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        distinct = Distinct(bits)
        for frame in batches:
            held = [place[distinct(features(t, bits))] for t in frame["text"]]
            yield pd.DataFrame({"label": frame["label"], "doc_id": frame["doc_id"], "ids": [
                np.sort(h[h >= 0]).astype("<u4").tobytes() for h in held]})

    rows = sample.mapInPandas(known_features, "label int, doc_id long, ids binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["ids"]))
    sets = [np.frombuffer(r["ids"], "<u4") for r in rows]
    labels = np.array([r["label"] for r in rows], np.float64)
    del rows
    values = [shrunk(c0[ids] - (y == 0), c1[ids] - (y == 1), texts).astype(np.float32) for ids, y in zip(sets, labels, strict=True)]
    weights, bias, square, bias_square = np.ones(len(buckets)), 0.0, np.full(len(buckets), 1e-2), 1e-2
    rng = np.random.default_rng(0)
    for _ in range(rounds):
        for i in rng.permutation(len(sets)):
            ids, value = sets[i], values[i]
            z = float(weights[ids] @ value) + bias
            slope = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[i]
            if abs(slope) < 1e-3:
                continue
            step = slope * value + 1e-4 * weights[ids]
            square[ids] += step * step
            weights[ids] -= RATE * step / np.sqrt(square[ids])
            bias_square += slope * slope
            bias -= RATE / 2 * slope / np.sqrt(bias_square)
    taken = labels.mean()
    bias += np.log(rate / (1 - rate)) - np.log(taken / (1 - taken))
    scaled = np.zeros(1 << bits, np.float32)
    scaled[buckets] = weights * shrunk(c0, c1, texts)
    return ToxicityModel(scaled, float(bias), bits)


def train(docs: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0, per_class: tuple[int, int] = PER_CLASS) -> ToxicityModel:
    sample, share = labelled(docs, labels, "toxic", parts, held, per_class)
    return fit(sample, share)


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of `docs`."""
    model = train(docs, labels)
    scored = docs.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
                         model.column(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
