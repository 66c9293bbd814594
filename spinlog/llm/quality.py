"""Quality: supervised subword embeddings, averaged per document, with a softmax.

Words, pairs of neighbouring words and character n-grams (those that cross no word
border) are hashed to vectors.  A document is the mean of the vectors of all its occurrences; a softmax
over two classes follows.  Vectors and output weights are trained together by
plain numpy stochastic gradient descent, on a bounded sample (at most `per_class[k]`
texts of class k).  The model is linear in the mean, so for scoring each vector is multiplied
by the difference of the two output rows once: scoring adds one number per
occurrence.  An empty or null text has a mean of zero: the score of the bias.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spinlog.llm.grams import MIX, STEP, gram_ids
from spinlog.llm.sample import fold, labelled

PER_CLASS = (1500, 1500)
SIZES = range(2, 5)
BITS = 17
DIM = 8
RATE = 0.5
UNSTEP = np.uint32(pow(int(STEP), -1, 1 << 32))


@dataclass
class QualityModel:
    vectors: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    def column(self, text: Column) -> Column:
        worth = (self.vectors @ (self.output[1] - self.output[0])).astype(np.float32)
        shift = float(self.bias[1] - self.bias[0])

        def quality(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                out = np.zeros(len(texts))
                for i, t in enumerate(texts):
                    buckets = occurrences(t)
                    z = (float(worth[buckets].sum(dtype=np.float64)) / len(buckets) if len(buckets) else 0.0) + shift
                    out[i] = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
                yield pd.Series(out)

        return F.pandas_udf(quality, "double")(text)


def occurrences(text: str | None, bits: int = BITS) -> np.ndarray:
    """Buckets of all words and n-grams, repeats included.  Case counts: shouting is a sign."""
    data = np.frombuffer(b" " + (text or "").encode("utf-8", "replace") + b" ", np.uint8)
    blank = data <= 32
    out = []
    inner = np.zeros(len(data) + 1, np.int32)
    np.cumsum(blank, out=inner[1:])
    for n, buckets in zip(SIZES, gram_ids(data, SIZES, bits), strict=True):
        # blanks may stand at the two ends of an n-gram only
        inside = inner[n - 1:len(data)] - inner[1:len(data) - n + 2]
        out.append(buckets[inside == 0])
    starts = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
    stops = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    up = np.cumprod(np.full(len(data), STEP, np.uint32), dtype=np.uint32)
    down = np.cumprod(np.full(len(data), UNSTEP, np.uint32), dtype=np.uint32)
    total = np.zeros(len(data) + 1, np.uint32)
    np.cumsum(data * up, out=total[1:], dtype=np.uint32)
    word = (total[stops] - total[starts]) * down[starts]  # the same wherever the word stands
    out.append(((word + (stops - starts).astype(np.uint32)) * MIX) >> np.uint32(32 - bits))
    # Pairs of neighbours, by the difference of their hashes: one bucket serves all words said twice in a row.
    out.append(((word[1:] - word[:-1] + np.uint32(7)) * MIX) >> np.uint32(32 - bits))
    return np.concatenate(out)


def fit(sample: DataFrame, bits: int = BITS, rounds: int = 8) -> QualityModel:
    """`sample` (text, label) is bounded; its features, not its texts, come to the driver."""

    def counted(batches):
        for frame in batches:
            rows = [np.unique(occurrences(t, bits), return_counts=True) for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "label": frame["label"],
                                "ids": [r[0].astype("<u4").tobytes() for r in rows],
                                "counts": [r[1].astype("<u4").tobytes() for r in rows]})

    rows = sample.mapInPandas(counted, "doc_id long, label int, ids binary, counts binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["ids"]))
    rng = np.random.default_rng(0)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << bits, DIM))
    output, bias = np.zeros((2, DIM)), np.zeros(2)
    texts = [(np.frombuffer(r["ids"], "<u4"), np.frombuffer(r["counts"], "<u4").astype(float), r["label"]) for r in rows]
    total, done = max(1, rounds * len(texts)), 0
    for _ in range(rounds):
        for i in rng.permutation(len(texts)):
            ids, counts, label = texts[i]
            rate = RATE * (1 - done / total)
            done += 1
            share = counts / max(1.0, counts.sum())
            mean = share @ vectors[ids]
            logits = output @ mean + bias
            slope = np.exp(logits - logits.max())
            slope /= slope.sum()
            slope[label] -= 1
            back = slope @ output
            output -= rate * np.outer(slope, mean)
            bias -= rate * 0.1 * slope
            # each vector moves as often as the text names it
            vectors[ids] -= rate * np.outer(share * np.sqrt(len(ids)), back)
    return QualityModel(vectors, output, bias)


def train(docs: DataFrame, labels: DataFrame, parts: int = 4, held: int = 2, per_class: tuple[int, int] = PER_CLASS) -> QualityModel:
    sample, share = labelled(docs, labels, "quality", parts, held, per_class)
    model = fit(sample)
    if 0 < share < 1:  # fitted on equal classes, used where they are not
        model.bias = model.bias + np.log([1 - share, share])
    return model


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of `docs`."""
    model = train(docs, labels)
    scored = docs.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
                         model.column(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
