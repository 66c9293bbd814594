"""The toxicity classifier: held-out recall and precision, and scores against plain dictionaries."""

from __future__ import annotations

import math
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from spinlog.llm import toxicity
from spinlog.llm.common import table


def test_held_out_recall_and_precision(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    known = labels.select("doc_id").distinct()
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs.join(known, "doc_id", "left_semi"), labels).collect()}
    pairs = [(got[i], y) for i, y in duckdb.sql(f"select doc_id, toxic from '{sf}/labels.parquet'").fetchall()
             if zlib.crc32(str(i).encode()) % 5 == 0]
    caught = sum(p == y == 1 for p, y in pairs)
    assert caught >= 0.85 * sum(y for _, y in pairs)
    assert caught >= 0.85 * sum(p for p, _ in pairs)


def grams(text: str | None, bits: int) -> set[int]:
    data = b" " + (text or "").lower().encode("utf-8", "replace") + b" "
    out = set()
    for n in toxicity.SIZES:
        for i in range(len(data) - n + 1):
            acc = data[i]
            for byte in data[i + 1:i + n]:
                acc = (acc * 0x01000193 + byte) % 2**32
            out.add((acc + n) * 0x9E3779B1 % 2**32 >> 32 - bits)
    return out


def test_counts_and_scores_equal_plain_dictionaries(spark):
    texts = [(i, ("you utter moronling " if i % 3 == 0 else "a fine day ") + f"number {i * 7919} ", int(i % 3 == 0)) for i in range(120)]
    texts += [(200, "", 0), (201, None, 1), (202, "x" * 20_000, 0), (0, texts[0][1], 1)]  # empty, null, long, a repeated row
    sample = spark.createDataFrame(texts, "doc_id long, text string, label int").repartition(5)
    want: dict[int, list[int]] = {}
    for _, text, label in texts:
        for g in grams(text, toxicity.BITS):
            want.setdefault(g, [0, 0])[label] += 1
    assert {r["bucket"]: [r["c0"], r["c1"]] for r in toxicity._counted(sample, toxicity.BITS).collect()} == want

    model = toxicity.fit(sample, 1 / 3)
    total = [sum(y == k for *_, y in texts) for k in (0, 1)]
    kept = set()
    for g, (c0, c1) in want.items():
        ratio = math.log((c1 + 1) / (total[1] + 2)) - math.log((c0 + 1) / (total[0] + 2))
        if abs(ratio) > toxicity.SIGMAS * math.sqrt(1 / (c0 + 1) + 1 / (c1 + 1)):
            kept.add(g)
    assert kept and set(np.flatnonzero(model.weights).tolist()) <= kept
    scorer = model.scorer()
    unseen = [t for _, t, _ in texts[:6]] + ["quite a moronling", "", None, "a fine day"]
    df = spark.createDataFrame(list(enumerate(unseen)), "i int, t string")
    by_spark = [r[0] for r in df.orderBy("i").select(model.column(F.col("t"))).collect()]
    for text, score in zip(unseen, by_spark, strict=True):
        z = model.bias + sum(float(model.weights[g]) for g in grams(text, toxicity.BITS))
        assert score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6) and score == scorer(text)
    assert scorer("quite a moronling") > 0.5 > scorer("a fine day")
