"""The fold of the JVM next to Python's, on every code point."""

from __future__ import annotations

import random
import unicodedata

from pyspark.sql import functions as F

from spinlog.functions import text

LETTERS = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]


def folded(value: str) -> str:
    decomposed = unicodedata.normalize("NFKD", value.translate(str.maketrans(text.TYPOGRAPHIC)))
    return "".join(c for c in decomposed if not unicodedata.combining(c)).casefold()


def test_every_code_point(spark):
    rows = [(k, letter, folded(letter)) for k, letter in enumerate(LETTERS)]
    df = spark.createDataFrame(rows, "k long, t string, want string")
    bad = df.withColumn("got", text._fold_unicode(F.col("t"))).where("got is distinct from want").limit(5).collect()
    assert bad == []


def test_texts_of_many_letters(spark):
    rng = random.Random(8)
    common = [c for c in LETTERS if folded(c) != c]
    made = ["".join(rng.choice(common if rng.random() < 0.6 else LETTERS) for _ in range(rng.randrange(40))) for _ in range(3000)]
    made += ["Stra\u00dfe \ufb01n", "\ud55c\uad6d\uc5b4 \u0130", "a\u0301\u0323 \u00c5ngstr\u00f6m", "", "\u01c4", "\u2026 \u00bd"]
    df = spark.createDataFrame([(t, folded(t)) for t in made], "t string, want string")
    assert df.withColumn("got", text._fold_unicode(F.col("t"))).where("got is distinct from want").limit(5).collect() == []


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([("X",)], "t string").select(text.normalize_text(F.col("t")))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
