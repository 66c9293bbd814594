"""The stored cache: upserts by bucket, commits, lookups without a shuffle of the cache."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from spinlog.operators import cache as C
from spinlog.operators.cache_store import CacheStore

NOW = dt.datetime(2024, 6, 1)


def row(key, uri, days=0, negative=False):
    return (key, negative, uri, uri, "a", None, None, None, "exact", "search", NOW - dt.timedelta(days=days), 1)


def frame(spark, rows):
    return spark.createDataFrame(rows, C.CACHE)


def test_upserts_rewrite_their_buckets_only(spark, tmp_path):
    store = CacheStore(spark, str(tmp_path / "cache"), buckets=8)
    assert store.read().count() == 0 and store.upsert(frame(spark, [])) == [] and store.last() == (0, {})
    first = {f"k{i}": row(f"k{i}", f"u{i}", days=i) for i in range(60)}
    assert store.upsert(frame(spark, [*first.values(), row(None, "x")])) == list(range(8))
    before = store.last()[1]
    seen = store.read()
    second = [row("k3", "new", 1), row("k3", "older", 2), row("fresh", None, 0, True)]
    touched = store.upsert(frame(spark, second))
    after = store.last()[1]
    assert len(touched) <= 2 and {b for b in after if after[b] != before[b]} == set(touched)
    want = {**first, "k3": second[0], "fresh": second[2]}
    assert sorted(map(tuple, store.read().collect()), key=repr) == sorted(want.values(), key=repr)
    assert sorted(map(tuple, seen.collect()), key=repr) == sorted(first.values(), key=repr)  # a reader keeps its commit
    again = CacheStore(spark, str(tmp_path / "cache"), buckets=8)
    assert again.read().count() == 61
    store.forget()
    assert again.read().count() == 61


def test_a_failed_upsert_is_invisible(spark, tmp_path):
    store = CacheStore(spark, str(tmp_path / "cache"), buckets=4)
    store.upsert(frame(spark, [row("a", "1"), row("b", "2")]))
    broken = frame(spark, [row("a", "9"), row("c", "9")]).withColumn(
        "track_uri", F.when(F.col("norm_key") == "c", F.raise_error(F.lit("lost"))).otherwise(F.col("track_uri")))
    with pytest.raises(Exception, match="lost"):
        store.upsert(broken)
    assert {r["norm_key"]: r["track_uri"] for r in store.read().collect()} == {"a": "1", "b": "2"}


def test_lookup_expiry_and_plan(spark, tmp_path):
    store = CacheStore(spark, str(tmp_path / "cache"), buckets=8)
    store.upsert(frame(spark, [row(f"k{i}", f"u{i}", days=i, negative=i % 2 == 1) for i in range(60)]))
    wanted = spark.range(80).select(F.concat(F.lit("k"), "id").alias("norm_key"))
    hits = {r["norm_key"]: r["hit"] for r in store.lookup(wanted, NOW).collect()}
    assert len(hits) == 80
    for i in range(80):
        alive = i < 60 and i <= (7 if i % 2 else 30)
        assert (hits[f"k{i}"] is not None) == alive and (not alive or hits[f"k{i}"]["track_id"] == f"u{i}")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = store.lookup(wanted, NOW)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
