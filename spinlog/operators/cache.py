"""The resolution cache: a table keyed by normalized artist|title, with two lifetimes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Lifetimes of found and not-found rows.
POSITIVE_DAYS = 30
NEGATIVE_DAYS = 7

CACHE = T.StructType(
    [
        T.StructField("norm_key", T.StringType()),
        T.StructField("is_negative", T.BooleanType()),
        T.StructField("track_uri", T.StringType()),
        T.StructField("track_id", T.StringType()),
        T.StructField("artist_id", T.StringType()),
        T.StructField("matched_artist_name", T.StringType()),
        T.StructField("matched_title", T.StringType()),
        T.StructField("isrc", T.StringType()),
        T.StructField("confidence", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("resolved_at", T.TimestampNTZType()),
        T.StructField("search_calls", T.IntegerType()),
    ]
)


def alive(resolved_at: Column, is_negative: Column, as_of: Column) -> Column:
    """Not older than its lifetime; both times are UTC."""
    lifetime = F.when(is_negative, NEGATIVE_DAYS).otherwise(POSITIVE_DAYS)
    return as_of <= resolved_at + F.make_dt_interval(days=lifetime)


def lookup(wanted: DataFrame, cache: DataFrame, as_of: dt.datetime) -> DataFrame:
    """`wanted` with the live cache row of its `norm_key` as the struct `hit` (NULL on a miss).

    Expired rows are filtered before the join, so they are not shuffled.
    """
    now = F.lit(as_of).cast("timestamp_ntz")
    live = cache.where(alive(F.col("resolved_at"), F.col("is_negative"), now))
    columns = [f.name for f in CACHE if f.name != "norm_key"]
    return wanted.join(live.select("norm_key", F.struct(*columns).alias("hit")), "norm_key", "left")


def upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    """`new` replaces rows of equal key.  Write the result to a new place, then switch."""
    names = [f.name for f in CACHE]
    kept = cache.join(new.select("norm_key"), "norm_key", "left_anti")
    return kept.select(*names).unionByName(new.select(*names))
