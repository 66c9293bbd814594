"""The five derived views over `plays`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spinlog.operators.predicates import named


def times(flag: str) -> Column:
    """How often a flag is true; NULL counts as false."""
    return F.count_if(F.col(flag))


def rate(flag: str) -> Column:
    return F.avg(F.when(F.col(flag), F.lit(1.0)).otherwise(F.lit(0.0)))


def dim_track(plays: DataFrame) -> DataFrame:
    """Two levels, as min() of a text cannot be hash-aggregated.

    The first level has the names among its keys and only numbers to fold, so
    it hashes without sorting the plays; the second picks one name per track
    from the few spellings left.  min() stands in for "any value": the same
    answer on every run.
    """
    spelled = (
        named(plays, "track_uri")
        .groupBy("track_uri", "track_name", "artist_name", "album_name")
        .agg(
            F.min("ts_utc").alias("first_played"),
            F.max("ts_utc").alias("last_played"),
            F.count(F.lit(1)).alias("play_count"),
            F.sum("ms_played").alias("total_ms"),
        )
    )
    return spelled.groupBy("track_uri").agg(
        F.min("track_name").alias("track_name"),
        F.min("artist_name").alias("artist_name"),
        F.min("album_name").alias("album_name"),
        F.min("first_played").alias("first_played"),
        F.max("last_played").alias("last_played"),
        F.sum("play_count").alias("play_count"),
        F.sum("total_ms").alias("total_ms"),
    )


def dim_artist(plays: DataFrame) -> DataFrame:
    """Two levels: per (artist, track) first, then per artist.

    A hot artist's plays are folded per track on the map side; only one row per
    track travels to the artist's task.
    """
    per_track = (
        named(plays, "artist_name")
        .groupBy("artist_name", "track_uri")
        .agg(
            F.min("ts_utc").alias("first_played"),
            F.max("ts_utc").alias("last_played"),
            F.count(F.lit(1)).alias("play_count"),
            F.sum("ms_played").alias("total_ms"),
        )
    )
    return per_track.groupBy("artist_name").agg(
        F.min("first_played").alias("first_played"),
        F.max("last_played").alias("last_played"),
        F.sum("play_count").alias("play_count"),
        F.sum("total_ms").alias("total_ms"),
        F.count("track_uri").alias("distinct_tracks"),
    )


def monthly_artist(plays: DataFrame) -> DataFrame:
    """Artist x month with the artist's share of that month's named plays.

    The month totals are joined in instead of a window per month: a window
    would sort all artists of a month in one task.  The totals are at most one
    row per calendar month of the DATE type (about 120,000 rows, 3 MB), which
    bounds the broadcast whatever the data size.
    """
    plays = named(plays, "artist_name")
    per_artist = plays.groupBy("played_month", "artist_name").agg(
        F.count(F.lit(1)).alias("plays"), F.sum("ms_played").alias("ms")
    )
    per_month = per_artist.groupBy("played_month").agg(F.sum("plays").alias("_month_plays"))
    totals = per_month.withColumnRenamed("played_month", "_month")
    same_month = F.col("played_month").eqNullSafe(F.col("_month"))
    return per_artist.join(F.broadcast(totals), same_month).select(
        "played_month",
        "artist_name",
        "plays",
        "ms",
        (F.col("plays") / F.col("_month_plays")).alias("share_of_month"),
    )


def hourly(plays: DataFrame) -> DataFrame:
    return plays.groupBy("played_hour", "played_dow").agg(
        F.count(F.lit(1)).alias("plays"), F.sum("ms_played").alias("ms")
    )


def skip(plays: DataFrame) -> DataFrame:
    """Per (artist, track); a NULL track is a group of its own.  Two levels, as in `dim_track`."""
    spelled = (
        named(plays, "artist_name")
        .groupBy("artist_name", "track_uri", "track_name")
        .agg(
            F.count(F.lit(1)).alias("plays"),
            times("is_skip").alias("derived_skips"),
            times("skipped_raw").alias("raw_skipped_count"),
            F.sum("ms_played").alias("ms"),
            F.count("ms_played").alias("timed"),
        )
    )
    total = F.sum("plays")
    return spelled.groupBy("artist_name", "track_uri").agg(
        F.min("track_name").alias("track_name"),
        total.alias("plays"),
        F.sum("derived_skips").alias("derived_skips"),
        (F.sum("derived_skips") / total).alias("derived_skip_rate"),
        F.sum("raw_skipped_count").alias("raw_skipped_count"),
        (F.sum("ms") / F.nullif(F.sum("timed"), F.lit(0))).alias("avg_ms_played"),
    )


VIEWS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "dim_track": dim_track,
    "dim_artist": dim_artist,
    "v_monthly_artist": monthly_artist,
    "v_hourly": hourly,
    "v_skip": skip,
}


def publish_views(plays: DataFrame) -> list[str]:
    """Register `plays` and its views as temporary views; nothing is computed or cached."""
    plays.createOrReplaceTempView("plays")
    for name, view in VIEWS.items():
        view(plays).createOrReplaceTempView(name)
    return ["plays", *VIEWS]
