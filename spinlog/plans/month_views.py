"""Month totals that can be added up, and the derived views made of them.

A row of the totals folds the plays of one track, as it is spelled, in one month.  They are
written with the month they fold, so a refresh reads the months it touches and no others; the
views then read totals instead of plays, and give what `views` gives.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spinlog.operators.predicates import named
from spinlog.plans.views import times

KEYS = ["utc_month", "played_month", "artist_name", "album_name", "track_uri", "track_name"]


def month_totals(plays: DataFrame) -> DataFrame:
    """Plays with a track or an artist, by month and spelling: what the four views add up, count or compare."""
    kept = plays.where(F.col("track_uri").isNotNull() | F.col("artist_name").isNotNull())
    return kept.groupBy(*KEYS).agg(
        F.min("ts_utc").alias("first_played"),
        F.max("ts_utc").alias("last_played"),
        F.count(F.lit(1)).alias("plays"),
        F.sum("ms_played").alias("ms"),
        F.count("ms_played").alias("timed"),
        times("is_skip").alias("derived_skips"),
        times("skipped_raw").alias("raw_skips"),
    )


def _span(totals: DataFrame, *keys: str) -> DataFrame:
    """First and last play, number of plays and time per key; the numbers of few spellings per track travel."""
    return totals.groupBy(*keys).agg(
        F.min("first_played").alias("first_played"),
        F.max("last_played").alias("last_played"),
        F.sum("plays").alias("play_count"),
        F.sum("ms").alias("total_ms"),
    )


def dim_track(totals: DataFrame) -> DataFrame:
    spelled = _span(named(totals, "track_uri"), "track_uri", "track_name", "artist_name", "album_name")
    names = [F.min(c).alias(c) for c in ("track_name", "artist_name", "album_name")]
    return spelled.groupBy("track_uri").agg(
        *names, F.min("first_played").alias("first_played"), F.max("last_played").alias("last_played"),
        F.sum("play_count").alias("play_count"), F.sum("total_ms").alias("total_ms"))


def dim_artist(totals: DataFrame) -> DataFrame:
    per_track = _span(named(totals, "artist_name"), "artist_name", "track_uri")
    return per_track.groupBy("artist_name").agg(
        F.min("first_played").alias("first_played"), F.max("last_played").alias("last_played"),
        F.sum("play_count").alias("play_count"), F.sum("total_ms").alias("total_ms"),
        F.count("track_uri").alias("distinct_tracks"))


def monthly_artist(totals: DataFrame) -> DataFrame:
    per_artist = named(totals, "artist_name").groupBy("played_month", "artist_name").agg(
        F.sum("plays").alias("plays"), F.sum("ms").alias("ms"))
    # One row per month of the DATE type at most, as in `views`.
    whole = per_artist.groupBy(F.col("played_month").alias("_month")).agg(F.sum("plays").alias("_all"))
    return per_artist.join(F.broadcast(whole), F.col("played_month").eqNullSafe(F.col("_month"))).select(
        "played_month", "artist_name", "plays", "ms", (F.col("plays") / F.col("_all")).alias("share_of_month"))


def skip(totals: DataFrame) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("plays", "derived_skips", "raw_skips", "ms", "timed")]
    spelled = named(totals, "artist_name").groupBy("artist_name", "track_uri", "track_name").agg(*sums)
    added = spelled.groupBy("artist_name", "track_uri").agg(F.min("track_name").alias("track_name"), *sums)
    return added.select(
        "artist_name", "track_uri", "track_name", "plays", "derived_skips",
        (F.col("derived_skips") / F.col("plays")).alias("derived_skip_rate"), F.col("raw_skips").alias("raw_skipped_count"),
        (F.col("ms") / F.nullif(F.col("timed"), F.lit(0))).alias("avg_ms_played"))


MONTH_VIEWS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "dim_track": dim_track,
    "dim_artist": dim_artist,
    "v_monthly_artist": monthly_artist,
    "v_skip": skip,
}
