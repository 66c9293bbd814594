"""The named questions over `plays`.  Each returns a DataFrame; callers collect."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spinlog.operators.predicates import as_date, date_range, named, one_of, silent_since
from spinlog.operators.topk import top, top_per_label
from spinlog.plans import views

Day = str | dt.date | None

_MS_PER_HOUR = 3_600_000.0
DRIFT_LABELS = ["gained", "lost", "held"]


def hours(ms: Column) -> Column:
    return ms / F.lit(_MS_PER_HOUR)


def plays_count() -> Column:
    return F.count(F.lit(1)).alias("plays")


def listening_summary(plays: DataFrame, start: Day = None, end: Day = None, *,
                      approximate: bool = False) -> DataFrame:
    """One row of totals.  `approximate` swaps the exact distinct counts for sketches.

    The exact form folds the rows per (artist, track) first, so the two distinct
    counts expand that much smaller set instead of every play.
    """
    inside = date_range(plays, start, end)
    if approximate:
        return inside.agg(
            F.count(F.lit(1)).alias("total_plays"),
            F.approx_count_distinct("track_uri").alias("distinct_tracks"),
            F.approx_count_distinct("artist_name").alias("distinct_artists"),
            hours(F.sum("ms_played")).alias("total_hours"),
            F.min("played_date").alias("earliest_play"),
            F.max("played_date").alias("latest_play"),
            views.rate("is_skip").alias("overall_skip_rate"),
        )
    folded = inside.groupBy("artist_name", "track_uri").agg(
        F.count(F.lit(1)).alias("n"), F.sum("ms_played").alias("ms"),
        F.min("played_date").alias("first"), F.max("played_date").alias("last"),
        views.times("is_skip").alias("skips"),
    )
    total = F.sum("n")
    return folded.agg(
        F.coalesce(total, F.lit(0)).alias("total_plays"),
        F.countDistinct("track_uri").alias("distinct_tracks"),
        F.countDistinct("artist_name").alias("distinct_artists"),
        hours(F.sum("ms")).alias("total_hours"),
        F.min("first").alias("earliest_play"),
        F.max("last").alias("latest_play"),
        (F.sum("skips") / total).alias("overall_skip_rate"),
    )


def listening_by_hour(plays: DataFrame, start: Day = None, end: Day = None,
                      by: str = "hour_dow") -> DataFrame:
    columns = {
        "hour": ["played_hour"],
        "dow": ["played_dow"],
        "hour_dow": ["played_hour", "played_dow"],
    }[one_of("by", by, ("hour", "dow", "hour_dow"))]
    return (
        date_range(plays, start, end)
        .groupBy(*columns)
        .agg(plays_count(), hours(F.sum("ms_played")).alias("hours"))
        .orderBy(*[F.col(c).asc_nulls_last() for c in columns])
    )


def skip_stats(plays: DataFrame, group_by: str = "artist", min_plays: int = 5,
               limit: int = 20) -> DataFrame:
    one_of("group_by", group_by, ("artist", "track", "month"))
    if group_by == "month":
        per_month = plays.groupBy("played_month").agg(
            plays_count(),
            views.times("is_skip").alias("derived_skips"),
            views.rate("is_skip").alias("derived_skip_rate"),
        )
        return top(per_month.where(F.col("plays") >= min_plays),
                   [F.col("played_month").asc_nulls_last()], limit)

    per_track = views.skip(plays)
    plays_, skips, raw = (F.col(c) for c in ("plays", "derived_skips", "raw_skipped_count"))
    worst = [F.col("derived_skip_rate").desc_nulls_last(), plays_.desc()]
    if group_by == "track":
        rows = per_track.where(plays_ >= min_plays).select(
            "artist_name", "track_name", "track_uri", "plays", "derived_skips",
            "derived_skip_rate", (raw / F.nullif(plays_, F.lit(0))).alias("raw_skipped_rate"),
        )
        ties = [F.col("artist_name").asc(), F.col("track_uri").asc_nulls_last()]
        return top(rows, [*worst, *ties], limit)

    per_artist = per_track.groupBy("artist_name").agg(
        F.sum("plays").alias("plays"),
        F.sum("derived_skips").alias("derived_skips"),
        F.sum("raw_skipped_count").alias("raw_skipped_count"),
    )
    total = F.nullif(plays_, F.lit(0))
    rows = per_artist.where(plays_ >= min_plays).select(
        "artist_name", "plays", "derived_skips",
        (skips / total).alias("derived_skip_rate"), (raw / total).alias("raw_skipped_rate"),
    )
    return top(rows, [*worst, F.col("artist_name").asc()], limit)


def top_local(plays: DataFrame, entity: str = "artist", start: Day = None, end: Day = None,
              metric: str = "plays", limit: int = 20) -> DataFrame:
    key = {"artist": "artist_name", "track": "track_uri", "album": "album_name"}[
        one_of("entity", entity, ("artist", "track", "album"))
    ]
    one_of("metric", metric, ("plays", "ms"))
    # Names are keys of a first fold, not text minima over all plays (see views.dim_track).
    names = {"artist": [], "track": ["artist_name", "track_name"], "album": ["artist_name"]}[entity]
    inside = named(date_range(plays, start, end), key).withColumn("entity", F.col(key))
    ranked = inside.groupBy("entity", *names).agg(plays_count(), F.sum("ms_played").alias("ms"))
    if names:
        ranked = ranked.groupBy("entity").agg(
            *[F.min(n).alias(n) for n in names], F.sum("plays").alias("plays"), F.sum("ms").alias("ms")
        )
    else:
        ranked = ranked.withColumn("artist_name", F.col("entity"))
    order = [F.col(metric).desc_nulls_last(), F.col("entity").asc()]
    return top(ranked, order, limit).select("entity", "artist_name", *names[1:], "plays",
                                            hours(F.col("ms")).alias("hours"))


def taste_drift(plays: DataFrame, period_a_start: Day, period_a_end: Day, period_b_start: Day,
                period_b_end: Day, limit: int = 20) -> DataFrame:
    """Artists gained, lost or held between two periods, ranked inside each label.

    A month belongs to a period when its first day does.  Both periods come
    from one scan and one shuffle: a conditional count per artist replaces a
    full outer join of two aggregates.
    """
    month = F.col("played_month")
    in_a = month.between(as_date(period_a_start), as_date(period_a_end))
    in_b = month.between(as_date(period_b_start), as_date(period_b_end))
    relevant = named(plays, "artist_name").where(in_a | in_b)
    per_artist = relevant.groupBy("artist_name").agg(
        F.count_if(in_a).alias("period_a_plays"), F.count_if(in_b).alias("period_b_plays")
    )
    # The totals sum the same per-artist counts, so their shuffle is reused, not repeated.
    totals = per_artist.agg(F.struct(F.sum("period_a_plays").alias("a"), F.sum("period_b_plays").alias("b"))).scalar()
    return label_drift(per_artist, totals["a"], totals["b"], limit)


def taste_drift_outer(plays: DataFrame, period_a_start: Day, period_a_end: Day,
                      period_b_start: Day, period_b_end: Day, limit: int = 20) -> DataFrame:
    """The same answer by a full outer join, for periods kept in separate tables."""

    def period(start: Day, end: Day, name: str) -> DataFrame:
        inside = F.col("played_month").between(as_date(start), as_date(end))
        return (
            named(plays, "artist_name").where(inside).groupBy("artist_name")
            .agg(F.count(F.lit(1)).alias(name))
        )

    a = period(period_a_start, period_a_end, "period_a_plays")
    b = period(period_b_start, period_b_end, "period_b_plays")
    both = a.join(b, "artist_name", "full_outer").select(
        "artist_name",
        F.coalesce("period_a_plays", F.lit(0)).alias("period_a_plays"),
        F.coalesce("period_b_plays", F.lit(0)).alias("period_b_plays"),
    )
    total_a = a.agg(F.sum("period_a_plays")).scalar()
    total_b = b.agg(F.sum("period_b_plays")).scalar()
    return label_drift(both, total_a, total_b, limit)


def period_artists(plays: DataFrame, period_a_start: Day, period_a_end: Day, period_b_start: Day, period_b_end: Day) -> DataFrame:
    """Artists of either period."""
    keys = [named(plays, "artist_name").where(F.col("played_month").between(as_date(start), as_date(end))).select("artist_name")
            for start, end in ((period_a_start, period_a_end), (period_b_start, period_b_end))]
    return keys[0].union(keys[1]).distinct()


def label_drift(per_artist: DataFrame, total_a: Column, total_b: Column, limit: int) -> DataFrame:
    a, b = F.col("period_a_plays"), F.col("period_b_plays")
    shares = per_artist.select(
        "artist_name",
        F.when(a == 0, "gained").when(b == 0, "lost").otherwise("held").alias("drift"),
        a,
        F.when(a == 0, F.lit(0.0)).otherwise(a / total_a).alias("period_a_share"),
        b,
        F.when(b == 0, F.lit(0.0)).otherwise(b / total_b).alias("period_b_share"),
    ).withColumn("share_delta", F.col("period_b_share") - F.col("period_a_share"))
    weight = (
        F.when(F.col("drift") == "gained", b.cast("double"))
        .when(F.col("drift") == "lost", a.cast("double"))
        .otherwise(F.abs("share_delta"))
    )
    return top_per_label(shares, "drift", DRIFT_LABELS, [weight.desc(), F.col("artist_name").asc()], limit)


def dropped_artists(plays: DataFrame, silent_since_months: int = 6, min_plays: int = 10,
                    limit: int = 20) -> DataFrame:
    quiet = silent_since(plays, "last_played", silent_since_months)
    rows = views.dim_artist(plays).where((F.col("play_count") >= min_plays) & quiet)
    order = [F.col("play_count").desc(), F.col("artist_name").asc()]
    return top(rows.select("artist_name", "play_count", "first_played", "last_played"), order, limit)


def rediscover_tracks(plays: DataFrame, played_start: Day, played_end: Day,
                      not_since_months: int = 6, min_plays: int = 2, limit: int = 40) -> DataFrame:
    """Tracks *first* played in the window (UTC, the end day counts up to midnight only)."""
    first = F.col("first_played")
    opened = F.lit(as_date(played_start)).cast("timestamp_ntz")
    closed = F.lit(as_date(played_end)).cast("timestamp_ntz")
    rows = views.dim_track(plays).where(
        (first >= opened) & (first <= closed) & (F.col("play_count") >= min_plays)
        & silent_since(plays, "last_played", not_since_months)
    )
    order = [F.col("play_count").desc(), F.col("track_uri").asc()]
    return top(rows.select("track_uri", "track_name", "artist_name", "play_count",
                           "first_played", "last_played"), order, limit)


def store_status(plays: DataFrame | None, spark=None) -> DataFrame:
    """Presence, size and date span; `plays` is None when there is no store."""
    if plays is None:
        return spark.sql(
            "select false as present, cast(null as bigint) as total_plays, "
            "cast(null as date) as earliest_play, cast(null as date) as latest_play"
        )
    return plays.agg(
        F.lit(True).alias("present"),
        F.count(F.lit(1)).alias("total_plays"),
        F.min("played_date").alias("earliest_play"),
        F.max("played_date").alias("latest_play"),
    )


def plays_by_weekday_since(plays: DataFrame, as_of: Day, days: int = 90) -> DataFrame:
    start = as_date(as_of) - dt.timedelta(days=days)
    return (
        date_range(plays, start, None).groupBy("played_dow").agg(plays_count())
        .orderBy(F.col("played_dow").asc_nulls_last())
    )


def most_skipped_tracks(plays: DataFrame, min_plays: int = 5, limit: int = 20) -> DataFrame:
    rows = views.skip(plays).where(F.col("plays") >= min_plays)
    order = [F.col("derived_skip_rate").desc(), F.col("artist_name").asc(),
             F.col("track_uri").asc_nulls_last()]
    return top(rows.select("artist_name", "track_name", "track_uri", "plays", "derived_skip_rate"),
               order, limit)
