"""Properties that hold for any history, checked on two sizes."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from spinlog.operators.plays import with_play_id
from spinlog.operators.predicates import date_range
from spinlog.plans import queries as Q
from spinlog.plans import views as V
from spinlog.sources.testtables import SOURCE_ORDER, play_fields, plays_from_lineitem, table


@pytest.fixture(scope="module", params=["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def plays(request, spark):
    return plays_from_lineitem(spark, request.param)


def test_buckets_add_up(plays):
    total = plays.count()
    for by in ("hour", "dow", "hour_dow"):
        assert Q.listening_by_hour(plays, by=by).agg(F.sum("plays")).first()[0] == total
    assert Q.skip_stats(plays, "month", 1, 1000).agg(F.sum("plays")).first()[0] == total
    assert V.hourly(plays).agg(F.sum("plays")).first()[0] == total
    named = plays.where("artist_name is not null").count()
    for view in (V.skip, V.monthly_artist):
        assert view(plays).agg(F.sum("plays")).first()[0] == named


def test_shares_of_a_month_add_up_to_one(plays):
    sums = V.monthly_artist(plays).groupBy("played_month").agg(F.sum("share_of_month").alias("s"))
    assert sums.where("abs(s - 1) > 1e-9").count() == 0


def test_min_plays_filters(plays):
    for group in ("artist", "track", "month"):
        assert Q.skip_stats(plays, group, 7, 10_000).where("plays < 7").count() == 0


def test_drift_labels_are_disjoint_and_ranked(plays):
    rows = Q.taste_drift(plays, "1996-01-15", "1996-06-30", "2001-01-01", "2001-06-30", limit=10_000).collect()
    assert len({r.artist_name for r in rows}) == len(rows)
    for r in rows:
        assert {"gained": r.period_a_plays == 0, "lost": r.period_b_plays == 0,
                "held": r.period_a_plays > 0 and r.period_b_plays > 0}[r.drift]
    for label, key in (("gained", lambda r: r.period_b_plays), ("held", lambda r: abs(r.share_delta))):
        ranked = [key(r) for r in sorted((r for r in rows if r.drift == label), key=lambda r: r["rank"])]
        assert ranked == sorted(ranked, reverse=True)


def test_drift_counts_months_by_their_first_day(plays):
    months = Q.taste_drift(plays, "1996-01-15", "1996-01-31", "1996-02-01", "1996-02-01", limit=10)
    assert months.where("period_a_plays > 0").count() == 0 and months.where("period_b_plays > 0").count() > 0


def test_rediscovered_tracks_were_not_heard_lately(plays):
    found = Q.rediscover_tracks(plays, "1995-01-01", "1996-12-31", 6, 2, 10_000)
    latest = plays.agg(F.max("ts_utc")).first()[0]
    lately = date_range(plays, (latest - dt.timedelta(days=180)).date(), None)
    assert found.join(lately, "track_uri").count() == 0


def test_wrong_arguments(plays):
    for call in (lambda: Q.listening_by_hour(plays, by="week"), lambda: Q.skip_stats(plays, "album"),
                 lambda: Q.top_local(plays, "genre"), lambda: Q.top_local(plays, metric="likes")):
        with pytest.raises(ValueError, match="must be one of"):
            call()


def test_sketches_come_close(plays):
    exact, near = Q.listening_summary(plays).first(), Q.listening_summary(plays, approximate=True).first()
    assert abs(near.distinct_tracks / exact.distinct_tracks - 1) < 0.15 and near.total_plays == exact.total_plays


def test_ids_are_dense_with_one_moment_holding_a_third(spark):
    fields = play_fields(table(spark, "/root/testdata/sf0.001", "lineitem")).select("ts_utc", "track_uri", *SOURCE_ORDER)
    hot = fields.withColumn("ts_utc", F.when(F.col("l_orderkey") % 3 == 0, F.lit("2000-01-01").cast("timestamp_ntz")).otherwise(F.col("ts_utc")))
    rows = with_play_id(hot, SOURCE_ORDER).orderBy("play_id").select("play_id", "ts_utc").collect()
    assert [r.play_id for r in rows] == list(range(1, len(rows) + 1))
    assert all(a.ts_utc <= b.ts_utc for a, b in zip(rows, rows[1:]))
