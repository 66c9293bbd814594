"""Fact table, views and named questions over `lineitem` read as plays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry import Area
from spinlog.operators import plays as P
from spinlog.operators import predicates, topk
from spinlog.plans import queries as Q
from spinlog.plans import views as V
from spinlog.sources.testtables import SOURCE_ORDER, play_fields, plays_from_lineitem, table

AREA = Area()

PLAYS_CTE = """
with fields as (
  select l_shipdate + to_hours(cast(l_orderkey % 24 as integer)) as ts_utc,
    cast(l_quantity * 5000 as bigint) as ms_played,
    case when l_linenumber < 7 then 'track ' || l_linenumber end as track_name,
    case when l_linenumber < 7 then 'artist_' || l_partkey end as artist_name,
    case when l_linenumber < 7 then 'album_' || l_suppkey end as album_name,
    case when l_linenumber < 7 then 'app:track:' || l_partkey || '_' || l_linenumber end as track_uri,
    case when l_linenumber = 7 then 'app:episode:' || l_partkey end as episode_uri,
    case l_returnflag when 'R' then 'fwdbtn' when 'A' then 'trackdone' end as reason_end,
    case when l_linestatus = 'F' then l_tax > 0.04 end as skipped_raw,
    l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
    l_returnflag, l_linestatus
  from lineitem
), zoned as (
  select *, ts_utc at time zone 'UTC' at time zone 'Europe/Zagreb' as ts_local from fields
), plays as (
  select *,
    case when track_uri is not null then split_part(track_uri, ':', 3) end as track_id,
    case when track_uri is not null then 'music' when episode_uri is not null then 'podcast'
         else 'unknown' end as content_type,
    cast(ts_local as date) as played_date,
    cast(extract(year from ts_local) as smallint) as played_year,
    cast(date_trunc('month', ts_local) as date) as played_month,
    cast(extract(hour from ts_local) as tinyint) as played_hour,
    cast(isodow(ts_local) as tinyint) as played_dow,
    (reason_end = 'fwdbtn' and ms_played < 30000) as is_skip,
    (ms_played >= 30000) as is_substantial
  from zoned
), dim_track as (
  select track_uri, min(track_name) as track_name, min(artist_name) as artist_name,
    min(album_name) as album_name, min(ts_utc) as first_played, max(ts_utc) as last_played,
    count(*) as play_count, cast(sum(ms_played) as bigint) as total_ms
  from plays where track_uri is not null group by track_uri
), dim_artist as (
  select artist_name, min(ts_utc) as first_played, max(ts_utc) as last_played,
    count(*) as play_count, cast(sum(ms_played) as bigint) as total_ms,
    count(distinct track_uri) as distinct_tracks
  from plays where artist_name is not null group by artist_name
), v_monthly_artist as (
  select played_month, artist_name, count(*) as plays, cast(sum(ms_played) as bigint) as ms,
    cast(count(*) as double) / cast(sum(count(*)) over (partition by played_month) as double)
      as share_of_month
  from plays where artist_name is not null group by played_month, artist_name
), v_hourly as (
  select played_hour, played_dow, count(*) as plays, cast(sum(ms_played) as bigint) as ms
  from plays group by played_hour, played_dow
), v_skip as (
  select artist_name, track_uri, min(track_name) as track_name, count(*) as plays,
    cast(sum(case when is_skip then 1 else 0 end) as bigint) as derived_skips,
    avg(case when is_skip then cast(1 as double) else cast(0 as double) end) as derived_skip_rate,
    cast(sum(case when skipped_raw then 1 else 0 end) as bigint) as raw_skipped_count,
    avg(cast(ms_played as double)) as avg_ms_played
  from plays where artist_name is not null group by artist_name, track_uri
)
"""


def over_plays(query):
    return lambda spark, sf_dir: query(plays_from_lineitem(spark, sf_dir))


def add(name, query, select):
    AREA.add(name, over_plays(query), PLAYS_CTE + select)


# --- projections, predicates ------------------------------------------------------------------

KEEP = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
KEEP_SQL = ", ".join(KEEP)

add("plays_tz_local", lambda p: p.select(*KEEP, "ts_utc", "ts_local"),
    f"select {KEEP_SQL}, ts_utc, ts_local from plays")
add("plays_calendar",
    lambda p: p.select(*KEEP, "played_date", "played_year", "played_month", "played_hour", "played_dow"),
    f"select {KEEP_SQL}, played_date, played_year, played_month, played_hour, played_dow from plays")
add("plays_content_type", lambda p: p.groupBy("content_type").agg(Q.plays_count()),
    "select content_type, count(*) as plays from plays group by content_type")
add("plays_flags", lambda p: p.select(*KEEP, "is_skip", "is_substantial"),
    f"select {KEEP_SQL}, is_skip, is_substantial from plays")
add("plays_track_id", lambda p: p.select(*KEEP, "track_id"), f"select {KEEP_SQL}, track_id from plays")
add("pred_date_range",
    lambda p: predicates.date_range(p, "1997-03-05", "1998-10-20").select(*KEEP, "played_date"),
    f"select {KEEP_SQL}, played_date from plays "
    "where played_date >= date '1997-03-05' and played_date <= date '1998-10-20'")
add("pred_date_range_open",
    lambda p: predicates.date_range(p, "2000-01-01", None).agg(Q.plays_count()),
    "select count(*) as plays from plays where played_date >= date '2000-01-01'")
add("pred_not_null_entity",
    lambda p: predicates.named(p, "album_name").groupBy("album_name").agg(Q.plays_count()),
    "select album_name, count(*) as plays from plays where album_name is not null group by album_name")
SILENT = " < (select max(ts_utc) from plays) - to_months({n})"
add("pred_silent_since",
    lambda p: V.dim_track(p).where(predicates.silent_since(p, "last_played", 14)).select("track_uri", "last_played"),
    "select track_uri, last_played from dim_track where last_played" + SILENT.format(n=14))
add("join_scalar_broadcast",
    lambda p: V.dim_artist(p).where(predicates.silent_since(p, "last_played", 1)).select("artist_name", "last_played"),
    "select artist_name, last_played from dim_artist where last_played" + SILENT.format(n=1))

# --- numbering, copies -------------------------------------------------------------------------

ORDER_SQL = ", ".join(SOURCE_ORDER)


def with_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = play_fields(table(spark, sf_dir, "lineitem")).select("ts_utc", "track_uri", *SOURCE_ORDER)
    return P.with_play_id(fields, SOURCE_ORDER)


NUMBERED = (
    "select play_id, ts_utc, track_uri, l_orderkey, l_linenumber from (select *, row_number() over "
    f"(order by ts_utc, track_uri nulls last, {ORDER_SQL}) as play_id from plays)"
)
AREA.add(
    "plays_play_id",
    lambda s, d: with_ids(s, d).select("play_id", "ts_utc", "track_uri", "l_orderkey", "l_linenumber"),
    PLAYS_CTE + NUMBERED,
)
AREA.add(
    "win_global_row_number",
    lambda s, d: with_ids(s, d).agg(
        F.min("play_id").alias("first_id"), F.max("play_id").alias("last_id"),
        F.countDistinct("play_id").alias("ids"),
    ),
    "select cast(min(1) as bigint) as first_id, count(*) as last_id, count(*) as ids from lineitem",
)


def deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of one (URI, hour, ms) are copies; files are the suppliers."""
    fields = play_fields(table(spark, sf_dir, "lineitem"))
    keyed = fields.withColumns({
        "source_file": F.concat(F.lit("f"), F.lpad(F.col("l_suppkey").cast("string"), 12, "0")),
        "track_uri": F.when(F.col("l_linenumber") <= 3, F.concat(F.lit("app:track:"), F.col("l_partkey"))),
        "episode_uri": F.when(F.col("l_linenumber").between(4, 5), F.concat(F.lit("app:episode:"), F.col("l_partkey"))),
        "ts_utc": F.date_trunc("year", "ts_utc").cast("timestamp_ntz"),
        "ms_played": F.when(F.col("ms_played") > 100000, F.lit(None)).otherwise(F.col("ms_played")),
    })
    order = ["source_file", *SOURCE_ORDER]
    rows = keyed.select("ts_utc", "ms_played", "track_uri", "episode_uri", *order)
    return P.drop_repeats(rows, order)


DEDUP_SQL = f"""
with keyed as (
  select 'f' || lpad(cast(l_suppkey as varchar), 12, '0') as source_file,
    case when l_linenumber <= 3 then 'app:track:' || l_partkey end as track_uri,
    case when l_linenumber between 4 and 5 then 'app:episode:' || l_partkey end as episode_uri,
    cast(date_trunc('year', l_shipdate + to_hours(cast(l_orderkey % 24 as integer))) as timestamp) as ts_utc,
    case when l_quantity * 5000 > 100000 then null else cast(l_quantity * 5000 as bigint) end as ms_played,
    {ORDER_SQL} from lineitem
), ranked as (
  select *, case when coalesce(track_uri, episode_uri) is not null then row_number() over (
    partition by coalesce(track_uri, episode_uri), ts_utc, ms_played order by source_file, {ORDER_SQL})
    else 1 end as rn from keyed
)
select ts_utc, ms_played, track_uri, episode_uri, source_file, {ORDER_SQL} from ranked where rn = 1
"""
AREA.add("plays_dedup", deduped, DEDUP_SQL)
AREA.add(
    "win_row_number_dedup",
    lambda s, d: deduped(s, d).groupBy("source_file").agg(Q.plays_count()),
    DEDUP_SQL.replace(f"select ts_utc, ms_played, track_uri, episode_uri, source_file, {ORDER_SQL} from ranked where rn = 1",
                      "select source_file, count(*) as plays from ranked where rn = 1 group by source_file"),
)

# --- views ---------------------------------------------------------------------------------------

for name in ("dim_track", "dim_artist", "v_monthly_artist", "v_hourly", "v_skip"):
    key = "view_" + name.removeprefix("v_")
    add(key, V.VIEWS[name], f"select * from {name}")

add("win_share_of_partition",
    lambda p: V.monthly_artist(p).select("played_month", "artist_name", "share_of_month"),
    "select played_month, artist_name, share_of_month from v_monthly_artist")
add("win_share_of_total",
    lambda p: (lambda per: per.select("artist_name", "plays", (F.col("plays") / per.agg(F.sum("plays")).scalar()).alias("share")))(
        predicates.named(p, "artist_name").groupBy("artist_name").agg(Q.plays_count())),
    "select artist_name, plays, cast(plays as double) / cast(sum(plays) over () as double) as share from "
    "(select artist_name, count(*) as plays from plays where artist_name is not null group by artist_name)")

# --- named questions -----------------------------------------------------------------------------

SUMMARY = """select count(*) as total_plays, count(distinct track_uri) as distinct_tracks,
 count(distinct artist_name) as distinct_artists,
 cast(sum(ms_played) as double) / cast(3600000 as double) as total_hours,
 min(played_date) as earliest_play, max(played_date) as latest_play,
 avg(case when is_skip then cast(1 as double) else cast(0 as double) end) as overall_skip_rate
 from plays """
add("q_listening_summary", Q.listening_summary, SUMMARY)
add("q_listening_summary_range", lambda p: Q.listening_summary(p, "1996-02-10", "1999-07-31"),
    SUMMARY + "where played_date >= date '1996-02-10' and played_date <= date '1999-07-31'")
add("q_listening_summary_empty", lambda p: Q.listening_summary(p, "2090-01-01", None),
    SUMMARY + "where played_date >= date '2090-01-01'")

HOURS = "cast(sum(ms_played) as double) / cast(3600000 as double) as hours"
for by, cols in {"hour": "played_hour", "dow": "played_dow", "hour_dow": "played_hour, played_dow"}.items():
    add(f"q_by_{by}", lambda p, by=by: Q.listening_by_hour(p, "1996-01-01", None, by),
        f"select {cols}, count(*) as plays, {HOURS} from plays "
        f"where played_date >= date '1996-01-01' group by {cols} order by {cols}")
add("sort_buckets", lambda p: Q.listening_by_hour(p, by="hour_dow"),
    f"select played_hour, played_dow, count(*) as plays, {HOURS} from plays "
    "group by played_hour, played_dow order by played_hour, played_dow")

add("q_skip_artist", lambda p: Q.skip_stats(p, "artist", 5, 20),
    "select artist_name, cast(sum(plays) as bigint) as plays, cast(sum(derived_skips) as bigint) as derived_skips, "
    "cast(sum(derived_skips) as double) / sum(plays) as derived_skip_rate, "
    "cast(sum(raw_skipped_count) as double) / sum(plays) as raw_skipped_rate from v_skip group by artist_name "
    "having sum(plays) >= 5 order by derived_skip_rate desc, plays desc, artist_name limit 20")
add("q_skip_track", lambda p: Q.skip_stats(p, "track", 5, 50),
    "select artist_name, track_name, track_uri, plays, derived_skips, derived_skip_rate, "
    "cast(raw_skipped_count as double) / plays as raw_skipped_rate from v_skip where plays >= 5 "
    "order by derived_skip_rate desc, plays desc, artist_name, track_uri nulls last limit 50")
add("q_skip_month", lambda p: Q.skip_stats(p, "month", 5, 200),
    "select played_month, count(*) as plays, cast(sum(case when is_skip then 1 else 0 end) as bigint) as derived_skips, "
    "avg(case when is_skip then cast(1 as double) else cast(0 as double) end) as derived_skip_rate "
    "from plays group by played_month having count(*) >= 5 order by played_month limit 200")

for entity, col in {"artist": "artist_name", "track": "track_uri", "album": "album_name"}.items():
    for metric, expr in {"plays": "count(*)", "ms": "sum(ms_played)"}.items():
        extra = ", min(track_name) as track_name" if entity == "track" else ""
        add(f"q_top_{entity}_{metric}",
            lambda p, e=entity, m=metric: Q.top_local(p, e, "1996-01-01", "2000-12-31", m, 25),
            f"select {col} as entity, min(artist_name) as artist_name{extra}, count(*) as plays, {HOURS} "
            "from plays where played_date >= date '1996-01-01' and played_date <= date '2000-12-31' "
            f"and {col} is not null group by {col} order by {expr} desc, {col} limit 25")
add("topk_order_limit", lambda p: topk.top(V.dim_track(p).select("track_uri", "total_ms"),
                                           [F.col("total_ms").desc_nulls_last(), F.col("track_uri").asc()], 100),
    "select track_uri, total_ms from dim_track order by total_ms desc nulls last, track_uri limit 100")

DRIFT = ("1996-01-15", "1996-06-30", "2001-01-01", "2001-06-30")
DRIFT_SQL = """
, a as (select artist_name, count(*) as n from plays where artist_name is not null and
   played_month >= date '1996-01-15' and played_month <= date '1996-06-30' group by artist_name)
, b as (select artist_name, count(*) as n from plays where artist_name is not null and
   played_month >= date '2001-01-01' and played_month <= date '2001-06-30' group by artist_name)
, sa as (select artist_name, n, cast(n as double) / cast(sum(n) over () as double) as share from a)
, sb as (select artist_name, n, cast(n as double) / cast(sum(n) over () as double) as share from b)
, j as (select artist_name,
   case when sa.n is null then 'gained' when sb.n is null then 'lost' else 'held' end as drift,
   coalesce(sa.n, 0) as period_a_plays, coalesce(sa.share, cast(0 as double)) as period_a_share,
   coalesce(sb.n, 0) as period_b_plays, coalesce(sb.share, cast(0 as double)) as period_b_share,
   coalesce(sb.share, cast(0 as double)) - coalesce(sa.share, cast(0 as double)) as share_delta
  from sa full outer join sb using (artist_name))
, r as (select *, cast(row_number() over (partition by drift order by case drift when 'gained' then
   cast(period_b_plays as double) when 'lost' then cast(period_a_plays as double) else abs(share_delta) end desc,
   artist_name) as integer) as rank from j)
select * from r where rank <= {n}
"""
add("q_taste_drift", lambda p: Q.taste_drift(p, *DRIFT, limit=20), DRIFT_SQL.format(n=20))
add("join_period_outer", lambda p: Q.taste_drift_outer(p, *DRIFT, limit=100), DRIFT_SQL.format(n=100))
add("win_top_per_label", lambda p: Q.taste_drift(p, *DRIFT, limit=3000), DRIFT_SQL.format(n=3000))
add("set_union_keys",
    lambda p: Q.period_artists(p, *DRIFT),
    DRIFT_SQL.format(n=1 << 30).replace("select * from r", "select artist_name from r"))

add("q_dropped_artists", lambda p: Q.dropped_artists(p, 6, 10, 20),
    "select artist_name, play_count, first_played, last_played from dim_artist where play_count >= 10 "
    "and last_played" + SILENT.format(n=6) + " order by play_count desc, artist_name limit 20")
add("q_rediscover_tracks", lambda p: Q.rediscover_tracks(p, "1995-01-01", "1996-12-31", 6, 2, 40),
    "select track_uri, track_name, artist_name, play_count, first_played, last_played from dim_track "
    "where first_played >= date '1995-01-01' and first_played <= date '1996-12-31' and play_count >= 2 "
    "and last_played" + SILENT.format(n=6) + " order by play_count desc, track_uri limit 40")
add("q_store_status", Q.store_status,
    "select true as present, count(*) as total_plays, min(played_date) as earliest_play, "
    "max(played_date) as latest_play from plays")
add("q_dow_recent", lambda p: Q.plays_by_weekday_since(p, "2001-10-01", 90),
    "select played_dow, count(*) as plays from plays where played_date >= date '2001-10-01' - 90 "
    "group by played_dow order by played_dow")
add("q_most_skipped_tracks", Q.most_skipped_tracks,
    "select artist_name, track_name, track_uri, plays, derived_skip_rate from v_skip where plays >= 5 "
    "order by derived_skip_rate desc, artist_name, track_uri nulls last limit 20")
