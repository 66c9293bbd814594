"""Text forms, matching and resolution over `part`, `conversations` and `documents`."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry import Area
from spinlog.functions import fuzzy, markers, text
from spinlog.operators import cache as C
from spinlog.operators import match
from spinlog.operators import resolve as R
from spinlog.operators.cache_store import CacheStore
from spinlog.plans.build_list import ordered_items
from spinlog.session import materialize, work_dir
from spinlog.sources.testtables import candidates, catalog_tracks, table

AREA = Area()
AS_OF = dt.datetime(2024, 6, 1)

NORM = "replace(lower(strip_accents({x})), 'ß', 'ss')"
NORM_TEXT = (
    "trim(regexp_replace(regexp_replace(regexp_replace(" + NORM
    + ", '^\\s+|\\s+$', '', 'g'), '^the\\s+', ''), '\\s+', ' ', 'g'))"
)


def norm_sql(x: str) -> str:
    return NORM_TEXT.format(x=x)


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


AREA.add(
    "res_normalize_text",
    lambda s, d: conversations(s, d).select("conv_id", "turn", text.normalize_text(F.col("text")).alias("norm")),
    f"select conv_id, turn, {norm_sql('text')} as norm from conversations",
)
AREA.add(
    "res_norm_key",
    lambda s, d: conversations(s, d).select(
        "conv_id", "turn", text.norm_key(F.col("role"), F.col("text")).alias("norm_key")),
    f"select conv_id, turn, lower(role) || '|' || {norm_sql('text')} as norm_key from conversations",
)

CATALOG_CTE = """
with cat as (
  select p_partkey as k, cast(p_partkey as varchar) as track_id, p_name || case p_partkey % 6 when 0 then ''
     when 1 then ' - Single Version' when 2 then ' (Remastered 2011)' when 3 then ' - Karaoke Version'
     when 4 then ' (Live)' else ' (Deluxe) - Remastered' end as name,
    'app:track:' || p_partkey as uri, p_name, p_brand,
    case when p_partkey % 10 = 7 then p_brand || ' Topic' else 'The ' || p_brand end as artist_name,
    case when p_partkey % 10 = 7 then lower(p_brand || ' Topic') else lower(p_brand) end as artist_norm,
    'ar' || p_brand as artist_id, 'guest ' || p_size as guest_norm, 'Guest ' || p_size as guest_name,
    'guest' || p_size as guest_id, 'XX' || lpad(cast(p_partkey as varchar), 10, '0') as isrc,
    cast(1960 + p_size as varchar) || '-01-01' as release, cast(1960 + p_size as varchar) as year,
    'Album ' || p_type as album_name, p_type, p_size
  from part
), forms as (
  select *, lower(name) as title_norm, lower(p_name) as stripped_norm,
    case p_partkey_mod when 3 then 'karaoke' when 4 then '(live)' end as marker from (select *, k % 6 as p_partkey_mod from cat)
), cand as (
  select upper(p_brand) as artist, title, min(p_partkey) as input_idx, lower(p_brand) as artist_norm,
    lower(title) as title_norm, 'ar' || p_brand as verified_id
  from (select *, case when p_partkey % 3 = 2 then 'Unheard ' || p_partkey else p_name end as title from part) group by p_brand, title
)
"""


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(match.catalog_index(catalog_tracks(spark, sf_dir)), "catalog")


AREA.add(
    "res_strip_suffix",
    lambda s, d: catalog_tracks(s, d).select("id", text.strip_suffixes(F.col("name")).alias("base")),
    "select cast(p_partkey as varchar) as id, p_name as base from part",
)


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.expr("concat(p_name, element_at(array('', ' (feat. ', ' featuring ', ' ft. '), cast(p_partkey % 4 as int) + 1),"
               " if(p_partkey % 4 = 0, '', concat(p_brand, if(p_partkey % 3 = 0, '', ' & Other, Third and  Fourth'))),"
               " if(p_partkey % 4 = 1, ')', ''))").alias("title"),
    )
    parts = named.select("p_partkey", text.featured(F.col("title")).alias("f"))
    return parts.select("p_partkey", "f.base", F.array_join("f.names", "|").alias("names"))


AREA.add("res_featured", featured, """
select p_partkey, p_name as base, case when p_partkey % 4 = 0 then '' when p_partkey % 3 = 0 then p_brand
  else p_brand || '|Other|Third|Fourth' end as names from part""")
AREA.add(
    "res_variant_marker",
    lambda s, d: index(s, d).where("artist_pos = 0").select(
        "track_id", markers.first_marker(F.col("title_norm"), F.lit("")).alias("marker"),
        markers.first_marker(F.col("title_norm"), F.lit("alive")).alias("marker_if_live")),
    CATALOG_CTE + "select track_id, marker, nullif(marker, '(live)') as marker_if_live from forms",
)

ALLOWED = "f.marker is null"
AREA.add(
    "join_candidate_artist",
    # Tracks are counted per artist first: the join never pairs candidates with single tracks.
    lambda s, d: match.wanted_keys(candidates(s, d)).join(
        index(s, d).groupBy("artist_norm").agg(F.count(F.lit(1)).alias("tracks")), "artist_norm"
    ).select("input_idx", "tracks"),
    CATALOG_CTE + "select input_idx, count(*) as tracks from cand join forms using (artist_norm) group by input_idx",
)
AREA.add(
    "join_verified_artist",
    lambda s, d: match.wanted_keys(candidates(s, d))
    .join(index(s, d).groupBy(F.lower(F.substring("artist_id", 3, 100)).alias("artist_norm"), "artist_id")
          .agg(F.count(F.lit(1)).alias("tracks")), "artist_norm").select("input_idx", "artist_id", "tracks"),
    CATALOG_CTE + "select input_idx, artist_id, count(*) as tracks from cand join forms on artist_id = verified_id "
    "group by input_idx, artist_id",
)
AREA.add(
    "res_match_artist",
    lambda s, d: index(s, d).groupBy("artist_norm", "track_id").agg(F.min("artist_pos").alias("artist_pos")),
    CATALOG_CTE + "select artist_norm, track_id, 0 as artist_pos from forms union all "
    "select guest_norm, track_id, 1 from forms",
)


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = match.wanted_keys(candidates(spark, sf_dir)).select(*match.WANTED).distinct()
    return wanted.withColumns({
        "artist_key": F.col("artist_norm"), "excused_title": markers.excused_mask(F.col("title_norm"))})


def tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.exact_and_strong(keyed(spark, sf_dir), index(spark, sf_dir), "artist_norm")


BEST_SQL = CATALOG_CTE + """
, scored as (
  select c.artist_norm, c.title_norm, f.track_id, f.release, f.uri, f.artist_id, f.artist_name, f.name,
    case when f.title_norm = c.title_norm then 3 when f.stripped_norm = c.title_norm then 2 end as tier
  from cand c join forms f on f.artist_norm = c.artist_norm
  where f.marker is null and c.title_norm in (f.title_norm, f.stripped_norm)
), best as (
  select *, row_number() over (partition by artist_norm, title_norm order by tier desc, release, track_id) as rn from scored
)
"""
AREA.add(
    "res_title_confidence",
    lambda s, d: tiers(s, d).select("artist_norm", "title_norm", match_name("tier", R.TIERS)),
    BEST_SQL + "select artist_norm, title_norm, case tier when 3 then 'exact' else 'strong' end as confidence from best where rn = 1",
)


def match_name(column: str, codes: dict[int, str]):
    return R.names_of(codes, column).alias("confidence")


AREA.add(
    "res_pick_best",
    lambda s, d: tiers(s, d).select("artist_norm", "title_norm", F.col("best.track_id").alias("track_id"),
                                    F.col("best.release").alias("release")),
    BEST_SQL + "select artist_norm, title_norm, track_id, release from best where rn = 1",
)
AREA.add(
    "win_best_match",
    lambda s, d: tiers(s, d).groupBy(F.col("best.track_id").alias("track_id")).agg(F.count(F.lit(1)).alias("picked")),
    BEST_SQL + "select track_id, count(*) as picked from best where rn = 1 group by track_id",
)
AREA.add(
    "res_score",
    lambda s, d: tiers(s, d).groupBy("tier", "stage").agg(F.count(F.lit(1)).alias("n")),
    BEST_SQL + "select tier, case tier when 3 then 1 else 2 end as stage, count(*) as n from best where rn = 1 group by tier",
)


def similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names with one letter pair lost, against all names of the brand."""
    titles = table(spark, sf_dir, "part").select(F.lower("p_brand").alias("artist_norm"), "p_name")
    broken = titles.select(
        "artist_norm", F.concat(F.substring("p_name", 1, 3), F.substring("p_name", 6, 100)).alias("title_norm")
    ).distinct()
    wanted = broken.select(
        "artist_norm", "title_norm", F.lit(0).alias("excused_album"), F.lit("").alias("want_year"),
        F.lit(0).alias("excused_title"), F.col("artist_norm").alias("artist_key"))
    return match.weak_pairs(wanted, index(spark, sf_dir), "artist_norm").select(
        "artist_norm", "title_norm", "stripped_norm",
        fuzzy.fuzzy_ratio(F.col("title_norm"), F.col("stripped_norm")).alias("ratio"))


# No SQL form of the ratio: checked against brute force in tests/test_text_match.py.
AREA.add("res_fuzzy_ratio", similar)
AREA.add("join_title_fuzzy", lambda s, d: similar(s, d).where(F.col("ratio") >= fuzzy.WEAK_RATIO))


def resolution(spark: SparkSession, sf_dir: str, **options) -> R.Resolution:
    return R.resolve(candidates(spark, sf_dir), catalog_tracks(spark, sf_dir), as_of=AS_OF, **options)


RESOLVED_SQL = BEST_SQL + """
, by_name as (select * from best where rn = 1)
, id_scored as (
  select c.artist_norm, c.title_norm, f.track_id, f.release, f.uri, f.artist_id, f.artist_name, f.name,
    case when f.title_norm = c.title_norm then 3 else 2 end as tier
  from cand c join forms f on f.artist_id = c.verified_id
  where f.marker is null and c.title_norm in (f.title_norm, f.stripped_norm)
    and exists (select 1 from by_name b where b.artist_norm = c.artist_norm)
), either as (
  select * exclude (rn) from by_name union all select * from id_scored
), found as (
  select * from either qualify row_number() over (partition by artist_norm, title_norm order by tier desc, release, track_id) = 1
)
, outcome as (
  select c.input_idx, c.artist, c.title, case when f.uri is null then 'unresolved' else 'resolved' end as status,
    f.uri, f.track_id, f.artist_name as matched_artist, f.name as matched_title,
    case f.tier when 3 then 'exact' when 2 then 'strong' end as confidence,
    case f.tier when 3 then 'search' when 2 then 'search_offset' end as method
  from cand c left join found f on f.artist_norm = c.artist_norm and f.title_norm = c.title_norm
)
"""
OUTCOME = ["input_idx", "artist", "title", "status", "uri", "track_id", "matched_artist", "matched_title", "confidence", "method"]
AREA.add("res_partition", lambda s, d: resolution(s, d).outcome.select(*OUTCOME), RESOLVED_SQL + "select * from outcome")
AREA.add(
    "res_staged_search",
    lambda s, d: resolution(s, d).outcome.where("status = 'resolved'").groupBy("method").agg(F.count(F.lit(1)).alias("n")),
    RESOLVED_SQL + "select method, count(*) as n from outcome where status = 'resolved' group by method",
)
AREA.add(
    "res_verified_artist",
    lambda s, d: resolution(s, d).outcome.where("matched_artist like '% Topic'").select("input_idx", "matched_artist", "uri"),
    RESOLVED_SQL + "select input_idx, matched_artist, uri from outcome where matched_artist like '% Topic'",
)
AREA.add("q_resolution_stats", lambda s, d: R.resolution_stats(resolution(s, d).outcome), RESOLVED_SQL + """
select count(*) as total, count(*) filter (status = 'resolved') as resolved, count(*) filter (status <> 'resolved') as unresolved,
  round(cast(count(*) filter (status = 'resolved') as double) / count(*), 3) as resolution_rate,
  cast(count(*) filter (status = 'resolved') as double) / count(*) < 0.7 as low_confidence from outcome""")
AREA.add("list_build_from_candidates",
         lambda s, d: ordered_items(resolution(s, d).outcome), RESOLVED_SQL + """
select row_number() over (order by input_idx) - 1 as position, (row_number() over (order by input_idx) - 1) // 100 as chunk,
  input_idx, uri from outcome where status = 'resolved'""")


def weak_outcome(spark: SparkSession, sf_dir: str, strict: bool) -> DataFrame:
    """Titles with two letters missing: nothing but weak matches."""
    bent = candidates(spark, sf_dir).withColumn(
        "title", F.concat(F.substring("title", 1, 4), F.substring("title", 6, 100)))
    return R.resolve(bent, catalog_tracks(spark, sf_dir), as_of=AS_OF, strict=strict).outcome


AREA.add("res_strict_gate", lambda s, d: weak_outcome(s, d, True).groupBy("status", "reason").agg(F.count(F.lit(1)).alias("n")))


def cache_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of some artists' parts, one row in three negative, 0 to 39 days old."""
    part = table(spark, sf_dir, "part")
    rows = part.groupBy(F.expr("concat(lower(p_brand), '|', p_name)").alias("norm_key")).agg(F.min("p_partkey").alias("k"))
    return rows.selectExpr(
        "norm_key", "k % 3 = 0 as is_negative", "if(k % 3 = 0, null, concat('app:track:', k)) as track_uri",
        "if(k % 3 = 0, null, cast(k as string)) as track_id", "if(k % 3 = 0, null, 'ar') as artist_id",
        "cast(null as string) as matched_artist_name", "cast(null as string) as matched_title", "cast(null as string) as isrc",
        "if(k % 3 = 0, null, if(k % 5 = 0, 'weak', 'exact')) as confidence", "'search' as method",
        "timestamp_ntz '2024-06-01 00:00:00' - make_dt_interval(cast(k % 40 as int)) as resolved_at", "1 as search_calls")


def looked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = match.wanted_keys(candidates(spark, sf_dir)).select("input_idx", "norm_key")
    return C.lookup(asked, cache_rows(spark, sf_dir), AS_OF).select("input_idx", "norm_key", "hit.is_negative", "hit.track_uri")


CACHE_SQL = CATALOG_CTE + """
, cache as (select lower(p_brand) || '|' || p_name as norm_key, min(p_partkey) as k from part group by 1)
, live as (select norm_key, k, k % 3 = 0 as is_negative, case when k % 3 <> 0 then 'app:track:' || k end as track_uri from cache
   where k % 40 <= case when k % 3 = 0 then 7 else 30 end)
"""
LOOKUP_SQL = CACHE_SQL + ("select input_idx, artist_norm || '|' || title_norm as norm_key, is_negative, track_uri "
                          "from cand left join live on norm_key = artist_norm || '|' || title_norm")
AREA.add("res_cache_lookup", looked_up, LOOKUP_SQL)
AREA.add("join_cache_lookup", lambda s, d: looked_up(s, d).where("is_negative").select("input_idx"),
         f"select input_idx from ({LOOKUP_SQL}) where is_negative")


def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = cache_rows(spark, sf_dir)
    new = old.where("cast(track_id as bigint) % 4 = 0").withColumns(
        {"method": F.lit("search_relaxed"), "search_calls": F.lit(3)})
    return C.upsert(old, new).groupBy("method", "is_negative").agg(F.count(F.lit(1)).alias("n"))


AREA.add("res_cache_upsert", upserted, CACHE_SQL + """
select case when k % 3 <> 0 and k % 4 = 0 then 'search_relaxed' else 'search' end as method, k % 3 = 0 as is_negative, count(*) as n
from cache group by 1, 2""")


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two upserts through the store, and what is alive then: whole rows."""
    store = CacheStore(spark, work_dir(spark, "cache"), buckets=8)
    old = cache_rows(spark, sf_dir)
    store.upsert(old)
    store.upsert(old.where("cast(track_id as bigint) % 4 = 0").withColumns(
        {"method": F.lit("search_relaxed"), "search_calls": F.lit(3), "resolved_at": F.lit(AS_OF).cast("timestamp_ntz")}))
    live = C.alive(F.col("resolved_at"), F.col("is_negative"), F.lit(AS_OF).cast("timestamp_ntz"))
    return store.read().where(live).withColumn("resolved_at", F.col("resolved_at").cast("string"))


AREA.add("res_cache_store", stored, CACHE_SQL + """
, rows as (select *, k % 3 = 0 as negative, k % 3 <> 0 and k % 4 = 0 as again from cache)
select norm_key, negative as is_negative, case when not negative then 'app:track:' || k end as track_uri,
  case when not negative then cast(k as varchar) end as track_id, case when not negative then 'ar' end as artist_id,
  cast(null as varchar) as matched_artist_name, cast(null as varchar) as matched_title, cast(null as varchar) as isrc,
  case when not negative then case when k % 5 = 0 then 'weak' else 'exact' end end as confidence,
  case when again then 'search_relaxed' else 'search' end as method,
  cast(timestamp '2024-06-01 00:00:00' - to_days(cast(case when again then 0 else k % 40 end as integer)) as varchar) as resolved_at,
  case when again then 3 else 1 end as search_calls
from rows where again or k % 40 <= case when negative then 7 else 30 end""")
AREA.add(
    "res_validate_candidates",
    lambda s, d: R.bad_candidates(candidates(s, d).withColumn("title", F.when(F.col("input_idx") % 7 > 0, F.col("title"))))
    .select("input_idx", "artist"),
    CATALOG_CTE + "select input_idx, artist from cand where input_idx % 7 = 0",
)
