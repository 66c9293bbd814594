"""Catalogue pages, search, listings and recent plays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry import Area
from registry.plays import PLAYS_CTE, over_plays
from registry.resolver import CATALOG_CTE
from spinlog.operators import library as B
from spinlog.operators.topk import page
from spinlog.sources import pages as G
from spinlog.sources.testtables import SOURCE_ORDER, catalog_tracks, list_items, table

AREA = Area()


def track_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page JSON of up to 50 tracks each (a block of part keys); one track in 13 lacks its URI."""
    tracks = catalog_tracks(spark, sf_dir).withColumn("k", F.col("id").cast("bigint"))
    fields = [c for c in tracks.columns if c not in ("k", "uri")]
    item = F.to_json(F.struct(*fields, F.when(F.col("k") % 13 > 0, F.col("uri")).alias("uri"), F.lit(1).alias("extra")))
    per_page = tracks.select(F.expr("k div 50").alias("page"), "k", item.alias("item")).groupBy("page").agg(
        F.sort_array(F.collect_list(F.struct("k", "item"))).alias("items"))
    body = F.concat(F.lit('{"tracks":{"limit":50,"items":['), F.array_join("items.item", ","), F.lit("]}}"))
    return per_page.select("page", body.alias("payload"))


AREA.add("lib_flatten_pages",
         lambda s, d: G.flatten_pages(track_pages(s, d), "tracks").select(
             "page", "item_no", "id", "name", "uri", "artist_id", "artist_name", "album_name", "release_date", "isrc", "explicit"),
         CATALOG_CTE + """
select k // 50 as page, cast(row_number() over (partition by k // 50 order by k) - 1 as integer) as item_no, track_id as id,
  name, uri, artist_id, artist_name, album_name, release as release_date, isrc, k % 10 = 0 as explicit
from cat qualify k % 13 > 0""")


def saved_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as saved entries {added_at, album}, one page per block of 50 keys."""
    orders = table(spark, sf_dir, "orders")
    entry = F.to_json(F.struct(
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("added_at"),
        F.struct(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("name"),
                 F.concat(F.lit("app:album:"), F.col("o_orderkey")).alias("uri"), F.lit("album").alias("album_type"),
                 F.expr("array(named_struct('id', 'c' || o_custkey, 'name', 'Customer ' || o_custkey, 'uri', 'x'))").alias("artists"),
                 ).alias("album")))
    per_page = orders.groupBy(F.expr("o_orderkey div 50").alias("page")).agg(
        F.array_join(F.sort_array(F.collect_list(entry)), ",").alias("items"))
    return per_page.select(F.concat(F.lit('{"items":['), F.col("items"), F.lit("]}")).alias("payload"))


def saved_albums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.flatten_pages(saved_pages(spark, sf_dir), "albums", wrapper="album")


AREA.add("lib_saved_listing",
         lambda s, d: B.saved_listing(saved_albums(s, d), 50, 25).select("id", "added_at", "artist_name"), """
select cast(o_orderkey as varchar) as id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') as added_at,
  'Customer ' || o_custkey as artist_name from orders order by added_at desc, id limit 50 offset 25""")


def playlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "cast(c_custkey as string) as id", "c_name as name", "concat('app:playlist:', c_custkey) as uri",
        "concat('user', c_nationkey) as owner_id", "c_custkey div 1 as list_id")


AREA.add("lib_my_lists",
         lambda s, d: B.my_lists(
             playlists(s, d),
             table(s, d, "orders").selectExpr("concat('user', o_orderkey % 25) as user_id", "cast(o_custkey as string) as list_id"),
             "user7", 50, 10).select("id", "name", "owner_id"), """
select cast(c_custkey as varchar) as id, c_name as name, 'user' || c_nationkey as owner_id from customer
where c_nationkey = 7 or c_custkey in (select o_custkey from orders where o_orderkey % 25 = 7) order by id limit 50 offset 10""")


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    tracks = catalog_tracks(spark, sf_dir)
    artists = tracks.select(F.inline("artists")).distinct()
    albums = tracks.groupBy("album.id", "album.name", "album.uri").agg(
        F.min("album.release_date").alias("release_date"), F.array_distinct(F.array(F.min(F.get("artists", 0)))).alias("artists"))
    return {"track": tracks, "artist": artists, "album": albums, "playlist": playlists(spark, sf_dir)}


AREA.add("lib_catalog_search",
         lambda s, d: B.catalog_search(tables(s, d), track="Ring", artist="brand#2", year="1965-1990", limit=50, offset=3),
         CATALOG_CTE + """
select 'track' as type, track_id as id, name, uri from cat where lower(name) like '%ring%' and lower(artist_name) like '%brand#2%'
  and year between '1965' and '1990' order by name, id limit 50 offset 3""")
AREA.add("lib_catalog_search_types",
         lambda s, d: B.catalog_search(tables(s, d), free_text="1", types=["track", "artist", "playlist"], limit=10),
         CATALOG_CTE + """
, t as (select 'track' as type, track_id as id, name, uri from cat where lower(concat_ws(' ', name, artist_name, guest_name, album_name)) like '%1%'
   order by name, id limit 10)
, ar as (select distinct 'artist' as type, * from (select artist_id as id, artist_name as name, 'app:artist:' || p_brand as uri from cat
    union select guest_id, guest_name, 'app:artist:guest' || p_size from cat) where name like '%1%' order by name, id limit 10)
, pl as (select 'playlist' as type, cast(c_custkey as varchar) as id, c_name as name, 'app:playlist:' || c_custkey as uri from customer
    where c_name like '%1%' order by name, id limit 10)
select * from t union all select * from ar union all select * from pl""")

RECENT = ["ts_utc", "track_uri", "artist_name", *SOURCE_ORDER[:4]]
CUT_MS = 946684800000  # 2000-01-01T00:00:00Z
AREA.add("lib_recent_plays",
         over_plays(lambda p: B.recent_plays(p, 50, before_ms=CUT_MS, ties=("track_uri", *SOURCE_ORDER)).select(*RECENT)),
         PLAYS_CTE + f"select {', '.join(RECENT)} from plays where track_uri is not null and ts_utc < timestamp '2000-01-01' "
         f"order by ts_utc desc, track_uri, {', '.join(SOURCE_ORDER)} limit 50")
for span, interval in {"short_term": "interval 28 day", "medium_term": "interval 6 month", "long_term": "interval 12 month"}.items():
    for entity, col in {"artist": "artist_name", "track": "track_uri"}.items():
        AREA.add(f"lib_top_items_{entity}_{span}",
                 over_plays(lambda p, e=entity, t=span: B.top_items(p, e, t, 50, 5)),
                 PLAYS_CTE + f"select {col} as entity, count(*) as plays from plays where {col} is not null and "
                 f"ts_utc >= (select max(ts_utc) from plays) - {interval} group by {col} order by plays desc, entity limit 50 offset 5")

AREA.add("lib_followed_cursor",
         lambda s, d: B.followed_after(tables(s, d)["artist"].select("id", "name").distinct(), "arBrand#20", 50),
         CATALOG_CTE + """
select * from (select distinct artist_id as id, artist_name as name from cat union select guest_id, guest_name from cat)
where id > 'arBrand#20' order by id, name limit 50""")
AREA.add("lib_playlist_summary",
         lambda s, d: B.list_summary(playlists(s, d).withColumn("id", F.col("list_id")).drop("list_id"), list_items(s, d)),
         """
select c_custkey as id, c_name as name, 'app:playlist:' || c_custkey as uri, 'user' || c_nationkey as owner_id, coalesce(n, 0) as item_count
from customer left join (select event_id // 150 as list_id, count(*) as n from events group by 1) on list_id = c_custkey""")
AREA.add("lib_playlist_items", lambda s, d: B.list_items_page(list_items(s, d), 5, 50, 40), """
select event_id // 150 as list_id, event_id % 150 as position,
  case when event_type = 'error' then 'app:episode:' else 'app:track:' end || user_id as uri
from events where event_id // 150 = 5 and event_id % 150 between 40 and 89""")


def albums_of_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "concat('al', p_partkey) as id", "p_name as name",
        "element_at(array('album', 'single', 'appears_on', 'compilation'), cast(p_partkey % 4 as int) + 1) as album_type",
        "concat(1960 + p_size, '-01-01') as release_date", "array(named_struct('id', concat('ar', p_brand), 'name', p_brand)) as artists")


AREA.add("lib_artist_albums",
         lambda s, d: B.artist_albums(albums_of_groups(s, d), "arBrand#5", "album,compilation", 50).drop("artists"), """
select 'al' || p_partkey as id, p_name as name, case p_partkey % 4 when 0 then 'album' else 'compilation' end as album_type,
  cast(1960 + p_size as varchar) || '-01-01' as release_date from part where p_brand = 'Brand#5' and p_partkey % 4 in (0, 3)
order by release_date, id limit 50""")
AREA.add("lib_album_tracks",
         lambda s, d: B.album_tracks(
             catalog_tracks(s, d).selectExpr("*", "cast(id as int) % 2 as disc_number", "cast(id as int) as track_number"),
             "alECONOMY", 50, 10).select("id", "name"),
         CATALOG_CTE + "select track_id as id, name from cat where p_type = 'ECONOMY' order by k % 2, k, track_id limit 50 offset 10")
AREA.add("lib_by_id", lambda s, d: B.by_id(catalog_tracks(s, d), "42").select("id", "name", "uri", "explicit"),
         CATALOG_CTE + "select track_id as id, name, uri, k % 10 = 0 as explicit from cat where k = 42")
AREA.add("slice_offset",
         lambda s, d: page(table(s, d, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()],
                           400, 120),
         "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 400 offset 120")
AREA.add("lib_shape_profile",
         lambda s, d: G.shape_profile(
             table(s, d, "events").select(
                 F.col("event_type").alias("source"),
                 F.concat(F.lit('{"id":1,"body":'), F.col("props"), F.when(F.col("event_id") % 3 == 0, ',"label":"x"').otherwise(""), F.lit("}")).alias("payload")),
             ["label", "k", "popularity"]), """
with p as (select event_type as source, event_id % 3 = 0 as labelled from events)
select source, 'key' as what, unnest(['id', 'body']) as field, count(*) as n from p group by source
union all select source, unnest(['key', 'watched']), 'label', count(*) from p where labelled group by source
union all select source, 'watched', 'k', count(*) from p group by source""")
