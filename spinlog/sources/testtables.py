"""Adapters: the driver's tables read as plays, export files, catalogue and lists.

Only expressions over the given rows; nothing is invented and nothing is capped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spinlog.operators.plays import derive_columns

ZONE = "Europe/Zagreb"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def play_fields(lineitem: DataFrame) -> DataFrame:
    """One play per line item, before any derivation; `source_*` order is unique up to copies."""
    return lineitem.selectExpr(
        "l_shipdate + make_dt_interval(0, cast(l_orderkey % 24 as int)) as ts_utc",
        "cast(l_quantity * 5000 as bigint) as ms_played",
        "case when l_linenumber < 7 then concat('track ', l_linenumber) end as track_name",
        "case when l_linenumber < 7 then concat('artist_', l_partkey) end as artist_name",
        "case when l_linenumber < 7 then concat('album_', l_suppkey) end as album_name",
        "case when l_linenumber < 7 then concat('app:track:', l_partkey, '_', l_linenumber) end as track_uri",
        "case when l_linenumber = 7 then concat('episode ', l_partkey) end as episode_name",
        "case when l_linenumber = 7 then concat('show ', l_suppkey) end as episode_show",
        "case when l_linenumber = 7 then concat('app:episode:', l_partkey) end as episode_uri",
        "case when l_tax > 0.02 then 'clickrow' else 'trackdone' end as reason_start",
        "case l_returnflag when 'R' then 'fwdbtn' when 'A' then 'trackdone' end as reason_end",
        "l_discount > 0.05 as shuffle",
        "case when l_linestatus = 'F' then l_tax > 0.04 end as skipped_raw",
        "l_discount < 0.01 as offline",
        "l_tax < 0.01 as incognito",
        "concat('platform_', l_suppkey % 5) as platform",
        "concat('C', l_suppkey % 25) as conn_country",
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus",
    )


SOURCE_ORDER = [
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus",
]


def plays_from_lineitem(spark: SparkSession, sf_dir: str, zone: str = ZONE) -> DataFrame:
    """The fact table without `play_id`; unused columns are pruned from the scan."""
    return derive_columns(play_fields(table(spark, sf_dir, "lineitem")), zone)


def export_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as export records: (file number, index, time as text, JSON payload).

    A file holds the orders of one block of 500 consecutive keys, so its size
    does not grow with the table.  Every 7th key is a podcast, every 11th has
    empty names and no URI, and one in five repeats the play of another file.
    """
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as k",
        "o_custkey as c",
        "o_orderdate + make_dt_interval(0, cast(o_orderkey % 24 as int)) as t",
        "cast(o_totalprice as bigint) as ms",
        "o_orderstatus as s",
        "o_orderpriority as p",
    )
    orders = orders.withColumn("ts", F.expr("date_format(t, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"))
    repeats = orders.where("k % 5 = 0").selectExpr("k + 2000000000000 as k0", "*")
    both = orders.selectExpr("k as k0", "*").unionByName(repeats)
    record = F.to_json(
        F.expr(
            "named_struct("
            "'ts', ts, 'ms_played', ms,"
            "'master_metadata_track_name', case when k % 7 <> 0 then if(k % 11 = 0, '', concat('song ', k % 97)) end,"
            "'master_metadata_album_artist_name', case when k % 7 <> 0 then if(k % 11 = 0, '', concat('artist ', c)) end,"
            "'master_metadata_album_album_name', case when k % 7 <> 0 then concat('album ', k % 13) end,"
            "'app_track_uri', case when k % 7 <> 0 then if(k % 11 = 0, '', concat('app:track:', c, 'x', k % 97)) end,"
            "'episode_name', case when k % 7 = 0 then concat('part ', k) end,"
            "'episode_show_name', case when k % 7 = 0 then 'show \"A, [B]\" {C}' end,"
            "'app_episode_uri', case when k % 7 = 0 then concat('app:episode:', k) end,"
            "'reason_start', 'clickrow',"
            "'reason_end', case s when 'F' then 'fwdbtn' when 'O' then 'trackdone' end,"
            "'shuffle', k % 2 = 0, 'skipped', case when k % 3 > 0 then k % 3 = 1 end,"
            "'offline', false, 'incognito_mode', k % 17 = 0, 'platform', p,"
            "'username', concat('user ', c), 'priority_class', p)"
        ),
        {"ignoreNullFields": "false"},
    )
    return both.select(
        F.expr("k0 div 500").alias("file_no"), F.col("k0"), "ts", record.alias("payload")
    )


def export_files(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    """(source_file, content): each block of 500 keys rendered as one JSON array, of the records `where` holds for.

    `where` is over columns of `export_records`; one that leaves out `payload` is applied before any text is made.
    """
    per_file = export_records(spark, sf_dir).where(where).groupBy("file_no").agg(
        F.sort_array(F.collect_list(F.struct("k0", "payload"))).alias("r")
    )
    text = F.concat(F.lit("["), F.array_join("r.payload", ",\n"), F.lit("]"))
    return per_file.select(
        F.format_string("part_%013d.json", "file_no").alias("source_file"),
        F.encode(text, "UTF-8").alias("content"),
    )


def catalog_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as nested catalogue tracks."""
    return table(spark, sf_dir, "part").selectExpr(
        "cast(p_partkey as string) as id",
        "concat(p_name, element_at(array('', ' - Single Version', ' (Remastered 2011)',"
        " ' - Karaoke Version', ' (Live)', ' (Deluxe) - Remastered'), cast(p_partkey % 6 as int) + 1)) as name",
        "concat('app:track:', p_partkey) as uri",
        "cast(p_retailprice * 100 as bigint) as duration_ms",
        "p_partkey % 10 = 0 as explicit",
        # One part in ten credits the artist under another name, with the same id.
        "array(named_struct('id', concat('ar', p_brand), 'name', if(p_partkey % 10 = 7, concat(p_brand, ' Topic'),"
        " concat('The ', p_brand)), 'uri', concat('app:artist:', p_brand)),"
        " named_struct('id', concat('guest', p_size), 'name', concat('Guest ', p_size), 'uri', concat('app:artist:guest', p_size)))"
        " as artists",
        "named_struct('id', concat('al', p_type), 'name', concat('Album ', p_type), 'uri', concat('app:album:', p_type),"
        " 'release_date', concat(1960 + p_size, '-01-01')) as album",
        "named_struct('isrc', concat('XX', lpad(cast(p_partkey as string), 10, '0'))) as external_ids",
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted records, keyed by the first part that names them (a sparse but stable index); a third has titles nobody made."""
    title = F.expr("if(p_partkey % 3 = 2, concat('Unheard ', p_partkey), p_name)")
    return (
        table(spark, sf_dir, "part")
        .groupBy(F.upper("p_brand").alias("artist"), title.alias("title"))
        .agg(F.min("p_partkey").alias("input_idx"))
        .select("input_idx", "artist", "title", F.lit(None).cast("string").alias("album"),
                F.lit(None).cast("string").alias("year"))
    )


def list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ordered lists of 150 items: (list_id, position, uri)."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id div 150 as list_id", "event_id % 150 as position",
        "concat(if(event_type = 'error', 'app:episode:', 'app:track:'), user_id) as uri",
    )
