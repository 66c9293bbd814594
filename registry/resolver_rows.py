"""Resolver questions compared row by row: years and albums that decide, similar titles whose ratio follows from their length."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry import Area
from registry.resolver import AS_OF, CATALOG_CTE, OUTCOME
from spinlog.functions import fuzzy
from spinlog.operators import match
from spinlog.operators import resolve as R
from spinlog.session import materialize
from spinlog.sources.testtables import candidates, catalog_tracks, table

AREA = Area()


def marked_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth track stands on an album of another kind of recording."""
    return catalog_tracks(spark, sf_dir).withColumn(
        "album", F.col("album").withField("name", F.expr("if(cast(id as bigint) % 5 = 0, 'Karaoke Party', album.name)")))


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted records with years (none, one that no track has, their own part's, a fixed one) and every other with an album."""
    sizes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("input_idx"), "p_size")
    return candidates(spark, sf_dir).join(sizes, "input_idx").select(
        "input_idx", "artist", "title", F.expr("if(input_idx % 2 = 0, 'Karaoke Nights', null)").alias("album"),
        F.expr("case input_idx % 4 when 1 then '1900' when 2 then cast(1960 + p_size as string) when 3 then '1965' end").alias("year"))


DATED_SQL = CATALOG_CTE + """
, wanted as (
  select c.*, case input_idx % 4 when 1 then '1900' when 2 then cast(1960 + p.p_size as varchar) when 3 then '1965' end as year,
    case when input_idx % 2 = 0 then 'Karaoke Nights' end as album
  from cand c join part p on p.p_partkey = c.input_idx
), fits as (
  select w.input_idx, w.artist_norm, f.artist_norm = w.artist_norm as by_name, f.track_id, f.release, f.uri, f.artist_name, f.name, tier,
    case when w.year is not null and w.year <> f.year then 3 when tier = 3 then 1 else 2 end as stage
  from wanted w join (select *, unnest([3, 2]) as tier from forms) f
    on (f.artist_norm = w.artist_norm or f.artist_id = w.verified_id)
    and w.title_norm = case tier when 3 then f.title_norm else f.stripped_norm end
  where f.marker is null and (f.k % 5 <> 0 or w.album is not null)
), found as (
  select * from fits where by_name or artist_norm in (select artist_norm from fits where by_name)
  qualify row_number() over (partition by input_idx order by stage, tier desc, release, track_id) = 1
), outcome as (
  select w.input_idx, w.artist, w.title, w.album, w.year, case when f.uri is null then 'unresolved' else 'resolved' end as status,
    f.uri, f.track_id, f.artist_name as matched_artist, f.name as matched_title,
    case f.tier when 3 then 'exact' when 2 then 'strong' end as confidence,
    case f.stage when 1 then 'search' when 2 then 'search_offset' when 3 then 'search_relaxed' end as method
  from wanted w left join found f using (input_idx)
)
select * from outcome"""
AREA.add(
    "res_staged_search_rows",
    lambda s, d: R.resolve(dated(s, d), marked_tracks(s, d), as_of=AS_OF).outcome.select(*OUTCOME, "album", "year"),
    DATED_SQL,
)


def solo_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every track by an artist of its own."""
    artist = F.expr("array(named_struct('id', concat('solo', id), 'name', concat('Solo ', id), 'uri', concat('app:artist:solo', id)))")
    return catalog_tracks(spark, sf_dir).withColumn("artists", artist)


def solo_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each track's plain title without its fifth letter: 2(L-1) of 2L-1 letters are shared, and nothing else is near."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("input_idx"), F.concat(F.lit("SOLO "), "p_partkey").alias("artist"),
        F.concat(F.substring("p_name", 1, 4), F.substring("p_name", 6, 100)).alias("title"),
        F.lit(None).cast("string").alias("album"), F.lit(None).cast("string").alias("year"))


def solo_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = match.wanted_keys(solo_candidates(spark, sf_dir)).select(*match.WANTED).distinct().withColumns(
        {"artist_key": F.col("artist_norm"), "excused_title": F.lit(0)})
    index = materialize(match.catalog_index(solo_tracks(spark, sf_dir)), "catalog")
    return match.weak_pairs(wanted, index, "artist_norm").select(
        "artist_norm", "title_norm", "stripped_norm",
        fuzzy.fuzzy_ratio(F.col("title_norm"), F.col("stripped_norm")).alias("ratio"))


SOLO_SQL = CATALOG_CTE + """
, solo as (
  select k, 'solo ' || k as artist_norm, substr(p_name, 1, 4) || substr(p_name, 6) as title, stripped_norm, marker,
    2.0::double * (length(p_name) - 1) / (2 * length(p_name) - 1) as ratio, uri, track_id, name
  from forms
)
"""
RATIO_SQL = SOLO_SQL + "select artist_norm, lower(title) as title_norm, stripped_norm, ratio from solo where marker is null"
AREA.add("res_fuzzy_ratio_rows", solo_ratios, RATIO_SQL)
AREA.add("join_title_fuzzy_rows", lambda s, d: solo_ratios(s, d).where(F.col("ratio") >= fuzzy.WEAK_RATIO),
         RATIO_SQL + " and ratio >= 0.85")


def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the strict gate does to the same wanted records, beside the outcome without it."""
    asked, tracks = solo_candidates(spark, sf_dir), solo_tracks(spark, sf_dir)
    both = [R.resolve(asked, tracks, as_of=AS_OF, strict=strict).outcome.withColumn("strict", F.lit(strict)) for strict in (True, False)]
    return both[0].unionByName(both[1]).select(
        "input_idx", "artist", "title", "status", "uri", "track_id", "confidence", "strict", "reason",
        F.array_join("rejected_candidates", "|").alias("rejected"))


GATE_SQL = SOLO_SQL + f"""
, judged as (select *, marker is null and ratio >= 0.85 as near, unnest([true, false]) as strict from solo)
select k as input_idx, 'SOLO ' || k as artist, title, strict, case when near and not strict then 'resolved' else 'unresolved' end as status,
  case when near and not strict then uri end as uri, case when near and not strict then track_id end as track_id,
  case when near and not strict then 'weak' end as confidence,
  case when not near then '{R.NO_MATCH}' when strict then '{R.WEAK}' end as reason,
  case when near and not strict then '' else uri end as rejected
from judged"""
AREA.add("res_strict_gate_rows", gate, GATE_SQL)
