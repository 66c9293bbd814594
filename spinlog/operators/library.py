"""Reads of the catalogue, the library and recent plays, as table operators."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spinlog.operators.predicates import named, one_of
from spinlog.operators.topk import page

# What may be searched, and the page limits.
SEARCH_TYPES = ("track", "artist", "album", "playlist")
ALBUM_GROUPS = ("album", "single", "appears_on", "compilation")

# The trailing windows of the top lists.
WINDOWS = {
    "short_term": {"days": 28},
    "medium_term": {"months": 6},
    "long_term": {"months": 12},
}


def check_types(types: list[str]) -> list[str]:
    wrong = sorted(set(types) - set(SEARCH_TYPES))
    if wrong:
        raise ValueError(f"unsupported search type(s): {wrong}; use {sorted(SEARCH_TYPES)}")
    return types


def _has(text: Column, part: str | None) -> Column:
    return F.lit(True) if not part else F.coalesce(F.contains(F.lower(text), F.lit(part.lower())), F.lit(False))


def catalog_search(
    tables: dict[str, DataFrame],
    *,
    track: str | None = None,
    artist: str | None = None,
    album: str | None = None,
    year: str | None = None,
    isrc: str | None = None,
    free_text: str | None = None,
    types: list[str] | None = None,
    limit: int = 5,
    offset: int = 0,
) -> DataFrame:
    """One page per type as (type, id, name, uri), ordered by name and id.

    `tables` holds nested rows per type.  A filter that a type has no field for
    leaves that type without rows.
    """
    if not any((track, artist, album, year, isrc, free_text)):
        raise ValueError("a search needs at least one of track, artist, album, year, isrc, free_text")
    pages = []
    for kind in check_types(types or ["track"]):
        df = tables[kind]
        name = F.col("name")
        credited = F.array_join(F.transform("artists", lambda a: a["name"]), "\n") if "artists" in df.columns else None
        if kind == "track":
            released, album_name = F.col("album.release_date"), F.col("album.name")
            fits = _has(name, track) & _has(credited, artist) & _has(album_name, album)
            fits &= F.col("external_ids.isrc") == isrc if isrc else F.lit(True)
            text = F.concat_ws("\n", name, credited, album_name)
        elif kind == "album":
            released = F.col("release_date")
            fits = _has(name, album) & _has(credited, artist) & F.lit(not (track or isrc))
            text = F.concat_ws("\n", name, credited)
        else:
            released, text = F.lit(None).cast("string"), name
            fits = _has(name, artist if kind == "artist" else None)
            fits &= F.lit(not (track or album or year or isrc or (artist and kind == "playlist")))
        if year:
            low, _, high = year.partition("-")
            fits &= F.substring(released, 1, 4).between(low, high or low)
        found = df.where(fits & _has(text, free_text)).select(F.lit(kind).alias("type"), "id", "name", "uri")
        pages.append(page(found, [F.col("name").asc(), F.col("id").asc()], limit, offset))
    result = pages[0]
    for more in pages[1:]:
        result = result.unionByName(more)
    return result


def recent_plays(plays: DataFrame, limit: int = 20, after_ms: int | None = None, before_ms: int | None = None,
                 ties: tuple[str, ...] = ("track_uri",)) -> DataFrame:
    """Music plays, newest first; `after_ms` and `before_ms` exclude each other."""
    if after_ms is not None and before_ms is not None:
        raise ValueError("after_ms and before_ms exclude each other")

    def moment(ms: int) -> Column:
        utc = dt.datetime.fromtimestamp(ms / 1000, dt.timezone.utc).replace(tzinfo=None)
        return F.lit(utc).cast("timestamp_ntz")

    plays = named(plays, "track_uri")
    if after_ms is not None:
        plays = plays.where(F.col("ts_utc") > moment(after_ms))
    if before_ms is not None:
        plays = plays.where(F.col("ts_utc") < moment(before_ms))
    return page(plays, [F.col("ts_utc").desc(), *[F.col(c).asc() for c in ties]], limit)


def top_items(plays: DataFrame, entity: str = "artist", time_range: str = "medium_term", limit: int = 20,
              offset: int = 0) -> DataFrame:
    """Most played artists or tracks of a trailing window that ends at the latest play."""
    key = {"artist": "artist_name", "track": "track_uri"}[one_of("entity", entity, ("artist", "track"))]
    one_of("time_range", time_range, tuple(WINDOWS))
    span = WINDOWS[time_range]
    back = F.make_dt_interval(F.lit(span["days"])) if "days" in span else F.make_ym_interval(F.lit(0), F.lit(span["months"]))
    latest = plays.agg(F.max("ts_utc")).scalar()
    counted = (
        named(plays, key).where(F.col("ts_utc") >= latest - back)
        .groupBy(F.col(key).alias("entity")).agg(F.count(F.lit(1)).alias("plays"))
    )
    return page(counted, [F.col("plays").desc(), F.col("entity").asc()], limit, offset)


def saved_listing(saved: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """Saved tracks or albums, the newest first."""
    return page(saved, [F.col("added_at").desc_nulls_last(), F.col("id").asc()], limit, offset)


def my_lists(lists: DataFrame, follows: DataFrame, user: str, limit: int = 20, offset: int = 0) -> DataFrame:
    """Lists a user owns or follows."""
    followed = follows.where(F.col("user_id") == user).select(F.col("list_id").alias("id"), F.lit(True).alias("_f"))
    mine = lists.join(followed.distinct(), "id", "left").where((F.col("owner_id") == user) | F.col("_f")).drop("_f")
    return page(mine, [F.col("id").asc()], limit, offset)


def followed_after(artists: DataFrame, after: str | None = None, limit: int = 20) -> DataFrame:
    """Keyset page: ids behind the cursor, so a page costs the same wherever it starts."""
    rest = artists if after is None else artists.where(F.col("id") > after)
    return page(rest, [F.col("id").asc()], limit)


def list_summary(lists: DataFrame, items: DataFrame) -> DataFrame:
    """Metadata with the item count; lists without items count 0."""
    counts = items.groupBy(F.col("list_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return lists.join(counts, "id", "left").withColumn("item_count", F.coalesce("n", F.lit(0))).drop("n")


def list_items_page(items: DataFrame, list_id, limit: int = 20, offset: int = 0) -> DataFrame:
    """Items of one list by position.  Positions are dense, so the page is a range filter."""
    upper = offset + limit
    inside = (F.col("position") >= offset) & (F.col("position") < upper)
    return items.where((F.col("list_id") == list_id) & inside).orderBy("position")


def artist_albums(albums: DataFrame, artist_id: str, include_groups: str | None = None, limit: int = 20,
                  offset: int = 0) -> DataFrame:
    """Albums that credit an artist; `include_groups` is a comma-separated subset of the groups."""
    credited = F.array_contains(F.transform("artists", lambda a: a["id"]), artist_id)
    found = albums.where(credited)
    if include_groups:
        groups = [one_of("include_groups", g.strip(), ALBUM_GROUPS) for g in include_groups.split(",")]
        found = found.where(F.col("album_type").isin(groups))
    return page(found, [F.col("release_date").asc_nulls_last(), F.col("id").asc()], limit, offset)


def album_tracks(tracks: DataFrame, album_id: str, limit: int = 20, offset: int = 0) -> DataFrame:
    order = [F.col("disc_number").asc_nulls_last(), F.col("track_number").asc_nulls_last(), F.col("id").asc()]
    return page(tracks.where(F.col("album.id") == album_id), order, limit, offset)


def by_id(df: DataFrame, value: str) -> DataFrame:
    return df.where(F.col("id") == value)
