"""Nested page JSON of the catalogue -> flat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ARTISTS = "array<struct<id:string,name:string,uri:string>>"
_ALBUM = (
    "id:string,name:string,uri:string,album_type:string,release_date:string,total_tracks:int,"
    f"artists:{_ARTISTS}"
)
_OWNER = "struct<id:string,display_name:string,uri:string>"

# The fields read from each kind of item; unknown ones are ignored.
SCHEMAS = {
    "tracks": (
        "struct<id:string,name:string,uri:string,duration_ms:bigint,explicit:boolean,disc_number:int,"
        f"track_number:int,is_local:boolean,artists:{_ARTISTS},album:struct<{_ALBUM}>,"
        "external_ids:struct<isrc:string,ean:string,upc:string>>"
    ),
    "albums": f"struct<{_ALBUM},external_ids:struct<isrc:string,ean:string,upc:string>>",
    "artists": "struct<id:string,name:string,uri:string,genres:array<string>>",
    "playlists": (
        "struct<id:string,name:string,uri:string,description:string,public:boolean,collaborative:boolean,"
        f"owner:{_OWNER},snapshot_id:string>"
    ),
}
REQUIRED = {
    "tracks": ["id", "name", "uri", "duration_ms"],
    "albums": ["id", "name", "uri"],
    "artists": ["id", "name", "uri"],
    "playlists": ["id", "name", "uri"],
}


def page_items(pages: DataFrame, kind: str, payload: str = "payload") -> DataFrame:
    """One row per item text, with its place: `items` at the top or under the kind's own key."""
    body = F.col(payload)
    items = F.coalesce(F.get_json_object(body, f"$.{kind}.items"), F.get_json_object(body, "$.items"))
    rest = [c for c in pages.columns if c != payload]
    texts = F.from_json(items, "array<string>")
    return pages.select(*rest, F.posexplode_outer(texts).alias("item_no", "item")).where(F.col("item").isNotNull())


def flatten_pages(pages: DataFrame, kind: str, payload: str = "payload", wrapper: str | None = None) -> DataFrame:
    """Flat rows of one kind; malformed items are skipped.

    `wrapper` names the key that holds the object inside an entry, as in saved
    tracks ({added_at, track}); `added_at` and `played_at` are then kept.
    """
    rest = [c for c in pages.columns if c != payload]
    items = page_items(pages, kind, payload)
    when: list[Column] = []
    body = F.col("item")
    if wrapper:
        body = F.get_json_object("item", f"$.{wrapper}")
        when = [F.get_json_object("item", f"$.{k}").alias(k) for k in ("added_at", "played_at")]
    parsed = items.select(*rest, "item_no", *when, F.from_json(body, SCHEMAS[kind]).alias("o"))
    for field in REQUIRED[kind]:
        parsed = parsed.where(F.col(f"o.{field}").isNotNull())
    return parsed.select(*rest, "item_no", *[c for c in ("added_at", "played_at") if wrapper], *_flat(kind))


def _flat(kind: str) -> list[Column]:
    o = {f: F.col(f"o.{f}") for f in ("artists", "album", "external_ids")}
    base = [F.col("o.id"), F.col("o.name"), F.col("o.uri")]
    if kind == "artists":
        return [*base, F.coalesce("o.genres", F.array().cast("array<string>")).alias("genres")]
    if kind == "playlists":
        return [
            *base, F.col("o.description"), F.col("o.public"),
            F.coalesce("o.collaborative", F.lit(False)).alias("collaborative"),
            F.col("o.owner.id").alias("owner_id"), F.col("o.snapshot_id"),
        ]
    first = F.get(o["artists"], 0)
    credits = [first["id"].alias("artist_id"), first["name"].alias("artist_name")]
    if kind == "albums":
        return [*base, F.col("o.album_type"), F.col("o.release_date"), F.col("o.total_tracks"), *credits,
                F.col("o.external_ids.upc").alias("upc")]
    return [
        *base, F.col("o.duration_ms"), F.coalesce("o.explicit", F.lit(False)).alias("explicit"),
        F.col("o.disc_number"), F.col("o.track_number"), F.coalesce("o.is_local", F.lit(False)).alias("is_local"),
        *credits, F.col("o.album.id").alias("album_id"), F.col("o.album.name").alias("album_name"),
        F.col("o.album.release_date").alias("release_date"), F.col("o.external_ids.isrc").alias("isrc"),
    ]


def shape_profile(payloads: DataFrame, watched: list[str], source: str = "source", payload: str = "payload") -> DataFrame:
    """Per source: each top-level key with its count, and how many bodies name each watched field."""
    tops = payloads.select(source, F.explode(F.json_object_keys(payload)).alias("field"), F.lit("key").alias("what"))
    seen = F.filter(
        F.array(*[F.when(F.col(payload).contains(f'"{w}"'), w) for w in watched]), lambda w: w.isNotNull()
    )
    named = payloads.select(source, F.explode(seen).alias("field"), F.lit("watched").alias("what"))
    return tops.unionByName(named).groupBy(source, "what", "field").agg(F.count(F.lit(1)).alias("n"))
