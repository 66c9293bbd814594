"""Candidates -> catalogue tracks: cache, two search passes, strict gate.

Every candidate ends up exactly once in the outcome, as resolved or unresolved.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spinlog.errors import CandidateError
from spinlog.operators import cache as C
from spinlog.operators.match import STAGES, TIERS, WANTED, catalog_index, of_artists, search, wanted_keys
from spinlog.session import materialize

LOW_CONFIDENCE = 0.7
REJECTED_SHOWN = 5

CACHED_NEGATIVE = "the cache says: nothing fits"
CACHED_WEAK = "the cache has a similar title only, not enough in strict mode"
WEAK = "a similar title only, not enough in strict mode"
NO_MATCH = "nothing fits, with or without the year"


def bad_candidates(candidates: DataFrame) -> DataFrame:
    empty = [F.coalesce(F.col(c), F.lit("")) == "" for c in ("artist", "title")]
    return candidates.where(empty[0] | empty[1])


def check_candidates(candidates: DataFrame) -> None:
    if candidates.isEmpty():
        raise CandidateError("there are no candidates")
    bad = bad_candidates(candidates).limit(1).collect()
    if bad:
        raise CandidateError(f"a candidate needs a non-empty artist and title: {bad[0].asDict()}")


def names_of(codes: dict[int, str], column: str):
    return F.create_map(*[F.lit(x) for x in chain(*codes.items())])[F.col(column)]


def verified_artists(hits: DataFrame, found: DataFrame) -> DataFrame:
    """artist_norm -> artist id: from the cache first, else from the first input that matched.

    Folded by min(struct), so a hot artist costs one row per task.
    """
    known = hits.select("artist_norm", F.lit(0).alias("src"), "first_idx", F.col("hit.artist_id").alias("artist_id"))
    matched = found.select("artist_norm", F.lit(1).alias("src"), "first_idx", F.col("best.artist_id").alias("artist_id"))
    return (
        known.unionByName(matched)
        .where(F.col("artist_id").isNotNull())
        .groupBy("artist_norm")
        .agg(F.min(F.struct("src", "first_idx", "artist_id"))["artist_id"].alias("artist_key"))
    )


def first_tracks(artists: DataFrame, index: DataFrame, count: int = REJECTED_SHOWN) -> DataFrame:
    """The first tracks of each artist, at most `count`.

    The rank comes before the join: its filter then runs ahead of the shuffle,
    and no task ever holds all tracks of a hot artist.
    """
    rank = F.row_number().over(Window.partitionBy("artist_norm").orderBy("track_id", "artist_pos"))
    tracks = index.select("artist_norm", "track_id", "artist_pos", "uri")
    few = (
        of_artists(tracks, artists, "artist_norm")
        .withColumn("rank", rank)
        .where(F.col("rank") <= count)
    )
    return few.groupBy("artist_norm").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "uri"))), lambda s: s["uri"]).alias("shown")
    )


@dataclass
class Resolution:
    outcome: DataFrame  # one row per candidate
    new_cache: DataFrame  # rows to upsert; the true confidence, whatever `strict` is


def resolve(
    candidates: DataFrame,
    catalog: DataFrame | None = None,
    *,
    index: DataFrame | None = None,
    cache: DataFrame | None = None,
    as_of: dt.datetime | None = None,
    strict: bool = True,
    validate: bool = True,
) -> Resolution:
    """`candidates`: input_idx, artist, title, album, year.  Pass an `index` table if there is one.

    Intermediate results are written to the shared folder: they are read more
    than once, and a lost executor then costs a re-read, not a re-run.
    """
    spark = candidates.sparkSession
    if validate:
        check_candidates(candidates)
    as_of = as_of or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    if index is None:
        index = materialize(catalog_index(catalog), "catalog")
    cache = cache if cache is not None else spark.createDataFrame([], C.CACHE)

    asked = materialize(wanted_keys(candidates), "asked")
    # Copies of a request, however many, become one key before any join.
    wanted = asked.groupBy(*WANTED, "norm_key").agg(F.min("input_idx").alias("first_idx"))
    looked = materialize(C.lookup(wanted, cache, as_of), "looked")
    hits, misses = looked.where("hit is not null"), looked.where("hit is null").drop("hit")

    keyed = misses.select(*WANTED, F.col("artist_norm").alias("artist_key"))
    by_name = search(keyed, index, "artist_norm")

    accepted = F.lit(True) if not strict else F.col("hit.confidence") != "weak"
    usable = hits.where(~F.col("hit.is_negative") & accepted)
    verified = verified_artists(usable, by_name.join(misses, WANTED))
    # Where the artist is verified, what carries the id competes with what carries the name.
    left = materialize(misses.join(verified, "artist_norm").select(*WANTED, "artist_key"), "left")
    found = by_name
    if not left.isEmpty():
        better = F.min(F.struct("stage", (-F.col("tier")).alias("neg_tier"), "best")).alias("m")
        found = (
            by_name.unionByName(search(left, index, "artist_id")).groupBy(*WANTED).agg(better)
            .select(*WANTED, "m.stage", (-F.col("m.neg_tier")).alias("tier"), "m.best")
        )

    answers = misses.join(found, WANTED, "left").select(
        *WANTED, "norm_key", "first_idx",
        F.col("best").isNull().alias("is_negative"),
        F.col("best.uri").alias("track_uri"), F.col("best.track_id").alias("track_id"),
        F.col("best.artist_id").alias("artist_id"),
        F.col("best.artist_name").alias("matched_artist_name"), F.col("best.name").alias("matched_title"),
        F.col("best.isrc").alias("isrc"),
        names_of(TIERS, "tier").alias("confidence"),
        F.coalesce(names_of(STAGES, "stage"), F.lit(STAGES[3])).alias("method"),
        F.lit(as_of).cast("timestamp_ntz").alias("resolved_at"),
        F.coalesce("stage", F.lit(3)).alias("search_calls"),
        F.lit(False).alias("cached"),
    )
    from_cache = hits.select(*WANTED, "norm_key", "first_idx", "hit.*", F.lit(True).alias("cached"))
    everything = answers.unionByName(from_cache)
    shown = first_tracks(answers.where("is_negative").select("artist_norm").distinct(), index)
    outcome = judge(asked, everything, shown, strict)

    columns = [f.name for f in C.CACHE]
    entry = F.min(F.struct("first_idx", *[c for c in columns if c != "norm_key"])).alias("e")
    new_cache = answers.groupBy("norm_key").agg(entry).select("norm_key", "e.*").select(*columns)
    return Resolution(outcome, new_cache)


def judge(asked: DataFrame, answers: DataFrame, shown: DataFrame, strict: bool) -> DataFrame:
    """The strict gate, reasons and rejected URIs, back on the original rows.

    The last join only fans answers out to copies of a request; the side with
    copies may be skewed and adaptive execution may split it freely.
    """
    weak = (F.col("confidence") == "weak") & F.lit(strict)
    reason = (
        F.when(F.col("is_negative"), F.when(F.col("cached"), CACHED_NEGATIVE).otherwise(NO_MATCH))
        .when(weak, F.when(F.col("cached"), CACHED_WEAK).otherwise(WEAK))
    )
    none = F.array().cast("array<string>")
    rejected = (
        F.when(F.col("is_negative") & ~F.col("cached"), F.coalesce("shown", none))
        .when(weak & F.col("track_uri").isNotNull(), F.array("track_uri"))
        .otherwise(none)
    )
    judged = (
        answers.join(shown, "artist_norm", "left")
        .withColumns({"reason": reason, "rejected": rejected})
        .withColumn("ok", F.col("reason").isNull())
    )
    payload = judged.select(
        *WANTED, "ok", "reason", "rejected", "cached", "track_uri", "track_id", "matched_artist_name",
        "matched_title", "isrc", "confidence", "method",
    )
    rows = asked.join(payload, WANTED)

    def if_ok(value):
        return F.when(F.col("ok"), value)

    return rows.select(
        "input_idx", "artist", "title", "album", "year",
        F.when(F.col("ok"), "resolved").otherwise("unresolved").alias("status"),
        if_ok(F.col("track_uri")).alias("uri"),
        if_ok(F.col("track_id")).alias("track_id"),
        if_ok(F.coalesce("matched_artist_name", "artist")).alias("matched_artist"),
        if_ok(F.coalesce("matched_title", "title")).alias("matched_title"),
        if_ok(F.col("isrc")).alias("isrc"),
        if_ok(F.col("confidence")).alias("confidence"),
        if_ok(F.when(F.col("cached"), "cache").otherwise(F.col("method"))).alias("method"),
        "reason",
        F.col("rejected").alias("rejected_candidates"),
    )


def resolution_stats(outcome: DataFrame, low_below: float = LOW_CONFIDENCE) -> DataFrame:
    """One row; no candidates at all count as a rate of 1."""
    total = F.count(F.lit(1))
    good = F.count_if(F.col("status") == "resolved")
    rate = F.when(total == 0, F.lit(1.0)).otherwise(good / F.nullif(total, F.lit(0)))
    return outcome.agg(
        total.alias("total"),
        good.alias("resolved"),
        (total - good).alias("unresolved"),
        F.round(rate, 3).alias("resolution_rate"),
        (rate < low_below).alias("low_confidence"),
    )
