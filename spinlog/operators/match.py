"""Matching wanted {artist, title} keys with catalogue tracks.

A track counts only if a credited artist matches, no uncalled-for mark is in
its title or album, and the title is equal (exact), equal without its endings
(strong) or similar (weak).

Nothing here pairs up all rows of an artist.  Catalogue rows that no test can
tell apart are folded to their best one *before* the join, on the map side, so
a hot (artist, title) group arrives as a handful of rows; similar titles meet
through signature keys only.

Computed arrays are exploded with the outer form: for the inner one the
optimizer infers a filter on the array and would compute it a second time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spinlog.functions import fuzzy, markers
from spinlog.functions.text import normalize_text, strip_suffixes
from spinlog.session import materialize, spread

WANTED = ["artist_norm", "title_norm", "excused_album", "want_year"]
TIERS = {3: "exact", 2: "strong", 1: "weak"}
STAGES = {1: "search", 2: "search_offset", 3: "search_relaxed"}

_PICK = ["release", "track_id", "artist_pos", "artist_id", "artist_name", "uri", "name", "isrc"]
_MASKS = ["title_mask", "album_mask"]


def catalog_index(catalog: DataFrame) -> DataFrame:
    """Nested tracks -> one row per (track, credited artist) with its comparison forms.

    Build it once per catalogue and keep it as a table; every lookup reads it.
    """
    flat = spread(catalog).select(
        F.col("id").alias("track_id"),
        "uri",
        "name",
        F.col("external_ids.isrc").alias("isrc"),
        F.coalesce(F.nullif(F.col("album.release_date"), F.lit("")), F.lit("9999-99-99")).alias("release"),
        F.substring("album.release_date", 1, 4).alias("year"),
        normalize_text(F.col("name")).alias("title_norm"),
        normalize_text(strip_suffixes(F.col("name"))).alias("stripped_norm"),
        normalize_text(F.col("album.name")).alias("album_norm"),
        "artists",
    )
    masked = flat.select(
        "*",
        markers.found_mask(F.col("title_norm")).alias("title_mask"),
        markers.found_mask(F.col("album_norm")).alias("album_mask"),
    ).drop("album_norm")
    credited = masked.select("*", F.posexplode("artists").alias("artist_pos", "artist")).drop("artists")
    return credited.select(
        "*",
        F.col("artist.id").alias("artist_id"),
        F.col("artist.name").alias("artist_name"),
        normalize_text(F.col("artist.name")).alias("artist_norm"),
    ).drop("artist")


def wanted_keys(candidates: DataFrame) -> DataFrame:
    """Candidates with their comparison forms; equal requests get equal keys."""
    return spread(candidates).select(
        "*",
        normalize_text(F.col("artist")).alias("artist_norm"),
        normalize_text(F.col("title")).alias("title_norm"),
        normalize_text(F.col("album")).alias("_album_norm"),
    ).select(
        "*",
        markers.excused_mask(F.col("_album_norm")).alias("excused_album"),
        F.coalesce("year", F.lit("")).alias("want_year"),
        F.concat_ws("|", "artist_norm", "title_norm").alias("norm_key"),
    ).drop("_album_norm")


def _allowed() -> Column:
    return ~markers.uncalled_for(F.col("title_mask"), F.col("excused_title")) & ~markers.uncalled_for(
        F.col("album_mask"), F.col("excused_album")
    )


def _best() -> Column:
    """Earlier release first, then catalogue order, then credit order."""
    return F.min(F.struct(*_PICK)).alias("best")


def of_artists(credits: DataFrame, wanted: DataFrame, on: str = "artist_key") -> DataFrame:
    """Rows of wanted artists; a hot artist's rows may be split freely."""
    return credits.join(wanted.select(on).distinct(), on, "left_semi")


def exact_and_strong(wanted: DataFrame, index: DataFrame, artist_key: str) -> DataFrame:
    """The best exact or strong match of each wanted key, with its search stage.

    Stage 1 takes equal titles, stage 2 titles equal without endings, both of
    the wanted year if one is given; stage 3 drops the year.
    """
    same = F.struct(F.col("title_norm").alias("key"), F.lit(3).alias("tier"))
    shorter = F.struct(F.col("stripped_norm").alias("key"), F.lit(2).alias("tier"))
    forms = F.when(F.col("title_norm") == F.col("stripped_norm"), F.array(same)).otherwise(F.array(same, shorter))
    credits = of_artists(index.withColumnRenamed(artist_key, "artist_key"), wanted)
    tracks = (
        credits.withColumn("form", F.explode_outer(forms))
        .withColumns({p: F.col(p) if p != artist_key else F.col("artist_key") for p in _PICK})
        .groupBy("artist_key", F.col("form.key").alias("title_key"), F.col("form.tier").alias("tier"), "year", *_MASKS)
        .agg(_best())
    )
    right_year = (F.col("want_year") == "") | (F.col("want_year") == F.col("year"))
    stage = F.when(~right_year, 3).when(F.col("tier") == 3, 1).otherwise(2)
    return (
        wanted.withColumn("title_key", F.col("title_norm"))
        .join(tracks, ["artist_key", "title_key"])
        .where(_allowed())
        .groupBy(*WANTED)
        .agg(F.min(F.struct(stage.alias("stage"), (-F.col("tier")).alias("neg_tier"), "best")).alias("m"))
        .select(*WANTED, "m.stage", (-F.col("m.neg_tier")).alias("tier"), "m.best")
    )


CROWDED = 2_000
BROADCAST_BLOCKS = 1_000_000  # of 16 bytes


def in_cells(probes: DataFrame, titles: DataFrame, on: list[str], limit: int = CROWDED) -> tuple[DataFrame, DataFrame]:
    """Both sides with `probe_cell` and `title_cell` to join on beside `on`, so that no block is one task's work.

    Blocks with more than `limit` rows on a side are cut there into cells by a hash of the row; a row goes to every
    cell of the other side, so each pair meets in exactly one.  Sizes are measured, by a hash of `on`: blocks that
    share a hash are cut alike.  Both sides come dealt by number, for adaptive execution sizes tasks by compressed
    bytes, and copies of titles compress to almost none.
    """
    tasks = int(probes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = F.xxhash64(*on).alias("block")
    sizes = probes.select(block, F.lit(1).alias("p"), F.lit(0).alias("t")).unionByName(
        titles.select(block, F.lit(0).alias("p"), F.lit(1).alias("t")))
    cells = [F.ceil(F.sum(side) / limit).cast("int").alias(name) for side, name in (("p", "probe_cells"), ("t", "title_cells"))]
    crowded = materialize(
        sizes.groupBy("block").agg(*cells).where((F.col("probe_cells") > 1) | (F.col("title_cells") > 1))
        .select("block", *[F.greatest(c, F.lit(1)).alias(c) for c in ("probe_cells", "title_cells")]), "crowded")
    few = crowded.count()
    if not few:
        return tuple(side.repartition(tasks, *on).withColumns({"probe_cell": F.lit(0), "title_cell": F.lit(0)}) for side in (probes, titles))
    if few <= BROADCAST_BLOCKS:
        crowded = F.broadcast(crowded)

    def cut(side: DataFrame, own: str, other: str) -> DataFrame:
        row = F.xxhash64(*[c for c in side.columns if side.schema[c].dataType.typeName() != "struct"])
        count = {c: F.coalesce(F.col(f"{c}_cells"), F.lit(1)) for c in (own, other)}
        placed = side.withColumn("block", block).join(crowded, "block", "left").withColumn(
            f"{own}_cell", F.pmod(row, count[own]).cast("int"))
        every = F.explode_outer(F.sequence(F.lit(0), count[other] - 1))
        celled = placed.withColumn(f"{other}_cell", every).drop("block", "probe_cells", "title_cells")
        return celled.repartition(tasks, *on, "probe_cell", "title_cell")

    return cut(probes, "probe", "title"), cut(titles, "title", "probe")


def signed(rows: DataFrame, text: str, label: str) -> DataFrame:
    """A row per signature of its text; they are computed once, by many tasks, and stored."""
    stored = materialize(spread(rows).withColumn("signatures", fuzzy.signatures(F.col(text))), label)
    return stored.withColumn("signature", F.explode_outer("signatures")).drop("signatures")


def weak_pairs(wanted: DataFrame, index: DataFrame, artist_key: str, limit: int = CROWDED) -> DataFrame:
    """Distinct (wanted, catalogue title) pairs that may reach the ratio; none that does is missing."""
    credits = of_artists(index.withColumnRenamed(artist_key, "artist_key"), wanted)
    folded = (
        credits.withColumns({p: F.col(p) if p != artist_key else F.col("artist_key") for p in _PICK})
        .groupBy("artist_key", "stripped_norm", *_MASKS)
        .agg(_best())
    )
    # Written once with their signatures, for both the sizes of blocks and the join read them.
    titles = signed(folded, "stripped_norm", "titles")
    probes = signed(wanted, "title_norm", "probes")
    lengths = fuzzy.length_fits(F.length("title_norm"), F.length("stripped_norm"))
    on = ["artist_key", "signature"]
    probes, titles = in_cells(*(side.where(F.col("signature").isNotNull()) for side in (probes, titles)), on, limit)
    return (
        probes.join(titles, [*on, "probe_cell", "title_cell"])
        .where(lengths & _allowed())
        .select(*WANTED, "stripped_norm", *_MASKS, "best")
        .dropDuplicates([*WANTED, "stripped_norm", *_MASKS])
    )


FIRST_TRIED = 16


def similar_enough(pairs: DataFrame) -> DataFrame:
    """The best catalogue title that reaches the ratio, per wanted key."""
    ratio = fuzzy.fuzzy_ratio(F.col("title_norm"), F.col("stripped_norm"), fuzzy.WEAK_RATIO)
    return (
        pairs.withColumn("ratio", ratio)
        .where(F.col("ratio") >= fuzzy.WEAK_RATIO)
        .groupBy(*WANTED)
        .agg(F.min("best").alias("best"))
    )


def weak(wanted: DataFrame, index: DataFrame, artist_key: str) -> DataFrame:
    """Similar titles.  The best one is the first in catalogue order, not the most similar.

    So the first few pairs of a key are tried before all others: where many
    titles are alike one of them fits, and the rest need no ratio.  Keys still
    open then get all their pairs tried.
    """
    pairs = materialize(weak_pairs(wanted, index, artist_key), "pairs")
    columns = [*WANTED, F.lit(3).alias("stage"), F.lit(1).alias("tier"), "best"]
    place = F.row_number().over(Window.partitionBy(*WANTED).orderBy("best"))
    head = pairs.withColumn("place", place).where(F.col("place") <= FIRST_TRIED).drop("place")
    early = materialize(similar_enough(head), "early")
    open_pairs = pairs.join(early.select(*WANTED), WANTED, "left_anti")
    found = early
    if not open_pairs.isEmpty():
        found = early.unionByName(materialize(similar_enough(open_pairs), "late"))
    return found.select(*columns)


def search(wanted: DataFrame, index: DataFrame, artist_key: str) -> DataFrame:
    """All tiers; the similar ones only for keys with no better match.

    `wanted` has WANTED plus `artist_key`; `artist_key` names the index column
    it is compared with (`artist_norm` or `artist_id`).  The result is made of
    written tables; stages nothing is left for are not run.
    """
    wanted = wanted.withColumn("excused_title", markers.excused_mask(F.col("title_norm")))
    first = materialize(exact_and_strong(wanted, index, artist_key), "first")
    rest = materialize(wanted.join(first.select(*WANTED), WANTED, "left_anti"), "rest")
    return first if rest.isEmpty() else first.unionByName(weak(rest, index, artist_key))
