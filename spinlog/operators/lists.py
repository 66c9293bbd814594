"""Bulk edits of ordered lists: a table (list_id, position, uri), positions 0..n-1.

Most edits are arithmetic on positions, so they need no sort and no window:
only the edit instructions are joined in.  Removing items needs running counts;
those are taken per block of positions, never over a whole list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spinlog.errors import EditError

# Items per request, and how many bad URIs an error shows.
CHUNK = 100
SHOWN = 5

BLOCK = 1_000_000  # positions per running-count block: bounds a window whatever the list size


def uri_ok(uri: Column, prefix: str = "app") -> Column:
    return F.coalesce(uri.rlike(rf"^\Q{prefix}\E:(track|episode):"), F.lit(False))


def bad_uris(uris: DataFrame, prefix: str = "app") -> DataFrame:
    """URIs that are neither tracks nor episodes."""
    return uris.where(~uri_ok(F.col("uri"), prefix))


def bad_uri_summary(uris: DataFrame, prefix: str = "app", order: list[str] | None = None) -> DataFrame:
    """One row: the first five bad URIs and how many more there are."""
    bad = bad_uris(uris, prefix)
    order = order or ["uri"]
    first = bad.orderBy(*order).limit(SHOWN)
    shown = first.agg(F.sort_array(F.collect_list(F.struct(*order, F.col("uri").alias("shown_uri"))))["shown_uri"])
    return bad.agg(F.count(F.lit(1)).alias("bad")).select(
        "bad",
        shown.scalar().alias("shown"),
        F.greatest(F.col("bad") - SHOWN, F.lit(0)).alias("more"),
    )


def check_uris(uris: DataFrame, prefix: str = "app") -> None:
    row = bad_uri_summary(uris, prefix).first()
    if row["bad"]:
        more = f" (+{row['more']} more)" if row["more"] else ""
        raise EditError(f"not track or episode URIs: {row['shown']}{more}")


def chunked(items: DataFrame, size: int = CHUNK) -> DataFrame:
    """Request number of each item: batches of `size` in order."""
    return items.withColumn("chunk", F.floor(F.col("position") / size))


def list_sizes(items: DataFrame) -> DataFrame:
    return items.groupBy("list_id").agg(F.count(F.lit(1)).alias("size"))


def stale_edits(edits: DataFrame, versions: DataFrame) -> DataFrame:
    """Edits (list_id, version) made on another version of a list than `versions` (list_id, version) names.

    An edit without a version, or of a list without one, is stale.  One row per list and version.
    """
    now = versions.select("list_id", F.col("version").alias("current"))
    asked = edits.select("list_id", "version").distinct()
    return asked.join(now, "list_id", "left").where(~F.coalesce(F.col("version") == F.col("current"), F.lit(False)))


def check_versions(edits: DataFrame, versions: DataFrame) -> None:
    stale = stale_edits(edits, versions).orderBy("list_id", "version").limit(SHOWN).collect()
    if stale:
        said = ", ".join(f"list {r['list_id']}: {r['version']} given, {r['current']} now" for r in stale)
        raise EditError(f"the list has changed since it was read ({said})")


def append_at(items: DataFrame, additions: DataFrame) -> DataFrame:
    """Add `additions` (list_id, n, uri, at) behind each list, or at `at`; repeats stay.

    n counts the new items of a list from 0.  With a place given, only the
    first request of 100 goes there and the rest to the end.
    """
    edits = additions.groupBy("list_id").agg(F.count(F.lit(1)).alias("added"), F.min("at").alias("at"))
    sizes = list_sizes(items)
    here = F.least(F.col("added"), F.lit(CHUNK))
    moved = items.join(edits, "list_id", "left").select(
        "list_id",
        F.when(F.col("at").isNotNull() & (F.col("position") >= F.col("at")), F.col("position") + here)
        .otherwise(F.col("position"))
        .alias("position"),
        "uri",
    )
    size = F.coalesce("size", F.lit(0))
    new = additions.drop("at").join(edits, "list_id").join(sizes, "list_id", "left").select(
        "list_id",
        F.when(F.col("at").isNotNull() & (F.col("n") < CHUNK), F.least(F.col("at"), size) + F.col("n"))
        .otherwise(size + F.col("n"))
        .alias("position"),
        "uri",
    )
    return moved.unionByName(new)


def append_preview(items: DataFrame, additions: DataFrame) -> DataFrame:
    """Counts per edited list: adding, resulting size, requests."""
    adding = additions.groupBy("list_id").agg(F.count(F.lit(1)).alias("adding"))
    size = F.coalesce("size", F.lit(0))
    return adding.join(list_sizes(items), "list_id", "left").select(
        "list_id", "adding", (size + F.col("adding")).alias("resulting_size"),
        F.ceil(F.col("adding") / CHUNK).alias("requests"),
    )


def replace(items: DataFrame, content: DataFrame, cleared: DataFrame | None = None) -> DataFrame:
    """New content for the lists named in `content` or `cleared` (emptied); others stay."""
    return items.join(_edited(content, cleared), "list_id", "left_anti").unionByName(content.select(*items.columns))


def _edited(content: DataFrame, cleared: DataFrame | None) -> DataFrame:
    named = content.select("list_id")
    return (named if cleared is None else named.unionByName(cleared.select("list_id"))).distinct()


def replace_preview(items: DataFrame, content: DataFrame, cleared: DataFrame | None = None) -> DataFrame:
    """What is lost and what comes, place by place."""
    edited = _edited(content, cleared)
    old = items.join(edited, "list_id", "left_semi").withColumnRenamed("uri", "old_uri")
    new = content.withColumnRenamed("uri", "new_uri")
    return old.join(new, ["list_id", "position"], "full_outer").select("list_id", "position", "old_uri", "new_uri")


def replace_counts(items: DataFrame, content: DataFrame, cleared: DataFrame | None = None) -> DataFrame:
    """Items that go and items that come, per list that is replaced or emptied."""
    adding = content.groupBy("list_id").agg(F.count(F.lit(1)).alias("adding"))
    return (_edited(content, cleared).join(list_sizes(items), "list_id", "left").join(adding, "list_id", "left")
            .select("list_id", F.coalesce("size", F.lit(0)).alias("removing"), F.coalesce("adding", F.lit(0)).alias("adding")))


def reorder(items: DataFrame, moves: DataFrame, versions: DataFrame | None = None) -> DataFrame:
    """Move [range_start, range_start + range_length) before index `insert_before`.

    `moves` has one row per list.  The new place follows from the old one.
    With `versions` (list_id, version), moves carry the version they were made on and stale ones are refused.
    """
    if versions is not None:
        check_versions(moves, versions)
    p, start, length, to = (F.col(c) for c in ("position", "range_start", "range_length", "insert_before"))
    end = start + length
    inside = (p >= start) & (p < end)
    down = F.when(to > end, to - length).when(to < start, to).otherwise(start)
    place = (
        F.when(start.isNull(), p)
        .when(inside, down + (p - start))
        .when((to < start) & (p >= to) & (p < start), p + length)
        .when((to > end) & (p >= end) & (p < to), p - length)
        .otherwise(p)
    )
    return _clip(items, moves).select("list_id", place.alias("position"), "uri")


def _clip(items: DataFrame, moves: DataFrame) -> DataFrame:
    """Moves cut to the lists' sizes, joined to the items."""
    sized = moves.join(list_sizes(items), "list_id").select(
        "list_id",
        F.least("range_start", "size").alias("range_start"),
        F.least(F.col("range_length"), F.greatest(F.col("size") - F.col("range_start"), F.lit(0))).alias("range_length"),
        F.least("insert_before", "size").alias("insert_before"),
    )
    return items.join(sized, "list_id", "left")


def moved_items(items: DataFrame, moves: DataFrame) -> DataFrame:
    """Preview of a move: the items concerned and where they go."""
    start = F.col("range_start")
    inside = (F.col("position") >= start) & (F.col("position") < start + F.col("range_length"))
    return items.join(moves, "list_id").where(inside).select(
        "list_id", F.col("position").alias("from_position"), "uri", F.col("insert_before").alias("to_position")
    )


def remove(items: DataFrame, removals: DataFrame, versions: DataFrame, *, allowed: bool = False) -> DataFrame:
    """Drop every occurrence of the given (list_id, uri, version) and close the gaps.  Off unless allowed.

    `versions` (list_id, version) are the lists' present ones; removals made on another are refused.
    """
    if not allowed:
        raise EditError("removing list items is disabled; pass allowed=True")
    check_versions(removals, versions)
    gone = removals.select("list_id", "uri").distinct().withColumn("_gone", F.lit(1))
    marked = items.join(gone, ["list_id", "uri"], "left").select(
        *items.columns, F.coalesce("_gone", F.lit(0)).alias("_gone"), F.floor(F.col("position") / BLOCK).alias("_block")
    )
    earlier_blocks = Window.partitionBy("list_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = marked.groupBy("list_id", "_block").agg(F.sum("_gone").alias("_n")).select(
        "list_id", "_block", F.coalesce(F.sum("_n").over(earlier_blocks), F.lit(0)).alias("_earlier")
    )
    in_block = Window.partitionBy("list_id", "_block").orderBy("position")
    running = F.sum("_gone").over(in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        marked.withColumn("_before", running)
        .where("_gone = 0")
        .join(blocks, ["list_id", "_block"])
        .select("list_id", (F.col("position") - F.col("_before") - F.col("_earlier")).alias("position"), "uri")
    )


def remove_preview(items: DataFrame, removals: DataFrame) -> DataFrame:
    """Counts as announced before a removal: the size less the URIs named, not below zero."""
    named = removals.groupBy("list_id").agg(F.count(F.lit(1)).alias("removing"))
    size = F.coalesce("size", F.lit(0))
    return named.join(list_sizes(items), "list_id", "left").select(
        "list_id", "removing", F.greatest(size - F.col("removing"), F.lit(0)).alias("resulting_size")
    )


def details_diff(current: DataFrame, wanted: DataFrame) -> DataFrame:
    """Changed fields only, as (field, from, to); a NULL in `wanted` leaves the field alone.

    Lists with nothing to change come out with an empty array and `changed` false.
    """
    fields = ["name", "description", "public"]

    def change(field: str) -> Column:
        old, new = F.col(f"c.{field}"), F.col(f"w.{field}")
        pair = F.struct(F.lit(field).alias("field"), old.cast("string").alias("from"), new.cast("string").alias("to"))
        return F.when(new.isNotNull() & ~new.eqNullSafe(old), pair)

    changes = F.array_compact(F.array(*[change(f) for f in fields]))
    return (
        wanted.alias("w")
        .join(current.alias("c"), "list_id")
        .select("list_id", changes.alias("changes"))
        .withColumn("changed", F.size("changes") > 0)
    )


def create_lists(specs: DataFrame) -> DataFrame:
    """New, empty lists (list_id, name, description, public, collaborative); never public and collaborative."""
    clash = F.col("public") & F.col("collaborative")
    if not specs.where(clash).isEmpty():
        raise EditError("a list cannot be both collaborative and public")
    return specs.select(
        "list_id", "name", F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("public", F.lit(False)).alias("public"),
        F.coalesce("collaborative", F.lit(False)).alias("collaborative"),
    )
