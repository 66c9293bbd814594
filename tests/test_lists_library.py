"""List edits, catalogue reads and the audit log."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from spinlog.errors import EditError
from spinlog.operators import audit
from spinlog.operators import library as B
from spinlog.operators import lists as L
from spinlog.operators.topk import top_per_label
from spinlog.sources import pages

ITEM = "list_id long, position long, uri string"


def make(spark, **lists):
    rows = [(int(k[1:]), n, f"app:track:{u}") for k, uris in lists.items() for n, u in enumerate(uris)]
    return spark.createDataFrame(rows, ITEM)


def content(df, list_id=1):
    rows = df.where(F.col("list_id") == list_id).orderBy("position").collect()
    assert [r.position for r in rows] == list(range(len(rows)))
    return "".join(r.uri.split(":")[-1] for r in rows)


def edit(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_append(spark):
    items = make(spark, l1="abc", l2="xy")
    new = edit(spark, "list_id long, n long, uri string, at long", *[(1, n, f"app:track:{c}", None) for n, c in enumerate("defgh")])
    assert content(L.append_at(items, new)) == "abcdefgh" and content(L.append_at(items, new), 2) == "xy"
    assert tuple(L.append_preview(items, new).first()) == (1, 5, 8, 1)
    at = new.withColumn("at", F.lit(1).cast("long"))
    assert content(L.append_at(items, at)) == "adefghbc"
    beyond = new.withColumn("at", F.lit(99).cast("long"))
    assert content(L.append_at(items, beyond)) == "abcdefgh"
    fresh = new.withColumn("list_id", F.lit(7).cast("long"))
    assert content(L.append_at(items, fresh), 7) == "defgh"


def test_append_of_150_goes_in_two_requests(spark):
    items = make(spark, l1="abc")
    new = spark.range(150).selectExpr("1L as list_id", "id as n", "concat('app:track:', id) as uri", "1L as at")
    out = [r.uri.split(":")[-1] for r in L.append_at(items, new).orderBy("position").collect()]
    assert out == ["a", *map(str, range(100)), "b", "c", *map(str, range(100, 150))]
    chunks = L.chunked(new.withColumnRenamed("n", "position")).groupBy("chunk").count().orderBy("chunk").collect()
    assert [tuple(r) for r in chunks] == [(0, 100), (1, 50)]
    assert L.append_preview(items, new).first().requests == 2


def test_replace_and_clear(spark):
    items = make(spark, l1="abc", l2="xy", l3="m")
    out = L.replace(items, make(spark, l1="zz"), edit(spark, "list_id long", (3,)))
    assert (content(out), content(out, 2), content(out, 3)) == ("zz", "xy", "")


def test_replace_preview_names_emptied_lists(spark):
    items, new, empty = make(spark, l1="abc", l2="xy", l3="m"), make(spark, l1="zz", l4="q"), edit(spark, "list_id long", (3,))
    counts = L.replace_counts(items, new, empty).orderBy("list_id").collect()
    assert [tuple(r) for r in counts] == [(1, 3, 2), (3, 1, 0), (4, 0, 1)]
    places = L.replace_preview(items, new, empty).where("list_id = 3").collect()
    assert [tuple(r) for r in places] == [(3, 0, "app:track:m", None)]


def test_reorder_of_a_changed_list_is_refused(spark):
    moves = edit(spark, "list_id long, range_start long, range_length long, insert_before long, version string", (1, 0, 1, 3, None))
    now = edit(spark, "list_id long, version string", (1, "v2"))
    items = make(spark, l1="abc")
    with pytest.raises(EditError, match="changed since"):
        L.reorder(items, moves, now)
    assert content(L.reorder(items, moves.withColumn("version", F.lit("v2")), now)) == "bca"


@pytest.mark.parametrize(("start", "length", "to", "want"), [
    (0, 1, 3, "bcadef"), (0, 2, 6, "cdefab"), (4, 2, 0, "efabcd"), (2, 2, 2, "abcdef"), (2, 2, 3, "abcdef"), (2, 2, 4, "abcdef"),
    (5, 9, 0, "fabcde"), (1, 1, 99, "acdefb"), (9, 2, 0, "abcdef"), (3, 1, 1, "adbcef"),
])
def test_reorder(spark, start, length, to, want):
    moves = edit(spark, "list_id long, range_start long, range_length long, insert_before long", (1, start, length, to))
    out = L.reorder(make(spark, l1="abcdef", l2="xy"), moves)
    assert (content(out), content(out, 2)) == (want, "xy")


def test_remove(spark, monkeypatch):
    items = make(spark, l1="abcabcabdd", l2="aab")
    gone = edit(spark, "list_id long, uri string, version string", (1, "app:track:a", "v2"), (1, "app:track:d", "v2"), (1, "app:track:d", "v2"))
    now = edit(spark, "list_id long, version string", (1, "v2"), (2, "v9"))
    with pytest.raises(EditError, match="disabled"):
        L.remove(items, gone, now)
    for known in (now.withColumn("version", F.lit("v3")), now.where("list_id = 2")):
        with pytest.raises(EditError, match="list 1: v2 given"):
            L.remove(items, gone, known, allowed=True)
    for block in (1_000_000, 3, 1):
        monkeypatch.setattr(L, "BLOCK", block)
        out = L.remove(items, gone, now, allowed=True)
        assert (content(out), content(out, 2)) == ("bcbcb", "aab")
    assert tuple(L.remove_preview(items, gone).first()) == (1, 3, 7)


def test_uris(spark):
    good = ["app:track:1", "app:episode:2"]
    uris = edit(spark, "uri string", *[(u,) for u in [*good, "app:album:1", "x", "other:track:1", "", None, "app:track", "app:trackx:1"]])
    row = L.bad_uri_summary(uris).first()
    assert (row.bad, row.more, len(row.shown)) == (7, 2, 5)
    L.check_uris(edit(spark, "uri string", *[(u,) for u in good]))
    with pytest.raises(EditError, match=r"\+2 more"):
        L.check_uris(uris)


def test_details_and_create(spark):
    schema = "list_id long, name string, description string, public boolean"
    now = edit(spark, schema, (1, "A", None, False), (2, "B", "d", True))
    rows = L.details_diff(now, edit(spark, schema, (1, "A", "new", True), (2, None, "d", None))).orderBy("list_id").collect()
    assert [tuple(c) for c in rows[0].changes] == [("description", None, "new"), ("public", "false", "true")]
    assert not rows[1].changed
    specs = schema + ", collaborative boolean"
    assert tuple(L.create_lists(edit(spark, specs, (1, "N", None, None, True))).first()) == (1, "N", "", False, True)
    with pytest.raises(EditError):
        L.create_lists(edit(spark, specs, (1, "N", None, True, True)))


def test_top_per_label_beyond_the_group_limit(spark):
    df = spark.range(3000).selectExpr("id", "if(id % 10 = 0, 'a', 'b') as label")
    small = top_per_label(df, "label", ["a", "b"], [F.col("id").desc()], 3)
    assert sorted((r.label, r.id, r.rank) for r in small.collect())[:3] == [("a", 2970, 3), ("a", 2980, 2), ("a", 2990, 1)]
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    big = top_per_label(df, "label", ["a", "b"], [F.col("id").desc()], 1500)
    assert big.where("label = 'a'").count() == 300 and big.where("label = 'b'").count() == 1500


def test_search_arguments(spark):
    tables = {"track": spark.createDataFrame([], "id string, name string, uri string")}
    with pytest.raises(ValueError, match="at least one"):
        B.catalog_search(tables)
    with pytest.raises(ValueError, match="unsupported search type"):
        B.catalog_search(tables, track="x", types=["track", "show"])
    with pytest.raises(ValueError, match="exclude each other"):
        B.recent_plays(tables["track"], after_ms=1, before_ms=2)
    with pytest.raises(ValueError, match="time_range"):
        B.top_items(tables["track"], time_range="forever")
    with pytest.raises(ValueError, match="include_groups"):
        B.artist_albums(spark.createDataFrame([], "id string, artists array<struct<id:string>>, album_type string, release_date string"), "a", "album,demo")


def test_pages_skip_malformed_items(spark):
    good = {"id": "1", "name": "N", "uri": "u", "duration_ms": 5, "artists": [{"id": "a", "name": "A", "uri": "u"}], "new": {"x": 1}}
    bad = [{**good, "id": None}, {k: v for k, v in good.items() if k != "uri"}, {**good, "duration_ms": "long"}, 7, None]
    body = json.dumps({"items": [{"added_at": "d1", "track": good}, *[{"added_at": "d", "track": b} for b in bad]], "next": None})
    df = spark.createDataFrame([(body,), ('{"items":[]}',), ("{}",), ("broken",)], "payload string")
    rows = pages.flatten_pages(df, "tracks", wrapper="track").collect()
    assert [(r.id, r.added_at, r.artist_name, r.explicit, r.album_name) for r in rows] == [("1", "d1", "A", False, None)]


def test_audit_lines(spark, tmp_path):
    edits = edit(spark, "list_id string, name string, edited_at string, outcome string, snapshot_id string",
                 ("1", None, "2024-01-02 03:04:05", "executed", "s1"), ("1", None, "2024-01-02 03:04:06", "dry_run", None))
    edits = edits.withColumn("edited_at", F.col("edited_at").cast("timestamp_ntz"))
    path = str(tmp_path / "audit")
    for _ in range(2):
        audit.append_audit(audit.audit_rows(edits, "rename", ["name", "list_id"]), path)
    rows = spark.read.json(path).collect()
    assert len(rows) == 4 and len({r.payload_hash for r in rows}) == 1
    assert {(r.ts, r.outcome, r.snapshot_id) for r in rows} == {
        ("2024-01-02T03:04:05Z", "executed", "s1"), ("2024-01-02T03:04:06Z", "dry_run", None)}
