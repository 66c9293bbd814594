"""Ingest rules on small hand-made exports."""

from __future__ import annotations

import datetime as dt
import json

import pytest

from spinlog.errors import IngestError
from spinlog.operators import plays as P
from spinlog.plans.ingest import check_zone, ingest
from spinlog.plans.queries import listening_summary, store_status
from spinlog.plans.views import VIEWS
from spinlog.schema import PLAYS, ExportFormat
from spinlog.sources import export
from spinlog.sources.store import HistoryStore

FMT = ExportFormat("app")


def record(n: int = 1, **changes) -> dict:
    base = {
        "ts": f"2024-03-{n:02d}T10:00:00Z", "ms_played": 200000, "master_metadata_track_name": f"Song {n}",
        "master_metadata_album_artist_name": "Artist", "master_metadata_album_album_name": "Album",
        "app_track_uri": f"app:track:{n}", "episode_name": None, "episode_show_name": None,
        "app_episode_uri": None, "reason_start": "clickrow", "reason_end": "trackdone", "shuffle": False,
        "skipped": None, "offline": False, "incognito_mode": False, "platform": "x", "conn_country": "HR",
        "ip_addr": "10.0.0.1", "username": "u",
    }
    return {**base, **changes}


@pytest.fixture
def place(spark, tmp_path):
    class Place:
        dir = tmp_path / "export"
        store = HistoryStore(spark, str(tmp_path / "store"))

        def put(self, name: str, content) -> None:
            self.dir.mkdir(exist_ok=True)
            (self.dir / name).write_text(content if isinstance(content, str) else json.dumps(content))

        def load(self, **options):
            return ingest(self.store, str(self.dir), fmt=FMT, **options)

        def rows(self, *columns):
            return [tuple(r) for r in self.store.plays().orderBy("play_id").select(*columns).collect()]

    return Place()


def test_directory_must_exist_and_hold_files(place):
    with pytest.raises(IngestError, match="not a readable directory"):
        place.load()
    place.put("notes.txt", "x")
    with pytest.raises(IngestError, match="no .* files"):
        place.load()


@pytest.mark.parametrize(
    ("content", "message"),
    [
        ([record(1), {k: v for k, v in record(2).items() if k != "ms_played"}], r"a\.json\[1\]: without ms_played"),
        ('{"not": "a list"}', r"a\.json: .*no array of records"),
        ([record(1), "not an object"], r"a\.json\[1\]: this entry is no record"),
        ([record(1), None], r"a\.json\[1\]: this entry is no record"),
        ([record(1), 5], r"a\.json\[1\]: this entry is no record"),
        ([record(1), json.dumps(record(2))], r"a\.json: a text stands"),
        ("{not valid json", r"a\.json: no JSON in it"),
        ("", r"a\.json: no JSON in it"),
        (json.dumps([record(1)]) + " trailing", r"a\.json: no JSON in it"),
        (json.dumps([record(1)]) + "," + json.dumps([record(2)]), r"a\.json: no JSON in it"),
    ],
)
def test_bad_files_fail_loudly_and_leave_nothing(place, content, message):
    place.put("a.json", content)
    place.put("b.json", [record(3)])
    with pytest.raises(IngestError, match=message):
        place.load()
    assert place.store.last_run() == 0


def test_a_mended_file_loads_after_a_failure(place):
    place.put("a.json", [record(1), 5])
    place.put("b.json", [record(3)])
    with pytest.raises(IngestError):
        place.load()
    assert place.store.plays() is None
    assert place.store.raw_plays().count() == 0
    assert place.store.ingested_files().count() == 0
    place.put("a.json", [record(1)])
    assert place.load().total_plays_after_rebuild == 2


def test_failed_run_keeps_the_previous_state(place):
    place.put("a.json", [record(1)])
    place.load()
    place.put("b.json", [record(2), {"ts": None}])
    with pytest.raises(IngestError):
        place.load()
    assert place.rows("track_id") == [("1",)]
    assert place.store.raw_plays().count() == 1


def test_unreadable_time_fails_the_run(place):
    place.put("a.json", [record(1, ts="yesterday")])
    with pytest.raises(Exception, match="yesterday"):
        place.load()
    assert place.store.plays() is None


def test_unknown_zone(place):
    place.put("a.json", [record(1)])
    with pytest.raises(IngestError, match="IANA"):
        place.load(local_timezone="Not/A_Real_Zone")
    assert check_zone("Europe/Zagreb") == "Europe/Zagreb"


def test_unknown_fields_are_kept_and_reported(place):
    place.put("a.json", [record(1, brand_new=1), record(2, other={"x": 1})])
    report = place.load()
    assert report.unknown_fields == ["brand_new", "other"]
    run = place.store.runs().first()
    assert run.status == "ok_with_warnings" and run.unknown_fields == ["brand_new", "other"]
    payloads = [json.loads(r.payload) for r in place.store.raw_plays().collect()]
    assert {"brand_new", "other"} <= set().union(*payloads)


def test_same_export_twice_and_a_new_file(place):
    place.put("a.json", [record(1), record(2)])
    first = place.load()
    assert (first.run_id, first.files_ingested, first.rows_inserted) == (1, 1, 2)
    again = place.load()
    assert (again.files_ingested, again.files_skipped_already_ingested, again.rows_inserted) == (0, 1, 0)
    assert again.total_plays_after_rebuild == 2
    place.put("b.json", [record(3)])
    more = place.load()
    assert (more.files_ingested, more.files_skipped_already_ingested, more.rows_inserted) == (1, 1, 1)
    assert more.total_plays_after_rebuild == 3


def test_a_run_without_new_files_writes_no_fact_rows(place):
    place.put("a.json", [record(1), record(2, ms_played=40000)])
    place.load()
    before = place.store.last()["plays_version"]
    place.load()
    assert place.store.last()["plays_version"] == before and len(place.rows("track_id")) == 2
    assert place.load(substantial_ms=50000).total_plays_after_rebuild == 2  # other settings: built anew
    assert place.store.last()["plays_version"] != before
    assert place.rows("is_substantial") == [(True,), (False,)]
    assert place.store.raw_plays().count() == 2


def test_raw_rows_are_never_overwritten(place, tmp_path):
    place.put("a.json", [record(1)])
    place.load()
    kept = {f for f in (tmp_path / "store" / "raw_plays").rglob("*.parquet")}
    (tmp_path / "store" / "ingest_runs").rename(tmp_path / "runs aside")
    place.put("b.json", [record(2)])
    assert place.load().run_id == 1
    assert all(f.exists() for f in kept)


def test_identical_files_in_one_run(place):
    place.put("a.json", [record(1)])
    place.put("b.json", [record(1)])
    report = place.load()
    assert (report.files_ingested, report.files_skipped_already_ingested, report.rows_inserted) == (1, 1, 1)
    assert [r.source_file for r in place.store.ingested_files().collect()] == ["a.json"]


def test_same_play_in_two_files_counts_once(place):
    place.put("a.json", [record(1)])
    place.put("b.json", [record(1, platform="later copy"), record(2)])
    report = place.load()
    assert report.rows_inserted == 3 and report.total_plays_after_rebuild == 2
    assert place.rows("play_id", "track_id", "platform") == [(1, "1", "x"), (2, "2", "x")]


def test_derived_columns(place):
    none = {"app_track_uri": "", "master_metadata_track_name": ""}
    place.put("a.json", [
        record(1, ms_played=5000, reason_end="fwdbtn"),
        record(2, ms_played=5000),
        record(3, reason_end="fwdbtn"),
        record(4, **none, app_episode_uri="app:episode:9", episode_name="E", episode_show_name="S"),
        record(5, **none, audiobook_uri="app:audio:1"),
        record(6, ms_played="12.5", reason_end=None),
        record(7, ms_played="long"),
        record(8, ts=None),
        record(9, ts="2024-03-31T00:30:00+02:00"),
    ])
    report = place.load(local_timezone="Europe/Zagreb")
    assert report.rows_inserted == 9 and report.total_plays_after_rebuild == 8
    rows = place.rows("content_type", "ms_played", "is_skip", "is_substantial", "track_id")
    assert rows == [
        ("music", 5000, True, False, "1"),
        ("music", 5000, False, False, "2"),
        ("music", 200000, False, True, "3"),
        ("podcast", 200000, False, True, None),
        ("unknown", 200000, False, True, None),
        ("music", 13, None, False, "6"),
        ("music", None, False, None, "7"),
        ("music", 200000, False, True, "9"),
    ]
    last = place.rows("ts_utc", "ts_local", "played_date", "played_dow", "played_month")[-1]
    assert last == (dt.datetime(2024, 3, 30, 22, 30), dt.datetime(2024, 3, 30, 23, 30), dt.date(2024, 3, 30), 6,
                    dt.date(2024, 3, 1))
    fact = place.store.plays()
    assert [(f.name, f.dataType) for f in fact.schema] == [(f.name, f.dataType) for f in PLAYS]
    assert not {"ip_addr", "user_agent", "username"} & set(fact.columns)


def test_records_without_uri_are_never_folded(place):
    same = record(1, app_track_uri=None)
    place.put("a.json", [same, same, same])
    assert place.load().total_plays_after_rebuild == 3


def test_month_filter_prunes_partitions(place):
    place.put("a.json", [record(1), record(2, ts="2023-01-05T00:00:00Z")])
    place.load()
    summary = listening_summary(place.store.plays(), "2024-01-01", "2024-12-31")
    plan = summary._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(played_month" in plan
    assert summary.first().total_plays == 1


def test_status(place, spark):
    assert store_status(place.store.plays(), spark).first().present is False
    place.put("a.json", [record(1), record(5)])
    place.load()
    assert tuple(store_status(place.store.plays()).first()) == (True, 2, dt.date(2024, 3, 1), dt.date(2024, 3, 5))


def test_small_casts(spark):
    rows = spark.createDataFrame([(t,) for t in ("7", "-1.5", "2e5", "", "x", None, "1.4")], "t string")
    assert [r[0] for r in rows.select(P.lenient_bigint(rows.t)).collect()] == [7, -2, 200000, None, None, None, 1]


# --- large files, read in splits --------------------------------------------------------------------

NASTY = [
    record(1, master_metadata_track_name='} ] , { [ "quoted" \\ \\" }'),
    record(2, extra={"deep": [{"a": [1, {"b": "}"}]}, "]"]}),
    record(3, master_metadata_track_name="ends with backslash \\"),
    record(4, master_metadata_track_name="x" * 3000 + "}{" * 50),
    record(5, master_metadata_track_name="é}ü{\n\t", extra={}),
]


def test_awkward_records_and_file_names(spark, place):
    place.put("a b.json", NASTY)
    place.put("a[1].json", json.dumps([record(9)], indent=2))
    place.put("c%20d.json", " [ ]\n")
    rows = export.scan_export(spark, str(place.dir)).collect()
    assert {(r.source_file, r.source_index, r.problem) for r in rows} == {("a[1].json", 0, None), *(("a b.json", i, None) for i in range(5))}
    assert {r.source_index: json.loads(r.payload) for r in rows if r.source_file == "a b.json"} == dict(enumerate(NASTY))
    place.put("copy.json", NASTY)
    report = place.load()
    assert (report.files_ingested, report.rows_inserted, report.total_plays_after_rebuild) == (3, 6, 6)
    assert place.load().files_ingested == 0


BROKEN = [
    '{"not": "a list"}', '[{"a": 1}, "text"]', '["text", {"a": 1}]', '[{"a": 1} {"b": 2}]', '[{"a": 1}', '[{"a": 1}] x',
    "{not valid json", '[{"a": 1},]', '[{"a": }]', '[[{"a": 1}]]', '[{"a": 1}, 5]', '[{"a": "x}]', "text", '[{"a": 1}}]',
]


def test_broken_files_are_found(spark, tmp_path):
    for n, content in enumerate(BROKEN):
        (tmp_path / f"bad{n:02d}.json").write_text(content)
    (tmp_path / "good.json").write_text('[{"a": 1}]')
    found = {r.source_file for r in export.violations(export.scan_export(spark, str(tmp_path))).collect()}
    assert found == {f"bad{n:02d}.json" for n in range(len(BROKEN))}


def parts(place, version):
    return {(r.utc_month, r.version) for r in place.store.months(version).collect()}


def test_only_touched_months_are_written(place, tmp_path):
    months = [f"{2015 + n // 12}-{n % 12 + 1:02d}" for n in range(80)]
    place.put("a.json", [record(1, ts=f"{m}-{d:02d}T10:00:00Z", app_track_uri=f"app:track:{d}") for m in months for d in (1, 9, 17)])
    place.load()
    first = place.store.last()["plays_version"]
    old = place.store.plays()
    place.put("0.json", [record(1, ts="2016-02-09T10:00:00Z", app_track_uri="app:track:9", platform="earlier file"),  # a copy
                         record(1, ts="2020-07-30T10:00:00Z", platform="new"), record(1, ts=None)])
    assert place.load().total_plays_after_rebuild == 241
    second = place.store.last()["plays_version"]
    touched = {dt.date(2016, 2, 1), dt.date(2020, 7, 1)}
    assert {m for m, v in parts(place, second) if v == second} == touched and len(parts(place, second)) == 80
    assert {f.parent.parent.name for f in (tmp_path / "store" / "plays" / f"version={second}").rglob("*.parquet")} == {
        f"utc_month={m}" for m in touched}
    assert {f.parent.name for f in (tmp_path / "store" / "month_totals" / f"version={second}").rglob("*.parquet")} == {
        f"utc_month={m}" for m in touched}
    rows = place.rows("play_id", "ts_utc", "platform")
    assert [r[0] for r in rows] == list(range(1, 242)) and [r[1] for r in rows] == sorted(r[1] for r in rows)
    assert {r[1].month for r in rows if r[2] == "earlier file"} == {2} and sum(r[2] == "new" for r in rows) == 1
    assert old.count() == 240 and first != second  # who read before goes on with what there was


def test_months_over_three_batches_equal_a_full_load(place, spark, tmp_path):
    def batch(n):
        return [record(1, ts=f"20{10 + (k * 7 + n) % 9}-{(k * 5) % 12 + 1:02d}-{k % 28 + 1:02d}T{k % 24:02d}:30:00Z",
                       app_track_uri=f"app:track:{k % 5}" if k % 6 else None, ms_played=1000 * (k % 3), platform=f"{n}.{k}")
                for k in range(60 * n, 60 * n + 90)]

    for n in (2, 0, 1):
        place.put(f"{n}.json", batch(n))
        place.load(local_timezone="America/St_Johns")
    whole = HistoryStore(spark, str(tmp_path / "whole"))
    ingest(whole, str(place.dir), fmt=FMT, local_timezone="America/St_Johns")
    views = place.store.views()
    for name, view in VIEWS.items():
        want = view(place.store.plays())
        assert views[name].columns == want.columns and sorted(views[name].collect(), key=repr) == sorted(want.collect(), key=repr)
    assert place.rows(*PLAYS.names) == [tuple(r) for r in whole.plays().orderBy("play_id").collect()]
    assert place.load(local_timezone="UTC").total_plays_after_rebuild == whole.plays().count()  # all months anew
    assert len({v for _, v in parts(place, place.store.last()["plays_version"])}) == 1


def test_ids_follow_utc_where_local_months_overlap(place):
    # At 02:31 UTC on 2009-11-01 the clock there went from 00:01 back to 23:01 of the day, and month, before.
    place.put("a.json", [record(1, ts=f"2009-11-01T02:{m}:30Z", app_track_uri=f"app:track:{m}") for m in (29, 30, 31, 32)])
    place.load(local_timezone="America/St_Johns")
    place.put("b.json", [record(1, ts="2009-11-01T02:30:45Z", app_track_uri="app:track:x"), record(1, ts="2009-10-31T23:30:45Z")])
    place.load(local_timezone="America/St_Johns")
    rows = place.rows("play_id", "ts_utc", "played_month")
    assert [r[0] for r in rows] == [1, 2, 3, 4, 5, 6] and [r[1] for r in rows] == sorted(r[1] for r in rows)
    assert [r[2].month for r in rows] == [10, 10, 11, 11, 10, 10]


def test_no_join_without_an_id(place):
    place.put("a.json", [record(1), record(2)])
    place.load()
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    plays = place.store.plays()
    assert "Join" in plan(plays)
    assert "Join" not in plan(plays.drop("play_id")) and "Join" not in plan(listening_summary(plays, "2024-01-01", "2024-12-31"))
    assert "Join" not in plan(plays.groupBy("track_uri").count())


def test_runs_whose_plays_are_all_dropped(place):
    place.put("a.json", [record(1, ts=None)])
    assert place.load().total_plays_after_rebuild == 0
    assert place.store.plays().count() == 0
    place.put("b.json", [record(1)])
    assert place.load().total_plays_after_rebuild == 1
    place.put("c.json", [record(2, ts=None)])
    assert place.load().total_plays_after_rebuild == 1 and place.rows("play_id") == [(1,)]
