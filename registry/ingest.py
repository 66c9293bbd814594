"""Export scan, validation, copies and the full ingest, over `orders` written as export files."""

from __future__ import annotations

import os
import uuid
from itertools import groupby
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry import Area
from spinlog.operators import plays as P
from spinlog.plans.ingest import ingest, report_frame
from spinlog.schema import ExportFormat
from spinlog.session import work_dir
from spinlog.sources import export
from spinlog.sources.store import HistoryStore
from spinlog.sources.testtables import ZONE, export_files, export_records

AREA = Area()
FMT = ExportFormat("app")

RECORDS_CTE = """
with base as (
  select o_orderkey as k, o_custkey as c, o_orderdate + to_hours(cast(o_orderkey % 24 as integer)) as t,
    cast(o_totalprice as bigint) as ms0, o_totalprice as price, o_orderstatus as s, o_orderpriority as p from orders
), both_ as (
  select k as k0, * from base union all select k + 2000000000000 as k0, * from base where k % 5 = 0
), rec as (
  select k0, k, k0 // 500 as file_no, 'part_' || lpad(cast(k0 // 500 as varchar), 13, '0') || '.json' as source_file,
    row_number() over (partition by k0 // 500 order by k0) - 1 as source_index,
    t as ts_utc, cast(trunc(price) as bigint) as ms_played,
    case when k % 7 <> 0 and k % 11 <> 0 then 'song ' || (k % 97) end as track_name,
    case when k % 7 <> 0 and k % 11 <> 0 then 'artist ' || c end as artist_name,
    case when k % 7 <> 0 then 'album ' || (k % 13) end as album_name,
    case when k % 7 <> 0 and k % 11 <> 0 then 'app:track:' || c || 'x' || (k % 97) end as track_uri,
    case when k % 7 = 0 then 'part ' || k end as episode_name,
    case when k % 7 = 0 then 'show "A, [B]" {C}' end as episode_show,
    case when k % 7 = 0 then 'app:episode:' || k end as episode_uri,
    'clickrow' as reason_start,
    case s when 'F' then 'fwdbtn' when 'O' then 'trackdone' end as reason_end,
    k % 2 = 0 as shuffle, case when k % 3 > 0 then k % 3 = 1 end as skipped_raw,
    false as offline, k % 17 = 0 as incognito, p as platform, cast(null as varchar) as conn_country
  from both_
), first_ as (
  select *, case when coalesce(track_uri, episode_uri) is not null then row_number() over (
     partition by coalesce(track_uri, episode_uri), ts_utc, ms_played order by source_file, source_index)
     else 1 end as rn from rec
), zoned as (
  select *, ts_utc at time zone 'UTC' at time zone 'Europe/Zagreb' as ts_local,
    case when track_uri is not null then split_part(track_uri, ':', 3) end as track_id,
    case when track_uri is not null then 'music' when episode_uri is not null then 'podcast' else 'unknown' end as content_type
  from first_ where rn = 1
), norm as (
  select * exclude (rn, k0, k, file_no), cast(ts_local as date) as played_date,
    cast(extract(year from ts_local) as smallint) as played_year,
    cast(date_trunc('month', ts_local) as date) as played_month,
    cast(extract(hour from ts_local) as tinyint) as played_hour,
    cast(isodow(ts_local) as tinyint) as played_dow,
    (reason_end = 'fwdbtn' and ms_played < 30000) as is_skip,
    (ms_played >= 30000) as is_substantial
  from zoned
)
"""


def checked_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.check_keys(export.whole_file_records(export_files(spark, sf_dir)), FMT)


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = checked_records(spark, sf_dir)
    return rows.select(F.lit(1).cast("bigint").alias("ingest_run_id"), "source_file", "source_index", "payload")


def write_export(spark: SparkSession, sf_dir: str, batch: str = "true", target: str | None = None, label: str = "all") -> str:
    """The derived export, or the records `batch` holds for, as real files of one JSON array each.

    `label` keeps the names of several calls for one folder apart.
    """
    target = target or work_dir(spark, "export")
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    at = urlsplit(target)
    if (at.scheme or urlsplit(default).scheme) != "file":
        text = export_files(spark, sf_dir, batch).select(F.decode("content", "UTF-8").alias("value"))
        text.write.mode("append").option("maxRecordsPerFile", 1).text(target)
        return target
    # In a local or mounted folder Hadoop's writer would start two processes for each file (`chmod`, for it and its checksum).
    folder = unquote(at.path) if at.scheme else target

    def write(rows):
        for file_no, records in groupby(rows, key=lambda r: r["file_no"]):
            part = f"{folder}/_{uuid.uuid4().hex}"  # hidden from readers until it is whole
            with open(part, "wb") as f:
                f.write(b"[")
                for i, record in enumerate(records):
                    f.write((",\n" if i else "").encode() + record["payload"].encode())
                f.write(b"]\n")
            os.replace(part, f"{folder}/part_{'null' if file_no is None else f'{file_no:013d}'}-{label}.txt")

    os.makedirs(folder, exist_ok=True)
    records = export_records(spark, sf_dir).where(batch).select("file_no", "k0", "payload")
    # As `export_files` has them; no file is held as one row.
    records.repartition("file_no").sortWithinPartitions("file_no", "k0", "payload").select("file_no", "payload").foreachPartition(write)
    return target


def fields_of(records: DataFrame) -> DataFrame:
    pick = {"ts": "ts", "ms_played": "ms_played", "app_episode_uri": "episode_uri", "username": "username",
            "episode_show_name": "episode_show"}
    return records.select("source_index", F.json_tuple("payload", *pick).alias(*pick.values()))


FIELDS_SQL = (
    "select source_index, strftime(ts_utc, '%Y-%m-%dT%H:%M:%SZ') as ts, cast(ms_played as varchar) as ms_played, "
    "episode_uri, 'user ' || c as username, episode_show from rec join base using (k)"
)

AREA.add("src_export_scan",
         lambda s, d: fields_of(export.scan_export(s, write_export(s, d), "*.txt")), RECORDS_CTE + FIELDS_SQL)

def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files named by id, their text as bytes."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return documents.select(
        F.format_string("doc_%012d.txt", "doc_id").alias("source_file"), F.encode("text", "UTF-8").alias("content"), "doc_id")


AREA.add("src_file_hash", lambda s, d: export.file_hashes(text_files(s, d)),
         "select 'doc_' || lpad(cast(doc_id as varchar), 12, '0') || '.txt' as source_file, sha256(text) as file_hash from documents")


def skip_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = text_files(spark, sf_dir)
    seen = export.file_hashes(files.where("doc_id % 4 = 0"))
    return export.new_files(export.file_hashes(files), seen)


SKIP_SQL = """
with h as (select doc_id, 'doc_' || lpad(cast(doc_id as varchar), 12, '0') || '.txt' as source_file,
  sha256(text) as file_hash from documents)
select file_hash, min(source_file) as source_file from h
where file_hash not in (select file_hash from h where doc_id % 4 = 0) group by file_hash
"""
AREA.add("src_skip_seen", skip_seen, SKIP_SQL)
AREA.add("join_seen_files", lambda s, d: skip_seen(s, d).agg(F.count(F.lit(1)).alias("new_files")),
         SKIP_SQL.replace("select file_hash, min(source_file) as source_file from h",
                          "select count(distinct file_hash) as new_files from h").replace(" group by file_hash", ""))


def broken_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every export file, one in five of them damaged in one of four ways."""
    files = export_files(spark, sf_dir)
    n = F.regexp_extract("source_file", r"part_(\d+)", 1).cast("bigint") % 20
    text = F.decode("content", "UTF-8")
    damaged = (
        F.when(n == 0, F.concat(text, F.lit(" x")))
        .when(n == 5, F.concat(F.lit('{"rows":'), text, F.lit("}")))
        .when(n == 10, F.regexp_replace(text, r"\]$", ',"not an object"]'))
        .when(n == 15, F.regexp_replace(text, r"\]$", ',"{}"]'))
        .otherwise(text)
    )
    return files.select("source_file", F.encode(damaged, "UTF-8").alias("content"))


AREA.add(
    "src_validate_shape",
    lambda s, d: export.violations(export.whole_file_records(broken_files(s, d))).select("source_file", "source_index", "problem"),
    RECORDS_CTE + """
, f as (select source_file, file_no % 20 as n, count(*) as records from rec group by source_file, file_no)
select source_file, case when n = 10 then records end as source_index,
  case n when 0 then 'no JSON in it' when 5 then 'the file is JSON, but no array of records'
    when 10 then 'this entry is no record' else 'a text stands where a record should' end as problem
from f where n in (0, 5, 10, 15)""",
)


def required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export records with `ts` or `ms_played` taken away from some."""
    rows = export_records(spark, sf_dir).select(
        F.concat(F.lit("f"), F.col("file_no").cast("string")).alias("source_file"), F.col("k0").alias("source_index"),
        F.when(F.col("k0") % 100 == 1, F.regexp_replace("payload", '"ts":', '"when":'))
        .when(F.col("k0") % 100 == 2, F.regexp_replace("payload", '"(ts|ms_played)":', '"no_$1":'))
        .when(F.col("k0") % 100 == 3, F.regexp_replace("payload", '"ms_played":[0-9]+', '"ms_played":null'))
        .otherwise(F.col("payload")).alias("payload"),
        F.lit(None).cast("string").alias("problem"),
    )
    return export.violations(export.check_keys(rows, FMT)).select("source_file", "source_index", "problem")


AREA.add("src_required_fields", required, RECORDS_CTE +
         "select 'f' || file_no as source_file, k0 as source_index, 'without ' || "
         "case k0 % 100 when 1 then 'ts' else 'ms_played, ts' end as problem from rec where k0 % 100 in (1, 2)")


def event_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records whose extra key is the event type."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.lit("events").alias("source_file"), F.col("event_id").alias("source_index"),
        F.concat(F.lit('{"ts":"x","ms_played":1,"'), F.col("event_type"), F.lit('":'), F.col("props"), F.lit("}")).alias("payload"),
        F.lit(None).cast("string").alias("problem"),
    )
    return export.unknown_fields(export.check_keys(rows, FMT))


AREA.add("src_unknown_fields", event_keys, "select distinct event_type as field from events")
AREA.add("set_minus_fields",
         lambda s, d: export.unknown_fields(checked_records(s, d)),
         "select 'priority_class' as field from orders group by 1")

EXTRACTED = ["ts_utc", "ms_played", "track_name", "artist_name", "album_name", "track_uri", "episode_name",
             "episode_show", "episode_uri", "reason_start", "reason_end", "shuffle", "skipped_raw", "offline",
             "incognito", "platform", "conn_country"]
AREA.add("src_json_extract",
         lambda s, d: P.extract_fields(raw_rows(s, d), FMT).select("source_file", "source_index", *EXTRACTED),
         RECORDS_CTE + f"select source_file, source_index, {', '.join(EXTRACTED)} from rec")
AREA.add("plays_normalize",
         lambda s, d: P.normalize(raw_rows(s, d), FMT, ZONE).drop("ingest_run_id"), RECORDS_CTE + "select * from norm")


def full_ingest(spark: SparkSession, sf_dir: str) -> HistoryStore:
    """Three real runs over real files: every third file, then the rest beside them, then nothing new."""
    store = HistoryStore(spark, work_dir(spark, "store"))
    exported = work_dir(spark, "export")
    for batch in ("file_no % 3 = 0", "file_no % 3 > 0", None):
        if batch:
            write_export(spark, sf_dir, batch, exported, "first" if batch.endswith("= 0") else "rest")
        ingest(store, exported, fmt=FMT, local_timezone=ZONE, pattern="*.txt")
    return store


FACT = ["ts_utc", "ts_local", "ms_played", "track_name", "artist_name", "album_name", "track_uri", "track_id",
        "episode_name", "episode_show", "episode_uri", "content_type", "reason_start", "reason_end", "shuffle",
        "skipped_raw", "offline", "incognito", "platform", "conn_country", "played_date", "played_year",
        "played_month", "played_hour", "played_dow", "is_skip", "is_substantial"]
AREA.add("sink_atomic_rebuild", lambda s, d: full_ingest(s, d).plays().drop("play_id"),
         RECORDS_CTE + f"select {', '.join(FACT)} from norm")
AREA.add("sink_raw_append",
         lambda s, d: full_ingest(s, d).raw_plays().groupBy("ingest_run_id").agg(F.count(F.lit(1)).alias("rows")),
         RECORDS_CTE + "select cast(if(file_no % 3 = 0, 1, 2) as bigint) as ingest_run_id, count(*) as rows from rec group by 1")
AREA.add("sink_files_runs",
         lambda s, d: full_ingest(s, d).runs().select(
             "run_id", "files_ingested", "files_skipped_already_ingested", "row_count",
             F.array_join("unknown_fields", ",").alias("unknown_fields"), "status"),
         RECORDS_CTE + """, n as (select cast(if(file_no % 3 = 0, 1, 2) as bigint) as run_id,
    cast(count(distinct file_no) as integer) as files, count(*) as rows from rec group by 1)
select run_id, files as files_ingested, cast(coalesce(lag(files) over (order by run_id), 0) as integer) as files_skipped_already_ingested,
  rows as row_count, 'priority_class' as unknown_fields, 'ok_with_warnings' as status from n
union all select 3, 0, cast(sum(files) as integer), 0, '', 'ok' from n""")


# Records by batch: copies of two months come second, the last years third.
BATCH = """case when substring(ts, 1, 7) in ('1997-03', '1997-04') and k0 >= 2000000000000 then 2
  when substring(ts, 1, 4) >= '2000' then 3 else 1 end"""
BATCHES_CTE = RECORDS_CTE + """
, dealt as (select *, cast(date_trunc('month', ts_utc) as date) as utc_month,
    case when strftime(ts_utc, '%Y-%m') in ('1997-03', '1997-04') and k0 >= 2000000000000 then 2
      when extract(year from ts_utc) >= 2000 then 3 else 1 end as batch from first_)
"""


def month_store(spark: SparkSession, sf_dir: str) -> HistoryStore:
    """Three runs whose files touch most months, two of them again, and the last ones."""
    store, exported = HistoryStore(spark, work_dir(spark, "store")), work_dir(spark, "export")
    for batch in (1, 2, 3):
        write_export(spark, sf_dir, f"{BATCH} = {batch}", exported, f"batch{batch}")
        ingest(store, exported, fmt=FMT, local_timezone=ZONE, pattern="*.txt")
    return store


def month_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which run wrote each month last, and its rows."""
    store = month_store(spark, sf_dir)
    runs = store.runs().select(F.col("attempt").alias("version"), "run_id")
    months = store.months(store.last()["plays_version"]).groupBy("utc_month", "version").agg(F.sum("rows").alias("rows"))
    stored = store.stored_plays(store.last()["plays_version"]).groupBy("utc_month").agg(F.count(F.lit(1)).alias("stored"))
    return months.join(F.broadcast(runs), "version").join(stored, "utc_month").select("utc_month", "run_id", "rows", "stored")


AREA.add("sink_month_rebuild", month_versions, BATCHES_CTE + """
select utc_month, cast(max(batch) as bigint) as run_id, count(*) filter (where rn = 1) as rows,
  count(*) filter (where rn = 1) as stored from dealt group by utc_month""")
AREA.add("plays_play_id_batches",
         lambda s, d: month_store(s, d).plays().select("play_id", "ts_utc", "track_uri", "played_month"), RECORDS_CTE + """
select row_number() over (order by ts_utc, track_uri nulls last) as play_id, ts_utc, track_uri, played_month from norm""")


AREA.add("sink_month_totals", lambda s, d: month_store(s, d).month_totals().drop("version"), RECORDS_CTE + """
select cast(date_trunc('month', ts_utc) as date) as utc_month, played_month, artist_name, album_name, track_uri, track_name,
  min(ts_utc) as first_played, max(ts_utc) as last_played, count(*) as plays, cast(sum(ms_played) as bigint) as ms,
  count(ms_played) as timed, count(*) filter (where is_skip) as derived_skips, count(*) filter (where skipped_raw) as raw_skips
from norm where track_uri is not null or artist_name is not null group by all""")


def reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = export_files(spark, sf_dir)
    hashes = export.file_hashes(files)
    return report_frame(hashes, hashes.limit(0), checked_records(spark, sf_dir))


AREA.add("ingest_report", reported, RECORDS_CTE +
         "select count(distinct file_no) as files_seen, count(distinct file_no) as files_ingested, count(*) as rows_inserted, "
         "'priority_class' as unknown_fields from rec")
