"""Export directory -> raw layer -> fact table, all or nothing, safe to repeat."""

from __future__ import annotations

import json
from dataclasses import dataclass
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spinlog.errors import IngestError
from spinlog.operators.plays import derive_columns, drop_repeats, extract_fields, normalize
from spinlog.schema import SKIP_MS, SUBSTANTIAL_MS, ExportFormat
from spinlog.session import materialize
from spinlog.sources import export, ranges
from spinlog.sources.store import SOURCE_ORDER, HistoryStore, new_attempt, utc_now, with_utc_month


@dataclass(frozen=True)
class IngestReport:
    run_id: int
    files_ingested: int
    files_skipped_already_ingested: int
    rows_inserted: int
    unknown_fields: list[str]
    total_plays_after_rebuild: int


def check_zone(name: str) -> str:
    try:
        ZoneInfo(name)
    except (ZoneInfoNotFoundError, ValueError) as exc:
        raise IngestError(f"{name!r} is not an IANA time zone such as 'Europe/Zagreb'") from exc
    return name


def ingest(
    store: HistoryStore,
    directory: str,
    *,
    fmt: ExportFormat | None = None,
    local_timezone: str = "UTC",
    skip_ms_threshold: int = SKIP_MS,
    substantial_ms: int = SUBSTANTIAL_MS,
    pattern: str = "*.json",
) -> IngestReport:
    """Takes in the files not seen before and rebuilds the months of the fact table that they touch.

    With other settings than the last run's all months are built anew from the verbatim records.  Without
    new files, and with the same settings, the fact table stays as it is: the run only adds its row.
    """
    fmt = fmt or ExportFormat()
    spark = store.spark
    check_zone(local_timezone)
    started = utc_now()
    last = store.last()
    run, attempt = (last["run_id"] if last else 0) + 1, new_attempt()
    settings = json.dumps([fmt.provider, local_timezone, skip_ms_threshold, substantial_ms])

    files = export.listed(spark, directory, pattern)
    hashes = ranges.file_hashes(spark, directory, pattern, files)
    total = hashes.count()
    export.check_not_empty(export.named_files(files), total)
    if not total:
        raise IngestError(f"no {pattern} files in {directory}")
    new = store.write_files(export.new_files(hashes, store.ingested_files()), run, attempt)
    n_new = new.count()

    rows, fields = 0, []
    if n_new:
        # When every file is new there is nothing to filter, and no join.
        only = None if n_new == total else new.select("source_file")
        records = export.scan_export(spark, directory, pattern, only, files)
        raw = store.write_raw(export.check_keys(records, fmt), run, attempt)
        export.raise_first(raw)
        rows = raw.count()
        # Field names are a vocabulary, not data: all of them stand in the run row.
        fields = sorted(r["field"] for r in export.unknown_fields(raw).collect())

    anew = last is None or last["settings"] != settings
    if anew:
        raw_plays = store.raw_plays(also=(run, attempt) if n_new else None)
        plays = normalize(raw_plays, fmt, local_timezone, skip_ms_threshold, substantial_ms)
        version, total_plays = attempt, store.write_plays(plays, attempt)
    elif n_new:
        fresh = extract_fields(store.raw_of(run, attempt), fmt)  # with its copies, which the merge drops among all others
        fresh = derive_columns(fresh, local_timezone, skip_ms_threshold, substantial_ms)
        version = attempt
        total_plays = store.write_plays(merge_months(store, fresh, last["plays_version"]), attempt, last["plays_version"])
    else:
        version, total_plays = last["plays_version"], last["total_plays"]

    store.finish_run(
        {
            "run_id": run,
            "started_at": started,
            "finished_at": utc_now(),
            "files_ingested": n_new,
            "files_skipped_already_ingested": total - n_new,
            "row_count": rows,
            "unknown_fields": fields,
            "status": "ok" if not fields else "ok_with_warnings",
            "notes": None,
            "attempt": attempt,
            "plays_version": version,
            "total_plays": total_plays,
            "settings": settings,
        }
    )
    return IngestReport(run, n_new, total - n_new, rows, fields, total_plays)


def merge_months(store: HistoryStore, fresh: DataFrame, version: str) -> DataFrame:
    """All plays of the months that `fresh` touches: its own, copies or not, and those stored, each play once.

    Which of two copies stays is decided by the order of their sources, which is stored with each row,
    so the stored winner of earlier copies is as good as all of them.
    """
    fresh = materialize(with_utc_month(fresh), "fresh")
    touched = [r["utc_month"] for r in fresh.select("utc_month").distinct().collect()]  # months of the DATE type at most
    stored = store.stored_plays(version, touched).select(*fresh.columns)
    return drop_repeats(stored.unionByName(fresh), SOURCE_ORDER)


def report_frame(hashes: DataFrame, ingested: DataFrame, checked: DataFrame) -> DataFrame:
    """The counts of a run as one row, from the steps above."""
    new = export.new_files(hashes, ingested)
    return checked.agg(F.count(F.lit(1)).alias("rows_inserted")).select(
        hashes.agg(F.count(F.lit(1))).scalar().alias("files_seen"),
        new.agg(F.count(F.lit(1))).scalar().alias("files_ingested"),
        "rows_inserted",
        export.unknown_fields(checked).agg(F.array_join(F.sort_array(F.collect_set("field")), ",")).scalar()
        .alias("unknown_fields"),
    )
