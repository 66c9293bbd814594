"""The history store: Parquet folders, made visible by one run row.

    raw_plays/ingest_run_id=N/attempt=A        verbatim records of run N
    ingested_files/ingest_run_id=N/attempt=A
    plays/version=A/utc_month=M  fact rows of the months that attempt A wrote, with their place in the id order
    month_totals/version=A/utc_month=M   what the views add up, of the same months
    play_months/version=A        which version of each month is live as of A, with the rows of each of its parts
    ingest_runs                  one row per finished run, written last

Each attempt at a run has a name of its own, so nothing is ever overwritten: a
run that fails leaves folders no reader looks at, because their name is not in
`ingest_runs`.  A run writes the months its new records fall into, and a list of
months that takes all others from the runs before; its row makes both visible at once, so a reader sees
all months as they were or as they are.  A run without new files writes its row only.  One writer at a time.

Months are those of `ts_utc`: copies of a play share it, so they meet in one month, and
months follow each other in the order of ids whatever the zone does to local time.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from spinlog.operators.numbering import place_in_order
from spinlog.operators.plays import select_plays
from spinlog.operators.predicates import PARTITION
from spinlog.plans.month_views import KEYS, MONTH_VIEWS, month_totals
from spinlog.plans.views import VIEWS
from spinlog.schema import INGEST_RUNS, INGESTED_FILES, PLAYS, RAW_PLAYS

SOURCE_ORDER = ["source_file", "source_index", "ingest_run_id"]
_SOURCED = T.StructType(
    [f for f in PLAYS if f.name != "play_id"]
    + [T.StructField("source_file", T.StringType()), T.StructField("source_index", T.LongType()),
       T.StructField("ingest_run_id", T.LongType()), T.StructField("utc_month", T.DateType())]
)
_PLACED = T.StructType([*_SOURCED, T.StructField("_part", T.IntegerType()), T.StructField("_pos", T.LongType())])
_STORED = T.StructType([*_PLACED, T.StructField("version", T.StringType())])
_TOTALS = T.StructType(
    [T.StructField(c, T.DateType() if c.endswith("_month") else T.StringType()) for c in KEYS]
    + [T.StructField(c, T.TimestampNTZType()) for c in ("first_played", "last_played")]
    + [T.StructField(c, T.LongType()) for c in ("plays", "ms", "timed", "derived_skips", "raw_skips")]
    + [T.StructField("version", T.StringType())]
)
_MONTHS = T.StructType(
    [T.StructField("utc_month", T.DateType()), T.StructField("version", T.StringType()), T.StructField("_part", T.IntegerType()),
     T.StructField("_first", T.LongType()), T.StructField("rows", T.LongType())]
)


def utc_now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


def new_attempt() -> str:
    return f"a{uuid.uuid4().hex}"


def with_utc_month(plays: DataFrame) -> DataFrame:
    return plays.withColumn("utc_month", F.trunc("ts_utc", "month"))


def _folder(run: int, attempt: str) -> str:
    return f"ingest_run_id={run}/attempt={attempt}"


class HistoryStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def _read(self, name: str, schema: T.StructType, folders: list[str] | None = None) -> DataFrame:
        """The table, or only some of its folders."""
        if folders is not None:
            if not folders:
                return self.spark.createDataFrame([], schema)
            with_base = self.spark.read.option("basePath", self.path(name))
            return with_base.schema(schema).parquet(*[self.path(name, f) for f in folders]).select(*schema.names)
        try:
            return self.spark.read.schema(schema).parquet(self.path(name))
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":  # a broken store is not an empty one
                raise
            return self.spark.createDataFrame([], schema)

    # --- what readers see ------------------------------------------------------------------

    def runs(self) -> DataFrame:
        return self._read("ingest_runs", INGEST_RUNS)

    def last(self) -> Row | None:
        """The row of the last finished run; None when nothing was ever ingested."""
        return self.runs().orderBy(F.col("run_id").desc()).first()

    def last_run(self) -> int:
        """0 when nothing was ever ingested."""
        last = self.last()
        return last["run_id"] if last else 0

    def _finished(self) -> list[str]:
        """Folders of the finished runs that brought files: as many as there were such runs."""
        brought = self.runs().where("files_ingested > 0").select("run_id", "attempt").orderBy("run_id")
        return [_folder(r["run_id"], r["attempt"]) for r in brought.collect()]

    def ingested_files(self) -> DataFrame:
        return self._read("ingested_files", INGESTED_FILES, self._finished())

    def raw_plays(self, also: tuple[int, str] | None = None) -> DataFrame:
        """Verbatim records of all finished runs, and of the unfinished one `also` (number, attempt)."""
        return self._read("raw_plays", RAW_PLAYS, self._finished() + ([_folder(*also)] if also else []))

    def raw_of(self, run: int, attempt: str) -> DataFrame:
        return self._read("raw_plays", RAW_PLAYS, [_folder(run, attempt)])

    def months(self, version: str) -> DataFrame:
        """The live parts of a version: one row per month and task that wrote it."""
        return self.spark.read.schema(_MONTHS).parquet(self.path("play_months", f"version={version}"))

    def stored_plays(self, version: str, only: list[dt.date] | None = None) -> DataFrame:
        """Fact rows as they are stored, of all live months or of some."""
        return self._read("plays", _STORED, self._live(version, only))

    def _live(self, version: str, only: list[dt.date] | None = None) -> list[str]:
        """Folders of the live months: one per month at most."""
        live = self.months(version).select("version", "utc_month").distinct()
        if only is not None:
            live = live.where(F.col("utc_month").isin(only))
        return sorted(f"version={r['version']}/utc_month={r['utc_month']}" for r in live.collect())

    def month_totals(self) -> DataFrame | None:
        """Totals of all live months, or None without a finished run."""
        last = self.last()
        return None if last is None else self._read("month_totals", _TOTALS, self._live(last["plays_version"]))

    def plays(self) -> DataFrame | None:
        """The fact table of the last finished run, or None without one.

        `play_id` is the place in the order of all rows: the rows of earlier months and parts, and the place in
        the row's own part.  Offsets are unique by part, so the optimizer drops their join where no id is asked for.
        """
        last = self.last()
        if last is None:
            return None
        version = last["plays_version"]
        earlier = Window.orderBy("utc_month", "_part").rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum("rows").over(earlier), F.lit(0))
        offsets = (
            self.months(version).withColumn("_shift", before - F.col("_first"))
            .groupBy("version", "utc_month", "_part").agg(F.max("_shift").alias("_shift"))
        )
        placed = self.stored_plays(version).join(F.broadcast(offsets), ["version", "utc_month", "_part"], "left")
        plays = select_plays(placed.withColumn("play_id", F.col("_shift") + F.col("_pos") + 1))
        note = {**plays.schema["played_month"].metadata, PARTITION: True}
        return plays.withMetadata("played_month", note)

    def views(self) -> dict[str, DataFrame]:
        """The five views; those that month totals can give read no plays."""
        plays, totals = self.plays(), self.month_totals()
        if plays is None:
            return {}
        return {name: MONTH_VIEWS[name](totals) if name in MONTH_VIEWS else view(plays) for name, view in VIEWS.items()}

    def publish(self) -> list[str]:
        """Temporary views for `plays`, its five views and the provenance tables."""
        plays = self.plays()
        if plays is None:
            return []
        names = []
        for name, df in {"plays": plays, **self.views(), "raw_plays": self.raw_plays(), "ingested_files": self.ingested_files(),
                         "ingest_runs": self.runs()}.items():
            df.createOrReplaceTempView(name)
            names.append(name)
        return names

    # --- what a run writes -----------------------------------------------------------------

    def write_raw(self, checked: DataFrame, run: int, attempt: str) -> DataFrame:
        """Raw rows of an unfinished run, checks included, read back for those checks."""
        target = self.path("raw_plays", _folder(run, attempt))
        checked.write.parquet(target)
        return self.spark.read.schema(checked.schema).parquet(target)

    def write_files(self, files: DataFrame, run: int, attempt: str) -> DataFrame:
        target = self.path("ingested_files", _folder(run, attempt))
        stamped = files.select("file_hash", "source_file", F.lit(utc_now()).cast("timestamp_ntz").alias("ingested_at"))
        stamped.write.parquet(target)
        return self.spark.read.schema(stamped.schema).parquet(target)

    def write_plays(self, plays: DataFrame, version: str, since: str | None = None) -> int:
        """Sorted once, written once, by month; months not in `plays` stay as of version `since`.  Returns all rows."""
        order = [F.col(c).asc_nulls_last() for c in ("ts_utc", "track_uri", *SOURCE_ORDER)]
        target = self.path("plays", f"version={version}")
        placed = place_in_order(with_utc_month(plays), order).select(
            *[F.col(f.name).cast(f.dataType) for f in _PLACED]
        )
        placed.write.partitionBy("utc_month", "played_month").parquet(target)
        stored = self.spark.read.schema(_PLACED).parquet(target)
        totals = month_totals(stored).select(*[F.col(f.name).cast(f.dataType) for f in _TOTALS if f.name != "version"])
        totals.write.partitionBy("utc_month").parquet(self.path("month_totals", f"version={version}"))
        months = stored.groupBy("utc_month", "_part").agg(
            F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("rows"))
        months = months.select("utc_month", F.lit(version).alias("version"), "_part", "_first", "rows")
        if since is not None:
            kept = self.months(since).join(F.broadcast(months.select("utc_month").distinct()), "utc_month", "left_anti")
            months = kept.select(*_MONTHS.names).unionByName(months)
        months.coalesce(1).write.parquet(self.path("play_months", f"version={version}"))
        return self.months(version).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()["n"]

    def finish_run(self, row: dict) -> None:
        """The commit: readers see the run from here on."""
        one = self.spark.createDataFrame([tuple(row[f.name] for f in INGEST_RUNS)], INGEST_RUNS)
        one.coalesce(1).write.mode("append").parquet(self.path("ingest_runs"))
