"""One JSON line per edit."""

from __future__ import annotations

import uuid
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_COMMITS = "batch string, attempt string"
_LINE = "ts string, action string, payload_hash string, token string, outcome string, snapshot_id string"


def payload_hash(arguments: dict[str, Column]) -> Column:
    """SHA-256 of the arguments as JSON with sorted names, NULLs kept."""
    fields = [arguments[name].alias(name) for name in sorted(arguments)]
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def audit_rows(edits: DataFrame, action: str, arguments: list[str], when: str = "edited_at") -> DataFrame:
    """`edits`: the argument columns, a time, `outcome` and maybe `token` and `snapshot_id`."""

    def given(name: str) -> Column:
        return F.col(name) if name in edits.columns else F.lit(None).cast("string")

    return edits.select(
        F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"),
        F.lit(action).alias("action"),
        payload_hash({a: F.col(a) for a in arguments}).alias("payload_hash"),
        given("token").alias("token"),
        F.col("outcome"),
        given("snapshot_id").alias("snapshot_id"),
    )


def append_audit(rows: DataFrame, path: str) -> None:
    """Appends the lines as they are; a job that runs twice leaves them twice (see `append_batch`)."""
    rows.write.mode("append").option("ignoreNullFields", "false").json(path)


def append_batch(rows: DataFrame, path: str, batch: str) -> bool:
    """Appends the lines of a batch once, however often the job that makes them runs; False if they were there.

        lines/batch=B/attempt=A     JSON lines, seen by no reader until
        commits                     has a row for the batch and the attempt

    A job that fails before its commit leaves a folder that nobody reads; run again under the same batch id
    it writes another.  Should two attempts commit, the first by name counts.
    """
    spark = rows.sparkSession
    if not _commits(spark, path).where(F.col("batch") == batch).isEmpty():
        return False
    attempt = uuid.uuid4().hex
    target = f"{path}/lines/{_folder(batch, attempt)}"
    rows.write.option("ignoreNullFields", "false").json(target)
    _commit(spark, path, batch, attempt)
    return True


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """The lines of all committed batches, with their `batch`."""
    live = _commits(spark, path).groupBy("batch").agg(F.min("attempt").alias("attempt"))
    folders = [f"{path}/lines/{_folder(r['batch'], r['attempt'])}" for r in live.collect()]  # one per finished job
    if not folders:
        return spark.createDataFrame([], _LINE + ", batch string")
    lines = spark.read.schema(_LINE + ", batch string, attempt string").option("basePath", f"{path}/lines").json(folders)
    return lines.drop("attempt")


def _folder(batch: str, attempt: str) -> str:
    return f"batch={quote(batch, safe='')}/attempt={attempt}"


def _commit(spark: SparkSession, path: str, batch: str, attempt: str) -> None:
    spark.createDataFrame([(batch, attempt)], _COMMITS).coalesce(1).write.mode("append").parquet(f"{path}/commits")


def _commits(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(_COMMITS).parquet(f"{path}/commits")
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _COMMITS)
