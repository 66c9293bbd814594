"""Export files: one JSON array of play objects per file.

Directories are read by `ranges`: many tasks share a large file, one row per record
with the checks attached.  `file_hashes` and `whole_file_records` say the same of
files that already are rows of a table.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spinlog.errors import IngestError
from spinlog.schema import ExportFormat
from spinlog.sources import ranges

RECORD_COLUMNS = ["source_file", "source_index", "payload", "problem"]


def file_listing(spark: SparkSession, directory: str, pattern: str = "*.json") -> DataFrame:
    """(source_file, path, content) of a flat directory; content is read only if used."""
    return named_files(listed(spark, directory, pattern))


def listed(spark: SparkSession, directory: str, pattern: str = "*.json") -> DataFrame:
    """The directory listed once, for `ranges`."""
    try:
        return ranges.listing(spark, directory, pattern)
    except AnalysisException as exc:
        raise IngestError(f"{directory} is not a readable directory") from exc


def named_files(files: DataFrame) -> DataFrame:
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("source_file"), "path", "content"
    )


def check_not_empty(files: DataFrame, found: int) -> None:
    """Spark skips files without a byte; they are not JSON, so they must not pass unseen."""
    # The names stay in the JVM unless one is wanted: each costs a call to fetch.
    if len(files._jdf.inputFiles()) != found:
        names = {path.rsplit("/", 1)[-1] for path in files.inputFiles()}
        read = {r["source_file"] for r in files.select("source_file").collect()}
        raise IngestError(f"{min(names - read)}: no JSON in it (the file is empty).")


def file_hashes(files: DataFrame) -> DataFrame:
    """SHA-256 of the bytes of each file."""
    return files.select("source_file", F.sha2("content", 256).alias("file_hash"))


def first_of_copies(hashes: DataFrame) -> DataFrame:
    """One name per distinct content, the first by name; folded on the map side."""
    return hashes.groupBy("file_hash").agg(F.min("source_file").alias("source_file"))


def new_files(hashes: DataFrame, ingested: DataFrame) -> DataFrame:
    return first_of_copies(hashes).join(ingested.select("file_hash"), "file_hash", "left_anti")


# A string element that could pass for an object once its quotes are gone.
_BRACED_STRING = r'[\[,]\s*"\s*(?:\{|\\u007[bB])'


def whole_file_records(files: DataFrame) -> DataFrame:
    """Files as (source_file, content) -> one row per record, or one row per broken file.

    The text is wrapped in one more array with an empty one behind it, so anything
    behind the closing bracket breaks the parse or hides the second array instead of being ignored.
    """
    text = F.col("text")
    wrapped = F.concat(F.lit("["), text, F.lit(",[]]"))
    strings = F.from_json(wrapped, "array<array<string>>")
    parsed = files.select("source_file", F.decode("content", "UTF-8").alias("text")).select(
        "source_file", "text", strings.alias("nested")
    )
    is_array = text.rlike(r"^\s*\[")
    is_json = F.size(F.from_json(wrapped, "array<string>")) == 2
    maps = F.from_json(wrapped, "array<array<map<string,string>>>")
    file_problem = (
        F.when(~is_array & is_json, "the file is JSON, but no array of records")
        .when(F.col("nested").isNull() | (F.size("nested") != 2), "no JSON in it")
        .when(text.rlike(_BRACED_STRING) & (maps.isNull() | F.exists(F.get(maps, F.lit(0)), lambda m: m.isNull())),
              "a text stands where a record should")
    )
    checked = parsed.select("source_file", file_problem.alias("problem"), F.get("nested", F.lit(0)).alias("records"))
    # A broken file becomes one row without a payload.  The outer explode keeps the
    # optimizer from inferring a filter on the array, which would parse twice; the
    # row it makes of an empty file is dropped.
    rows = F.when(F.col("problem").isNotNull(), F.array(F.lit(None).cast("string"))).otherwise(F.col("records"))
    return checked.select(
        "source_file", "problem", F.posexplode_outer(rows).alias("source_index", "payload")
    ).where(F.col("source_index").isNotNull()).select(
        "source_file",
        F.when(F.col("problem").isNull(), F.col("source_index").cast("bigint")).alias("source_index"),
        "payload",
        F.coalesce("problem", object_problem(F.col("payload"))).alias("problem"),
    )


def object_problem(payload: Column) -> Column:
    return F.when(payload.isNull() | ~payload.startswith("{"), "this entry is no record")


def check_keys(records: DataFrame, fmt: ExportFormat) -> DataFrame:
    """Adds the missing-key problem and `unknown_keys`; values do not matter, only keys."""
    keys = F.coalesce(F.json_object_keys("payload"), F.array().cast("array<string>"))
    required = F.array(*[F.lit(k) for k in fmt.required])
    known = F.array(*[F.lit(k) for k in fmt.known])
    missing = F.array_sort(F.array_except(required, keys))
    text = F.concat(F.lit("without "), F.array_join(missing, ", "))
    return records.select(
        "source_file",
        "source_index",
        "payload",
        F.coalesce("problem", F.when(F.size(missing) > 0, text)).alias("problem"),
        F.array_except(keys, known).alias("unknown_keys"),
    )


def violations(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("problem").isNotNull())


def raise_first(checked: DataFrame) -> None:
    """Fail loudly with the first bad record by file and index."""
    order = [F.col("source_file").asc(), F.col("source_index").asc_nulls_first()]
    bad = violations(checked).orderBy(*order).limit(1).collect()
    if bad:
        row = bad[0]
        index = "" if row["source_index"] is None else f"[{row['source_index']}]"
        record = "" if row["payload"] is None else f" Record: {row['payload']}"
        raise IngestError(f"{row['source_file']}{index}: {row['problem']}.{record}")


def unknown_fields(checked: DataFrame) -> DataFrame:
    """Distinct keys outside the known set; the explode only meets unknown ones."""
    return checked.select(F.explode("unknown_keys").alias("field")).distinct()


def scan_export(
    spark: SparkSession, directory: str, pattern: str = "*.json", only: DataFrame | None = None, files: DataFrame | None = None
) -> DataFrame:
    """Every record of a directory as (source_file, source_index, payload, problem).

    `only` restricts the scan to some files (a `source_file` column); `files` is the directory as `listed` before.
    """
    return ranges.records(spark, directory, pattern, only, files).select(*RECORD_COLUMNS)
