"""Raw records -> the `plays` fact table, one small step per function."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spinlog.operators.numbering import number_rows
from spinlog.schema import PLAYS, SKIP_MS, SUBSTANTIAL_MS, ExportFormat

_ZONED = r"(?i)([+-]\d{1,2}(:?\d{2})?|Z|UTC|GMT)\s*$"


def utc_timestamp(text: Column) -> Column:
    """Text -> zone-less UTC timestamp; bad text fails the job.

    A text with a zone goes through its epoch microseconds, so the result does
    not depend on the session zone; a text without one is taken as UTC.
    """
    micros = F.unix_micros(text.try_cast("timestamp")).cast("decimal(18,0)")
    zoned = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(
        secs=micros * F.lit("0.000001").cast("decimal(7,6)")
    )
    has_time = text.rlike(r"\d:\d")
    parsed = F.when(has_time & text.rlike(_ZONED), zoned).otherwise(text.try_cast("timestamp_ntz"))
    bad = F.raise_error(F.concat(F.lit("not a time: "), text)).cast("timestamp_ntz")
    return F.when(text.isNotNull(), F.coalesce(parsed, bad))  # the costly text is parsed in one place only


def lenient_bigint(text: Column) -> Column:
    """Digits as they are; other numbers rounded half away from zero; else NULL."""
    rounded = F.round(text.try_cast("double")).try_cast("bigint")
    return F.coalesce(text.try_cast("bigint"), rounded)


def extract_fields(raw: DataFrame, fmt: ExportFormat) -> DataFrame:
    """JSON payload -> typed columns, in one parse per record.

    Every key is read as text first, then cast; empty names and URIs are NULL.
    Records whose `ts` is null are dropped.
    """
    keys = fmt.mapped()
    text_schema = T.StructType([T.StructField(k, T.StringType()) for k in keys])
    rest = [c for c in raw.columns if c != "payload"]
    # Through a generator, below which the filter on `ts` can't be pushed: it would parse each record once more.
    parsed = raw.select(*rest, F.explode(F.array(F.from_json("payload", text_schema))).alias("r"))

    def typed(key: str, name: str) -> Column:
        value = F.col(f"r.{key}")
        if name == "ts_utc":
            value = utc_timestamp(value)
        elif name == "ms_played":
            value = lenient_bigint(value)
        elif name in ("shuffle", "skipped_raw", "offline", "incognito"):
            value = value.try_cast("boolean")
        elif name.endswith(("_name", "_uri", "_show")):
            value = F.nullif(value, F.lit(""))
        return value.alias(name)

    return parsed.where(F.col("r.ts").isNotNull()).select(
        *rest, *[typed(k, n) for k, n in keys.items()]
    )


def drop_repeats(extracted: DataFrame, order: list[str]) -> DataFrame:
    """First record per (URI, ts_utc, ms_played); records without a URI all stay.

    `order` must be unique per record.  min(struct) aggregates on the map side,
    so even a third of all rows being copies of one play leaves each task with
    a single row.  Records without a URI carry their own order columns in the
    key: each is a group of one, and no NULL key collects them.  The time comes first in the
    key, as sorts compare its bytes at once, where all URIs begin alike.
    """
    uri = F.coalesce("track_uri", "episode_uri")
    own = [F.when(uri.isNull(), F.col(c)).alias(f"_own_{c}") for c in order]
    rest = [c for c in extracted.columns if c not in (*order, "ts_utc", "ms_played")]
    first = F.min(F.struct(*order, *rest)).alias("first")
    return (
        extracted.groupBy("ts_utc", "ms_played", uri.alias("_uri"), *own)
        .agg(first)
        .select("ts_utc", "ms_played", "first.*")
        .select(*extracted.columns)
    )


def local_time(ts_utc: Column | str, zone: str) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col(ts_utc) if isinstance(ts_utc, str) else ts_utc)


def content_type() -> Column:
    return (
        F.when(F.col("track_uri").isNotNull(), "music")
        .when(F.col("episode_uri").isNotNull(), "podcast")
        .otherwise("unknown")
    )


def track_id() -> Column:
    return F.split_part(F.col("track_uri"), F.lit(":"), F.lit(3))


def calendar_columns(ts_local: str = "ts_local") -> dict[str, Column]:
    ts = F.col(ts_local)
    return {
        "played_date": F.to_date(ts),
        "played_year": F.year(ts).cast("smallint"),
        "played_month": F.trunc(ts, "month"),
        "played_hour": F.hour(ts).cast("tinyint"),
        "played_dow": (F.weekday(ts) + 1).cast("tinyint"),
    }


def flag_columns(skip_ms: int = SKIP_MS, substantial_ms: int = SUBSTANTIAL_MS) -> dict[str, Column]:
    """Three-valued flags: an unknown reason on a short play gives NULL."""
    return {
        "is_skip": (F.col("reason_end") == "fwdbtn") & (F.col("ms_played") < skip_ms),
        "is_substantial": F.col("ms_played") >= substantial_ms,
    }


def derive_columns(
    df: DataFrame, zone: str, skip_ms: int = SKIP_MS, substantial_ms: int = SUBSTANTIAL_MS
) -> DataFrame:
    return (
        df.withColumn("ts_local", local_time("ts_utc", zone))
        .withColumns({"track_id": track_id(), "content_type": content_type()})
        .withColumns(calendar_columns())
        .withColumns(flag_columns(skip_ms, substantial_ms))
    )


def normalize(
    raw: DataFrame,
    fmt: ExportFormat,
    zone: str = "UTC",
    skip_ms: int = SKIP_MS,
    substantial_ms: int = SUBSTANTIAL_MS,
) -> DataFrame:
    """Raw layer -> fact rows without `play_id`, source columns kept for numbering."""
    order = ["source_file", "source_index", "ingest_run_id"]
    kept = drop_repeats(extract_fields(raw, fmt), order)
    return derive_columns(kept, zone, skip_ms, substantial_ms)


def with_play_id(plays: DataFrame, tie_break: list[str]) -> DataFrame:
    """Dense id by (ts_utc, track_uri), source columns breaking ties."""
    order = [F.col(c).asc_nulls_last() for c in ("ts_utc", "track_uri", *tie_break)]
    return number_rows(plays, order, "play_id")


def select_plays(df: DataFrame) -> DataFrame:
    """Exactly the fact-table columns, in order and type."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name, metadata=f.metadata) for f in PLAYS])
