"""Reusable filters and argument checks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_of(name: str, value: str, allowed: tuple[str, ...]) -> str:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}; got {value!r}")
    return value


def as_date(value: str | dt.date) -> dt.date:
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(value)


PARTITION = "partition"  # schema note on columns a table is partitioned by


def is_partition(df: DataFrame, column: str) -> bool:
    return column in df.columns and bool(df.schema[column].metadata.get(PARTITION))


def date_range(
    df: DataFrame, start: str | dt.date | None, end: str | dt.date | None, column: str = "played_date"
) -> DataFrame:
    """Inclusive on both sides, each side optional.

    Rows read from a store partitioned by month also get the month bounds, so
    files outside the range are never opened.
    """
    by_month = column == "played_date" and is_partition(df, "played_month")
    if start:
        day = as_date(start)
        df = df.where(F.col(column) >= F.lit(day))
        if by_month:
            df = df.where(F.col("played_month") >= F.lit(day.replace(day=1)))
    if end:
        day = as_date(end)
        df = df.where(F.col(column) <= F.lit(day))
        if by_month:
            df = df.where(F.col("played_month") <= F.lit(day))
    return df


def named(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull())


def silent_since(plays: DataFrame, last_seen: Column | str, months: int) -> Column:
    """True when `last_seen` lies more than `months` before the latest play of any kind.

    The anchor is a scalar subquery over one column.  A year-month interval
    keeps the time of day and clamps at month ends.
    """
    anchor = plays.agg(F.max("ts_utc")).scalar()
    seen = F.col(last_seen) if isinstance(last_seen, str) else last_seen
    return seen < anchor - F.make_ym_interval(F.lit(0), F.lit(months))
