"""Top rows, page slices and capped results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """ORDER BY + LIMIT: each task keeps `limit` rows, no full sort."""
    return df.orderBy(*order).limit(limit)


def top_per_label(
    df: DataFrame, label: str, labels: list[str], order: list[Column], limit: int
) -> DataFrame:
    """The first `limit` rows of each of a few known labels, with their `rank`.

    The rank filter runs before the shuffle as far as the session's group-limit
    threshold allows, so one label holding most rows does no harm there.
    """
    window = Window.partitionBy(label).orderBy(*order)
    df = df.where(F.col(label).isin(labels))
    return df.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= limit)


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of rows, as long as asked for."""
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset are 0 or more")
    return df.orderBy(*order).offset(offset).limit(limit)
