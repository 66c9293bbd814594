"""Dense numbering without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spinlog.session import materialize

_WITHIN_TASK = (1 << 33) - 1  # monotonically_increasing_id keeps the row number in 33 bits


def place_in_order(df: DataFrame, order: list[Column]) -> DataFrame:
    """Range-partition and sort; `_part` and `_pos` tell where each row stands.

    The range bounds come from samples, so the result must be written once and
    read back before anything is derived from it.
    """
    return (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit(_WITHIN_TASK)))
    )


def part_offsets(placed: DataFrame) -> DataFrame:
    """Rows before each part: one row per range partition, so a small table."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    )


def number_placed(placed: DataFrame, offsets: DataFrame, name: str) -> DataFrame:
    # The offsets hold one row per shuffle partition: a number set by
    # configuration, not by the data, so the broadcast is bounded.
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + F.col("_pos") + 1)
        .drop("_part", "_pos", "_before")
    )


def number_rows(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """1..n in the given order, every step spread over all tasks."""
    placed = materialize(place_in_order(df, order), "placed")
    return number_placed(placed, part_offsets(placed), name)
