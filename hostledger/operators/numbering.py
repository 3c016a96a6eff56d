"""Exact global row numbers without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage

LOCAL_BITS = 33  # low bits of monotonically_increasing_id count within a partition


def number_rows(
    df: DataFrame, order: Sequence[Column | str], name: str = "rn", total: str | None = None
) -> DataFrame:
    """Add 1, 2, 3, … in ``order`` (which must be total), spread over all tasks.

    The rows are sorted by range and written to the shared folder once, each with its partition
    and its place there; the sizes of the partitions before it give the offset. The offset table has
    one row per partition, so the window over it and its broadcast are small whatever the data.
    """
    placed = cut_lineage(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", LOCAL_BITS)
    local = F.col("_at").bitwiseAND((1 << LOCAL_BITS) - 1)
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(part.alias("_part"))
        .agg(F.count("*").alias("_n"))
        .select(
            "_part",
            F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_offset"),
            F.sum("_n").over(Window.partitionBy(F.lit(1))).alias("_total"),
        )
    )
    numbered = (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + local + 1)
        .drop("_at", "_part", "_offset")
    )
    return numbered.withColumnRenamed("_total", total) if total else numbered.drop("_total")


def running_total(df: DataFrame, order: Sequence[Column | str], value: str, name: str) -> DataFrame:
    """Add the sum of ``value`` over the rows before each row in ``order`` (which must be total), spread over all tasks."""
    placed = cut_lineage(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", LOCAL_BITS))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("_part").agg(F.sum(value).alias("_sum"))  # one row per partition
    offsets = sums.select("_part", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return summed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_offset") + F.col("_inside")).drop("_at", "_part", "_offset", "_inside")
