"""Consecutive numbers in an order, without one task that sorts everything."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.plans.storage import kept


def numbered(df: DataFrame, by: str | list[str], name: str, start: int = 0) -> DataFrame:
    """df with numbers from ``start`` in the order of columns: sorted ranges, numbered each for itself, moved on by the
    sizes of the ranges before (one row a partition)."""
    by = [by] if isinstance(by, str) else by
    ranged = kept(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("_id", 33)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    joined = ranged.withColumn("_part", part).join(F.broadcast(before), "_part")
    return joined.withColumn(name, F.col("_id").bitwiseAND(F.lit((1 << 33) - 1).cast("long")) + F.col("_before") + start).drop("_id", "_part", "_before")
