"""Running sums over groups too large for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(df: DataFrame, *, group: list[str], order: list[str], value: str, name: str, bucket: Column, total: str | None = None) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows before this one in its group, in a fixed order.

    Rows are ordered by (``bucket``, ``order``); ``bucket`` splits a group into parts of bounded size, so a
    group that holds most rows is spread over many tasks. Bucket sums (one row per group and bucket) are
    added up first, then rows within their bucket. ``total`` adds the sum of the whole group. Null values
    count as 0. The order must not tie for the result to be the same on every run.
    """
    rows = df.withColumn("__bucket", bucket)
    sums = rows.groupBy(*group, "__bucket").agg(F.sum(F.coalesce(F.col(value), F.lit(0))).alias("__sum"))
    before = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *group,
        "__bucket",
        F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__offset"),
        *([F.sum("__sum").over(Window.partitionBy(*group)).alias(total)] if total else []),
    )
    inside = Window.partitionBy(*group, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("__local", F.coalesce(F.sum(F.coalesce(F.col(value), F.lit(0))).over(inside), F.lit(0)))
    return local.join(offsets, [*group, "__bucket"]).withColumn(name, F.col("__offset") + F.col("__local")).drop("__bucket", "__offset", "__local")
