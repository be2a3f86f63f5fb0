"""Changes between consecutive full snapshots of a table.

Full snapshots are turned into validity intervals (gaps and islands over key and row hash);
the starts, ends and adjacencies of the intervals are the change events.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _hash(values: Sequence[str]) -> Column:
    """A 128-bit hash of the values; null differs from every value, and fields cannot run together."""
    return F.unhex(F.md5(F.to_json(F.array(*[F.col(v).cast("string") for v in values])).cast("binary")))


def committed_sequence(builds: DataFrame, group: Sequence[str], snapshot: str, committed: Column) -> DataFrame:
    """Committed snapshots of each group, numbered 1, 2, ... in snapshot order.

    Repeated rows of a build count once. Columns: group, snapshot, ``seq``, ``next_snapshot``
    (null for the last one).
    """
    w = Window.partitionBy(*group).orderBy(snapshot)
    return (
        builds.where(committed)
        .select(*group, snapshot)
        .distinct()
        .select(
            *group,
            snapshot,
            F.row_number().over(w).alias("seq"),
            F.lead(snapshot).over(w).alias("next_snapshot"),
        )
    )


def validity_intervals(
    rows: DataFrame,
    sequence: DataFrame,
    *,
    group: Sequence[str],
    key: Sequence[str],
    snapshot: str,
    values: Sequence[str],
    received: str,
) -> DataFrame:
    """Intervals of consecutive committed snapshots in which a record exists unchanged.

    ``rows`` holds full snapshots, possibly with several deliveries of a record: the one with the
    latest ``received`` counts (null is the earliest; between equal times the greatest values
    decide). Snapshots missing from ``sequence`` are ignored. Null keys are a key of their own,
    and an empty table gives no intervals. Other columns of ``rows`` are never read.

    Deliveries are reduced by a partial aggregation before the first shuffle; the second shuffle
    is on the full key, so a group that holds most rows is spread over all tasks. One key has at
    most one row per snapshot there.
    """
    dims = [*group, *key]
    at = sequence.select(*group, snapshot, F.col("seq").alias("__seq"), F.col(snapshot).alias("__at"), F.col("next_snapshot").alias("__next"))
    newest = F.max(F.struct(F.col(received).alias("r"), F.struct(*[F.col(v) for v in values]).alias("v"))).alias("__last")
    one = (
        rows.select(*dims, snapshot, received, *values)
        .join(at, [*group, snapshot])
        .groupBy(*dims, "__seq", "__at", "__next")
        .agg(newest)
        .select(*dims, "__seq", "__at", "__next", *[F.col(f"__last.v.{v}").alias(v) for v in values])
        .withColumn("__hash", _hash(values))
    )
    by_key = Window.partitionBy(*dims).orderBy("__seq")
    goes_on = (F.lag("__seq").over(by_key) == F.col("__seq") - 1) & (F.lag("__hash").over(by_key) == F.col("__hash"))
    starts = one.withColumn("__start", F.when(goes_on, 0).otherwise(1))
    islands = starts.withColumn("__island", F.sum("__start").over(by_key))
    return islands.groupBy(*dims, "__island").agg(
        F.min("__seq").alias("first_seq"),
        F.max("__seq").alias("last_seq"),
        F.min_by("__at", "__seq").alias("first_snapshot"),
        F.max_by("__at", "__seq").alias("last_snapshot"),
        F.max_by("__next", "__seq").alias("next_snapshot"),
        *[F.first(v).alias(v) for v in values],
    ).drop("__island")


def change_events(intervals: DataFrame, *, group: Sequence[str], key: Sequence[str], snapshot: str) -> DataFrame:
    """Change events of validity intervals: columns group, ``snapshot``, key, ``change``.

    An interval that starts after the first snapshot is an addition ('A') unless it adjoins the
    interval before it, when it is a change ('M'); an interval that ends before the last snapshot
    without an adjoining successor is a removal ('D') in the following snapshot.
    """
    dims = [*group, *key]
    w = Window.partitionBy(*dims).orderBy("first_seq")
    n = intervals.select(
        *dims,
        "first_seq",
        "last_seq",
        "first_snapshot",
        "next_snapshot",
        F.lag("last_seq").over(w).alias("before"),
        F.lead("first_seq").over(w).alias("after"),
    )
    start = F.when(
        F.col("first_seq") > 1,
        F.struct(
            F.col("first_snapshot").alias(snapshot),
            F.when(F.col("before") == F.col("first_seq") - 1, "M").otherwise("A").alias("change"),
        ),
    )
    end = F.when(
        F.col("next_snapshot").isNotNull() & ~F.coalesce(F.col("after") == F.col("last_seq") + 1, F.lit(False)),
        F.struct(F.col("next_snapshot").alias(snapshot), F.lit("D").alias("change")),
    )
    events = n.select(*dims, F.explode(F.array_compact(F.array(start, end))).alias("e"))
    return events.select(*group, F.col(f"e.{snapshot}").alias(snapshot), *key, F.col("e.change").alias("change"))
