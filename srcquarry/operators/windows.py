"""Overlapping windows over long texts, and the gaps between spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank, newlines, window_starts


def overlapping_windows(texts: DataFrame, *, keep: list[str], text: str, first_line: str | None = None, size: int = 2000, overlap: int = 200) -> DataFrame:
    """Windows of ``size`` code points that start every ``size - overlap``; blank windows are left out.

    Columns: ``keep``, ``window_no`` (from 0, counted before blank ones are left out), ``start_line``,
    ``end_line`` (a line break at the end of a window counts), ``body``. Null and empty texts have none.
    One narrow projection: no shuffle.
    """
    base = F.col(first_line) if first_line else F.lit(1)
    src = texts.select(*keep, base.alias("__line"), F.col(text).alias("__text"))
    at = src.select("*", F.posexplode(window_starts(F.col("__text"), size, overlap)).alias("window_no", "__at"))
    body = F.substring("__text", F.col("__at") + 1, F.lit(size))
    start = F.col("__line") + newlines(F.substring("__text", F.lit(1), F.col("__at")))
    cut = at.select(*keep, "window_no", start.alias("start_line"), body.alias("body"))
    return cut.where(~is_blank(F.col("body"))).select(*keep, "window_no", "start_line", (F.col("start_line") + newlines(F.col("body"))).alias("end_line"), "body")


def uncovered(spans: DataFrame, extents: DataFrame, *, key: list[str], start: str, end: str, extent: str) -> DataFrame:
    """The gaps that half-open spans leave in [0, extent): key, ``gap_start``, ``gap_end``.

    Spans may touch, repeat or overlap. A key of ``extents`` without spans is one gap; an extent of 0 has none.
    """
    w = Window.partitionBy(*key).orderBy(start, end)
    inside = spans.select(
        *key,
        F.coalesce(F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("gap_start"),
        F.col(start).alias("gap_end"),
    )
    reach = spans.groupBy(*key).agg(F.max(end).alias("__reach"))
    tail = extents.select(*key, F.col(extent).alias("gap_end")).join(reach, key, "left").select(
        *key, F.coalesce("__reach", F.lit(0)).alias("gap_start"), "gap_end"
    )
    return inside.unionByName(tail).where(F.col("gap_start") < F.col("gap_end"))
