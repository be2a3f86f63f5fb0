"""Packing of the lines of long sections into chunks with overlap, as a fold in expressions.

A chunk is a range of whole lines, or a slice of a line that is too long for one. The fold goes over the lines with
two numbers, the first line of the open range and its size, and notes the ranges it closes; texts are cut out of the
list of lines afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, lines_keepends

#: Share of the limit from which a blank line ends a chunk.
SOFT_SHARE = 0.8


def line_ranges(sizes: Column, blanks: Column, limit: int, overlap: int) -> Column:
    """Ranges ``a`` to ``b`` (from 0, end exclusive) of lines, given the size of each line and whether it is blank.

    A range is closed before a line that would make it larger than the limit; the next one then starts up to
    ``overlap`` lines earlier, as far as these and the line fit. It is closed behind a blank line at SOFT_SHARE of the
    limit, and what follows starts fresh. A line over the limit is a range of its own, without overlap on either
    side. What is open at the end is a range unless it is blank.
    """
    none = F.expr("cast(array() as array<struct<a:int,b:int>>)")

    def span(a: Column, b: Column) -> Column:
        return F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))

    def total(a: Column, b: Column) -> Column:
        return F.aggregate(F.slice(sizes, a + 1, b - a), F.lit(0), lambda x, y: x + y)

    def step(s: Column, i: Column) -> Column:
        n = sizes[i]
        over, full = n > limit, (s["a"] < i) & (s["size"] + n > limit)
        earlier = F.sequence(F.greatest(s["a"], i - overlap), i)
        carried = F.filter(earlier, lambda a: total(a, i) + n <= limit)[0]  # the range of no line always fits
        a = F.when(over, i + 1).when(full, carried).otherwise(s["a"])
        size = F.when(over, F.lit(0)).when(full, total(carried, i) + n).otherwise(s["size"] + n)
        soft = ~over & blanks[i] & (size >= limit * SOFT_SHARE)
        before = F.when((s["a"] < i) & (over | full), F.array(span(s["a"], i))).otherwise(none)
        behind = F.when(over, F.array(span(i, i + 1))).when(soft, F.array(span(a, i + 1))).otherwise(none)
        return F.struct(
            F.when(soft, i + 1).otherwise(a).cast("int").alias("a"), F.when(soft, F.lit(0)).otherwise(size).cast("int").alias("size"), F.concat(s["out"], before, behind).alias("out")
        )

    def finish(s: Column) -> Column:
        n = F.size(sizes)
        text = F.exists(F.slice(blanks, s["a"] + 1, n - s["a"]), lambda blank: ~blank)
        return F.when((s["a"] < n) & text, F.concat(s["out"], F.array(span(s["a"], n)))).otherwise(s["out"])

    places = F.when(F.size(sizes) > 0, F.sequence(F.lit(0), F.size(sizes) - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.aggregate(places, F.struct(F.lit(0).alias("a"), F.lit(0).alias("size"), none.alias("out")), step, finish)


def pack_long(texts: DataFrame, *, keep: list[str], text: str, first_line: str, limit: int = 3000, overlap: int = 2) -> DataFrame:
    """``keep``, ``part`` (0 for a text within the limit, else from 1), ``start_line``, ``end_line``, ``body``.

    Texts within the limit stay whole. A line over the limit is cut into slices of the limit. Null texts give no
    rows; an empty text is a part of its own.
    """
    src = texts.where(F.col(text).isNotNull()).select(*keep, F.col(first_line).cast("int").alias("__line"), F.col(text).alias("__text"))
    src = src.withColumn("__lines", lines_keepends(F.col("__text")))
    small = F.char_length("__text") <= limit
    empty = F.expr("cast(array() as array<struct<a:int,b:int>>)")
    ranged = src.withColumn(
        "__ranges", F.when(small, empty).otherwise(line_ranges(F.transform("__lines", F.char_length), F.transform("__lines", is_blank), limit, overlap))
    )

    def parts(r: Column) -> Column:
        body = F.array_join(F.slice("__lines", r["a"] + 1, r["b"] - r["a"]), "")
        cuts = F.sequence(F.lit(0), F.floor((F.greatest(F.char_length(body), F.lit(1)) - 1) / limit).cast("int"))
        return F.transform(cuts, lambda k: F.struct((F.col("__line") + r["a"]).alias("from"), (F.col("__line") + r["b"] - 1).alias("to"), F.substring(body, k * limit + 1, F.lit(limit)).alias("body")))

    whole = F.array(F.struct(F.col("__line").alias("from"), (F.col("__line") + F.greatest(F.size("__lines"), F.lit(1)) - 1).alias("to"), F.col("__text").alias("body")))
    cut = ranged.select(*keep, small.alias("__small"), F.when(small, whole).otherwise(F.flatten(F.transform("__ranges", parts))).alias("__parts"))
    out = cut.select(*keep, "__small", F.posexplode_outer("__parts").alias("__i", "__p")).where(F.col("__p").isNotNull())
    return out.select(*keep, F.when(F.col("__small"), 0).otherwise(F.col("__i") + 1).alias("part"), F.col("__p.from").alias("start_line"), F.col("__p.to").alias("end_line"), F.col("__p.body").alias("body"))
