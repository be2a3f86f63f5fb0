"""Splitting of oversized texts at natural boundaries.

One bounded-quantifier pattern is matched again and again from where the last match ended. Its alternatives
are ordered by boundary strength and each consumes as much as the limit leaves beside the overlap: up to a
blank line, before an unindented line, a line end, a sentence end, white space, and any code point as
the fallback. The overlap is looked up behind the place of the match. Everything runs as Spark SQL array
functions; no Python is involved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points of one page; texts are folded page by page, so that no step has to walk over the whole text.
PAGE = 16_384
#: Blanks that a blank line before a boundary may hold.
BLANK = 64


def boundary_pattern(room: Column) -> Column:
    """The pattern that consumes at most ``room`` code points, at least half of it before a boundary."""
    least = F.greatest(F.lit(1), F.floor(room / 2))
    bounded = F.concat(F.lit(".{"), least.cast("string"), F.lit(","), room.cast("string"), F.lit("}"))
    return F.concat(
        F.lit("(?s)"),
        bounded, F.lit(rf"(?<=\n)(?=[ \t]{{0,{BLANK}}}\r?\n)|"),
        bounded, F.lit(r"(?<=\n)(?=[^\s})\]])|"),
        bounded, F.lit(r"(?<=\n)|"),
        bounded, F.lit(r"(?<=[.;!?:,][ \t]|[。！？；])|"),
        bounded, F.lit(r"(?<=[ \t\r])(?!\n)|"),
        F.lit(".{1,"), room.cast("string"), F.lit("}"),
    )


def split_oversized(
    items: DataFrame,
    limits: DataFrame,
    *,
    key: str,
    text: str,
    first_line: str,
    on: str,
) -> DataFrame:
    """Pieces of every item whose ``text`` has more code points than the limit for its ``on`` value.

    ``limits`` has ``on``, ``max_size``, ``overlap`` and ``overlap_unit`` ('code points' or 'lines').
    Rows out: key, ``piece_no`` (from 1), ``pieces``, ``piece`` (overlap and new text),
    ``overlap_chars``, ``char_start``, ``char_end`` (code points, end exclusive, overlap included),
    ``start_line``, ``end_line`` (of the piece; a line break at the end belongs to its line).

    The new texts of an item, joined, are the item, and every piece may fill the limit. An overlap in code
    points is exactly as long as given, as far as the text before is (and leaves one code point of new text).
    An overlap in lines is the last lines before the new text, whole wherever the line that follows fits
    beside them; where it does not, as much of their end as the limit leaves beside that line, or half of the
    limit if that is more.

    Items with null or short text, a null ``on`` or no limit give no rows; so does an empty table.
    Repeated items are split once for each row. Null ``first_line`` counts as 1. Only the named
    columns are read, so other columns may have any names.
    """
    src = items.select(
        F.col(key).alias("k"), F.col(text).alias("t"), F.coalesce(F.col(first_line), F.lit(1)).alias("l0"), F.col(on).alias("g")
    )
    lim = limits.select(F.col(on).alias("lim_on"), "max_size", "overlap", "overlap_unit")
    big = src.join(lim, (F.col("g") == F.col("lim_on")) & (F.char_length("t") > F.col("max_size")))

    limit, overlap = F.col("max_size"), F.coalesce("overlap", F.lit(0))
    page = F.greatest(F.lit(PAGE), limit + BLANK + 2).cast("int")
    n = F.char_length("t")
    # Every step consumes half of what the overlap leaves, or a whole line.
    by_chars = F.ceil(n / F.greatest(F.lit(1), F.floor((limit - F.least(overlap, limit - 1)) / 2)))
    by_lines = F.ceil(4 * n / limit) + n - F.char_length(F.replace("t", F.lit("\n"), F.lit("")))
    most = F.when((F.col("overlap_unit") == "lines") & (overlap > 0), by_lines).otherwise(by_chars) + 2
    paged = big.select(
        "k", "l0", "max_size", "overlap", "overlap_unit",
        n.alias("n"),
        page.alias("page"),
        F.regexp_extract_all("t", F.concat(F.lit("(?s).{1,"), page.cast("string"), F.lit("}")), F.lit(0)).alias("pages"),
        F.sequence(F.lit(1), most.cast("int")).alias("steps"),
    )

    def window(at: Column, size: Column) -> Column:
        """``size`` code points from ``at``, of the two pages that hold them."""
        first = F.floor(at / F.col("page")).cast("int")
        two = F.array_join(F.slice("pages", first + 1, F.lit(2)), "")
        return F.substring(two, (at - first * F.col("page") + 1).cast("int"), size.cast("int"))

    def before(at: Column, size: Column) -> Column:
        start = F.greatest(at - size, F.lit(0))
        return window(start, at - start)

    def last_lines(at: Column) -> Column:
        lines = F.regexp_extract_all(before(at, limit), F.lit(r"[^\n]*+\n|[^\n]++"), F.lit(0))
        return F.array_join(F.slice(lines, F.greatest(F.lit(1), F.size(lines) - overlap + 1), overlap), "")

    def back(at: Column) -> Column:
        following = F.char_length(F.regexp_extract(window(at, limit), r"\A[^\n]*\n?", 0))
        by_lines = F.right(last_lines(at), F.greatest(limit - following, F.floor(limit / 2)).cast("int"))
        by_chars = before(at, F.least(overlap, limit - 1))
        return F.when((at == 0) | (overlap <= 0) | (limit <= 1), F.lit("")).when(F.col("overlap_unit") == "lines", by_lines).otherwise(by_chars)

    def breaks(s: Column) -> Column:
        return F.char_length(s) - F.char_length(F.replace(s, F.lit("\n"), F.lit("")))

    # The fold keeps numbers only: Spark copies its state at every step. A place is the end of a piece's new text,
    # with the length of its overlap in the lower half.
    start = F.struct(
        F.expr("named_struct('b', 0, 'ov', 0, 'e', 0)").alias("last"), F.expr("cast(array() as array<bigint>)").alias("places"), F.expr("cast(array() as array<int>)").alias("lines")
    )

    def bind(value: Column, body) -> Column:
        """``body(value)`` with ``value`` computed once."""
        return F.transform(F.array(value), body)[0]

    def place(last: Column) -> Column:
        return F.shiftleft(last["e"].cast("bigint"), 32) + last["ov"]

    def step(a: Column, _: Column) -> Column:
        off = a["last"]["e"]

        def cut(ov: Column) -> Column:
            room = limit - F.char_length(ov)
            new = F.when(F.col("n") - off <= room, window(off, room)).otherwise(F.regexp_substr(window(off, room + BLANK + 2), boundary_pattern(room)))
            return bind(new, lambda s: F.struct(
                (a["last"]["b"] + breaks(s)).cast("int").alias("b"), F.char_length(ov).cast("int").alias("ov"), (off + F.char_length(s)).cast("int").alias("e")
            ))

        following = F.struct(
            bind(back(off), cut).alias("last"),
            F.when(off > 0, F.array_append(a["places"], place(a["last"]))).otherwise(a["places"]).alias("places"),
            F.array_append(a["lines"], a["last"]["b"]).alias("lines"),
        )
        return F.when(off >= F.col("n"), a).otherwise(following)

    finish = lambda a: F.struct(F.array_append(a["places"], place(a["last"])).alias("places"), a["lines"].alias("lines"))
    folded = paged.select("k", "l0", "page", "pages", F.aggregate("steps", start, step, finish).alias("f"))

    def piece(i: Column) -> Column:
        end, ov = F.shiftright(F.col("f.places")[i], 32).cast("int"), F.col("f.places")[i].bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
        new_from = F.when(i > 0, F.shiftright(F.col("f.places")[F.greatest(i - 1, F.lit(0))], 32)).otherwise(0).cast("int")
        return F.struct(new_from.alias("o"), end.alias("e"), F.col("f.lines")[i].alias("b"), window(new_from - ov, ov).alias("ov"), window(new_from, end - new_from).alias("new"))

    cut = folded.select("k", "l0", F.transform(F.sequence(F.lit(0), F.size("f.places") - 1), piece).alias("done"))
    out = cut.select("k", "l0", F.size("done").alias("pieces"), F.posexplode_outer("done").alias("i", "p"))  # a filter on the size would fold twice
    whole = F.concat("p.ov", "p.new")
    from_line = F.col("l0") + F.col("p.b") - breaks(F.col("p.ov"))
    return out.select(
        F.col("k").alias(key),
        (F.col("i") + 1).alias("piece_no"),
        "pieces",
        whole.alias("piece"),
        F.char_length("p.ov").alias("overlap_chars"),
        (F.col("p.o") - F.char_length("p.ov")).alias("char_start"),
        F.col("p.e").alias("char_end"),
        from_line.cast("int").alias("start_line"),
        (from_line + breaks(F.regexp_replace(whole, r"\n\z", ""))).cast("int").alias("end_line"),
    )
