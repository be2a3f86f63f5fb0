"""Headings and sections of Markdown texts.

A text is cut into lines inside its row; folds over the lines tell which ones stand in fenced blocks, which are
headings, and which headings stand above each. Nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import BLANKS, is_blank, lines_keepends, strip, without_end

# The forms of headings and fences.
ATX = r"^(#{1,6})[ \t]+(.+?)[ \t]*#*[ \t]*\z"
SETEXT = r"^[ \t]*(=+|-+)[ \t]*\z"
FENCE = r"^ {0,3}(`{3,}|~{3,})(.*)\z"


def clean_title(title: Column) -> Column:
    """A heading's title without emphasis marks and with single spaces; '<untitled>' if nothing is left."""
    one = F.regexp_replace(strip(title), f"[{BLANKS}]+", " ")
    return F.coalesce(F.nullif(F.btrim(one, F.lit("`*_ ")), F.lit("")), F.lit("<untitled>"))


def fenced_flags(lines: Column) -> Column:
    """For each line whether it belongs to a fenced block, its fences included.

    A block opens with at least three backticks or tildes (no backtick in the rest of a backtick fence) and
    closes with as many of the same mark and nothing else; an open one reaches to the end.
    """
    start = F.struct(F.lit("").alias("mark"), F.expr("cast(array() as array<boolean>)").alias("flags"))

    def step(a: Column, line: Column) -> Column:
        mark = F.regexp_extract(line, "(?s)" + FENCE, 1)
        rest = F.regexp_extract(line, "(?s)" + FENCE, 2)
        is_open = a["mark"] != ""
        opens = ~is_open & (mark != "") & ~((F.substring(mark, 1, 1) == "`") & F.contains(rest, F.lit("`")))
        closes = is_open & F.startswith(mark, a["mark"]) & (F.btrim(rest, F.lit(" \t")) == "")
        return F.struct(
            F.when(opens, mark).when(closes, F.lit("")).otherwise(a["mark"]).alias("mark"),
            F.array_append(a["flags"], is_open | opens).alias("flags"),
        )

    return F.aggregate(lines, start, step)["flags"]


def numbered_lines(files: DataFrame, *, key: str, text: str) -> DataFrame:
    """key, ``line_no`` (from 1), ``line`` (without its end), ``raw``, ``fenced``, ``next_line``, ``next_fenced``."""
    src = files.select(F.col(key).alias(key), lines_keepends(F.col(text)).alias("raws"))
    bare = src.withColumn("bare", F.transform("raws", without_end)).withColumn("fenced", fenced_flags(F.col("bare")))
    later = lambda c: F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0)))
    zipped = F.arrays_zip("raws", "bare", "fenced", later("bare").alias("next_line"), later("fenced").alias("next_fenced"))
    out = bare.select(key, F.posexplode(zipped).alias("i", "z"))
    return out.select(
        key, (F.col("i") + 1).alias("line_no"), F.col("z.bare").alias("line"), F.col("z.raws").alias("raw"), F.col("z.fenced").alias("fenced"), F.col("z.next_line").alias("next_line"), F.col("z.next_fenced").alias("next_fenced")
    )


def _heading(line: Column, fenced: Column, next_line: Column, next_fenced: Column) -> tuple[Column, Column, Column]:
    """Whether a line is a heading, its level, and its title as it stands: ATX headings at the line start, and lines underlined with = or -."""
    atx = line.rlike("(?s)" + ATX) & ~fenced
    setext = ~atx & ~fenced & ~is_blank(line) & ~next_fenced & next_line.rlike(SETEXT)
    level = F.when(atx, F.length(F.regexp_extract(line, "(?s)" + ATX, 1))).otherwise(F.when(F.regexp_extract(next_line, SETEXT, 1).startswith("="), 1).otherwise(2))
    return atx | F.coalesce(setext, F.lit(False)), level, F.when(atx, F.regexp_extract(line, "(?s)" + ATX, 2)).otherwise(line)


def headings(lines: DataFrame, *, key: str) -> DataFrame:
    """key, ``line_no``, ``level``, ``title`` of the headings among ``numbered_lines``."""
    is_heading, level, title = _heading(F.col("line"), F.col("fenced"), F.col("next_line"), F.col("next_fenced"))
    return lines.where(is_heading).select(key, "line_no", level.alias("level"), clean_title(title).alias("title"))


def outlines(files: DataFrame, *, keep: list[str], text: str) -> DataFrame:
    """``keep``, ``raws`` (the lines) and ``outline``: ``line_no``, ``level``, ``title``, ``heading_path`` of every heading.

    A path has the titles from the outermost heading down, joined by ' > ': of the headings before, those of smaller
    level that no other of the same or a smaller level came after.
    """
    src = files.select(*keep, lines_keepends(F.col(text)).alias("raws"))
    bare = src.withColumn("__bare", F.transform("raws", without_end)).withColumn("__fenced", fenced_flags(F.col("__bare")))

    def heading(i: Column) -> Column:
        is_heading, level, title = _heading(F.col("__bare")[i], F.col("__fenced")[i], F.get("__bare", i + 1), F.get("__fenced", i + 1))
        return F.when(is_heading, F.struct((i + 1).alias("line_no"), level.alias("level"), clean_title(title).alias("title")))

    places = F.when(F.size("raws") > 0, F.sequence(F.lit(0), F.size("raws") - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    heads = bare.select(*keep, "raws", F.array_compact(F.transform(places, heading)).alias("__heads"))
    start = F.struct(
        F.expr("cast(array() as array<struct<level:int,title:string>>)").alias("above"),
        F.expr("cast(array() as array<struct<line_no:int,level:int,title:string,heading_path:string>>)").alias("out"),
    )

    def step(s: Column, h: Column) -> Column:
        above = F.array_append(F.filter(s["above"], lambda x: x["level"] < h["level"]), F.struct(h["level"].alias("level"), h["title"].alias("title")))
        path = F.array_join(F.transform(above, lambda x: x["title"]), " > ")
        return F.struct(above.alias("above"), F.array_append(s["out"], F.struct(h["line_no"].alias("line_no"), h["level"].alias("level"), h["title"].alias("title"), path.alias("heading_path"))).alias("out"))

    return heads.select(*keep, "raws", F.aggregate("__heads", start, step)["out"].alias("outline"))


def heading_paths(files: DataFrame, *, key: str, text: str) -> DataFrame:
    """key, ``line_no``, ``level``, ``title``, ``heading_path`` of every heading."""
    found = outlines(files, keep=[key], text=text).select(key, F.explode_outer("outline").alias("h"))  # a filter on the size would fold twice
    return found.where(F.col("h").isNotNull()).select(key, "h.*")


def sections(files: DataFrame, *, key: str, text: str, name: Column) -> DataFrame:
    """key, ``start_line``, ``end_line``, ``level``, ``title``, ``heading_path``, ``body``.

    A section reaches from its heading to the line before the next one. Text before the first heading, or a
    text without headings, is a section of level 0 titled by ``name``, unless it is blank.
    """
    src = outlines(files.withColumn("__name", name), keep=[key, "__name"], text=text)
    n = F.size("raws")
    first = F.coalesce(F.get("outline", F.lit(0))["line_no"], n + 1)

    def section(start: Column, end: Column, level: Column, title: Column, path: Column) -> Column:
        body = F.array_join(F.slice("raws", start, end - start + 1), "")
        return F.struct(start.cast("int").alias("start_line"), end.cast("int").alias("end_line"), level.cast("int").alias("level"), title.alias("title"), path.alias("heading_path"), body.alias("body"))

    lead = F.when(first > 1, section(F.lit(1), first - 1, F.lit(0), F.col("__name"), F.col("__name")))
    own = F.transform("outline", lambda h, i: section(h["line_no"], F.coalesce(F.get("outline", i + 1)["line_no"], n + 1) - 1, h["level"], h["title"], h["heading_path"]))
    cut = src.select(key, F.array_compact(F.concat(F.array(lead), own)).alias("__sections")).select(key, F.explode_outer("__sections").alias("s"))
    kept = cut.where(F.col("s").isNotNull() & ((F.col("s.level") > 0) | ~is_blank(F.col("s.body"))))
    return kept.select(key, "s.*")
