"""Text expressions: blank tests, lines, offsets, windows. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as in Unicode-aware string stripping, spelt out because engines disagree on shorthand classes.
BLANKS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Characters that end a line.
BREAKS = r"\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029"


def is_blank(text: Column) -> Column:
    """True for text without a visible character (the empty text too); null for null."""
    return ~text.rlike(f"[^{BLANKS}]")


def strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^[{BLANKS}]+", ""), f"[{BLANKS}]+\\z", "")


def lines_keepends(text: Column) -> Column:
    """The lines of a text with their ends; joined they are the text. An empty text has no lines."""
    return F.regexp_extract_all(text, F.lit(f"[^{BREAKS}]*+(?:\\r\\n|[{BREAKS}])|[^{BREAKS}]++\\z"), F.lit(0))


def without_end(line: Column) -> Column:
    return F.regexp_replace(line, f"(?:\\r\\n|[{BREAKS}])\\z", "")


def newlines(text: Column) -> Column:
    """How many line feeds a text has."""
    return F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))


def line_of_offset(text: Column, offset: Column, first_line: Column) -> Column:
    """The line in which the character at a 0-based code point offset stands."""
    return first_line + newlines(F.substring(text, F.lit(1), offset))


def window_starts(text: Column, size: int, overlap: int) -> Column:
    """0-based starts of overlapping windows; the step is ``size`` where the overlap leaves none. Empty for an empty text."""
    step = size - overlap if size > overlap else size
    n = F.char_length(text)
    return F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.expr("cast(array() as array<int>)"))


def decode(content: Column) -> Column:
    """Bytes as UTF-8 text, with replacement characters for what is none."""
    return F.make_valid_utf8(content.cast("string"))
