"""Lossless slicing of chunks into records of bounded token count.

``char_slices`` counts one token per code point and two special ones, and is all expressions;
``token_slices`` takes any tokenizer and runs as an Arrow function. Both give the same columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import newlines

SPECIAL = 2


def check_budget(max_tokens: int) -> int:
    if isinstance(max_tokens, bool) or not isinstance(max_tokens, int) or max_tokens <= 0:
        raise ValueError("max_tokens must be a positive integer")
    return max_tokens


def _fields(chunks: DataFrame, body: str, doc: str) -> DataFrame:
    """One row for the body (also an empty one) and one for a non-empty doc."""
    parts = F.array(
        F.struct(F.lit("body").alias("source_field"), F.coalesce(F.col(body), F.lit("")).alias("field_text")),
        F.when(F.length(doc) > 0, F.struct(F.lit("doc").alias("source_field"), F.col(doc).alias("field_text"))),
    )
    return chunks.withColumn("__part", F.explode(F.array_compact(parts))).select(
        "*", F.col("__part.source_field").alias("source_field"), F.col("__part.field_text").alias("field_text")
    ).drop("__part")


def char_slices(chunks: DataFrame, *, body: str = "body", doc: str = "doc", max_tokens: int = 256) -> DataFrame:
    """The columns of ``chunks`` and ``source_field``, ``char_start``, ``char_end``, ``piece``, ``token_count``."""
    room = check_budget(max_tokens) - SPECIAL
    if room <= 0:
        raise ValueError("max_tokens leaves no room for text")
    parts = _fields(chunks, body, doc)
    n = F.char_length("field_text")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(room))).otherwise(F.array(F.lit(0)))
    out = parts.withColumn("char_start", F.explode(starts))
    piece = F.substring("field_text", F.col("char_start") + 1, F.lit(room))
    return out.withColumn("piece", piece).withColumn("char_end", F.col("char_start") + F.char_length("piece")).withColumn(
        "token_count", F.char_length("piece") + SPECIAL
    )


def verified_slices(text: str, count: Callable[[str], int], max_tokens: int) -> list[tuple[int, int]]:
    """Consecutive spans whose own counts are within the budget.

    At most max(1024, 16 * max_tokens) characters are counted at once. Counts need not grow with the text, so
    only prefixes that were counted themselves are taken. ValueError where one character does not fit.
    """
    if not text:
        return [(0, 0)]
    probe = max(1024, 16 * max_tokens)
    spans = []
    at = 0
    while at < len(text):
        end = min(len(text), at + probe)
        if count(text[at:end]) > max_tokens:
            low, high, best = 1, end - at - 1, 0
            while low <= high:
                middle = (low + high) // 2
                if count(text[at : at + middle]) <= max_tokens:
                    best, low = middle, middle + 1
                else:
                    high = middle - 1
            if not best:
                if count(text[at : at + 1]) > max_tokens:
                    raise ValueError("one character does not fit the token budget")
                best = 1
            end = at + best
        spans.append((at, end))
        at = end
    return spans


def token_slices(chunks: DataFrame, make_counter: Callable[[], Callable[[str], int]], *, body: str = "body", doc: str = "doc", max_tokens: int = 256) -> DataFrame:
    """As ``char_slices``, with a counter that ``make_counter`` builds once in each task."""
    check_budget(max_tokens)
    parts = _fields(chunks, body, doc)
    names = parts.columns
    at = names.index("field_text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = make_counter()
        for b in batches:
            rows, start, end, piece, tokens = [], [], [], [], []
            for i, text in enumerate(b.column(at).to_pylist()):
                for x, y in verified_slices(text, count, max_tokens):
                    rows.append(i)
                    start.append(x)
                    end.append(y)
                    piece.append(text[x:y])
                    tokens.append(count(text[x:y]))
            took = b.take(pa.array(rows, pa.int64()))
            extra = [pa.array(start, pa.int32()), pa.array(piece, pa.string()), pa.array(end, pa.int32()), pa.array(tokens, pa.int32())]
            yield pa.RecordBatch.from_arrays([*took.columns, *extra], [*names, "char_start", "piece", "char_end", "token_count"])

    return parts.mapInArrow(run, f"{fields}, char_start int, piece string, char_end int, token_count int")


def line_range(first_line: Column, last_line: Column) -> tuple[Column, Column]:
    """Lines of a body slice; a slice of a doc has the lines of its symbol. A line break at a slice's end belongs to its line."""
    body = F.col("source_field") == "body"
    base = F.coalesce(first_line, F.lit(1))
    upto = F.greatest(F.col("char_start"), F.col("char_end") - 1)
    start = base + newlines(F.substring("field_text", F.lit(1), F.col("char_start")))
    end = base + newlines(F.substring("field_text", F.lit(1), upto))
    return F.when(body, start).otherwise(first_line), F.when(body, end).otherwise(last_line)


def char_count(text: Column) -> Column:
    """One token per code point and two special ones."""
    return F.char_length(text) + SPECIAL


def token_count(make_counter: Callable[[], Callable[[str], int]]) -> Callable[[Column], Column]:
    """A column function that counts by a tokenizer, built once in each task; null for null."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = make_counter()
        for texts in batches:
            yield texts.map(count, na_action="ignore").astype("Int32")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "int")


def compose(
    slices: DataFrame, *, language: str = "language", signature: str = "signature", max_tokens: int = 256, count: Callable[[Column], Column] = char_count
) -> DataFrame:
    """Adds ``document`` and ``context_omitted``: a context line before the slice where it fits.

    The context line may take a quarter of the budget and must fit together with the slice, by ``count``. A slice
    without signature has no context and omits none.
    """
    label = F.when(F.col(language) == "markdown", "# Section: ").otherwise("// Signature: ")
    prefix = F.concat(label, F.col(signature), F.lit("\n"))
    has = F.length(F.coalesce(F.col(signature), F.lit(""))) > 0
    fits = F.coalesce((count(prefix) <= max_tokens // 4) & (count(F.concat(prefix, F.col("piece"))) <= max_tokens), F.lit(False))
    return slices.withColumn("document", F.when(has & fits, F.concat(prefix, F.col("piece"))).otherwise(F.col("piece"))).withColumn(
        "context_omitted", F.when(has & ~fits, "signature").otherwise("")
    )


def prepare(chunks: DataFrame, *, max_tokens: int = 256, make_counter: Callable[[], Callable[[str], int]] | None = None) -> DataFrame:
    """Embedding-ready records of parser chunks: slices with provenance, comments as rows of their own.

    Tokens are counted by characters, or by the tokenizer that ``make_counter`` makes. Body, doc and signature must be
    strings: a column of another type is a TypeError.
    """
    for name in ("body", "doc", "signature"):
        if chunks.schema[name].dataType.simpleString() not in ("string", "void"):
            raise TypeError(f"{name} is not a string column")
    cut = token_slices(chunks, make_counter, max_tokens=max_tokens) if make_counter else char_slices(chunks, max_tokens=max_tokens)
    start, end = line_range(F.col("start_line"), F.col("end_line"))
    out = compose(cut.withColumn("__s", start).withColumn("__e", end), max_tokens=max_tokens, count=token_count(make_counter) if make_counter else char_count)
    is_doc = F.col("source_field") == "doc"
    return out.select(
        *[c for c in chunks.columns if c not in ("type", "body", "doc", "start_line", "end_line")],
        F.when(is_doc, "comment").otherwise(F.col("type")).alias("type"),
        F.when(is_doc, F.col("type")).alias("associated_type"),
        F.col("__s").cast("int").alias("start_line"),
        F.col("__e").cast("int").alias("end_line"),
        F.when(is_doc, "associated_symbol").otherwise("source").alias("line_range_kind"),
        F.when(~is_doc, F.when(F.length("doc") > 0, "separate_comment").otherwise("none")).alias("doc_context"),
        "source_field",
        "char_start",
        "char_end",
        F.col("source_field").alias("char_offset_scope"),
        "context_omitted",
        F.col("token_count").cast("int").alias("token_count"),
        F.col("piece").alias("source_text"),
        "document",
    )
