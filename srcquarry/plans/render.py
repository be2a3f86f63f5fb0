"""Search hits as text and JSON columns."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_FENCES = ("cpp", "c", "python", "go", "markdown")


def hit_fields(hits: DataFrame) -> DataFrame:
    """The fields of a JSON hit, with their defaults."""
    text = lambda c, d="": F.coalesce(F.col(c), F.lit(d)).alias(c)
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return hits.select(
        text("file_path"), text("type"), text("name"), number("start_line"), number("end_line"), text("line_range_kind", "source"),
        text("source_field", "body"), number("char_start"), number("char_end"), F.coalesce("source_field", F.lit("body")).alias("char_offset_scope"),
        text("signature"), text("language", "unknown"), F.greatest(F.lit(0.0), 1 - F.col("distance")).alias("similarity"),
        F.coalesce("source_text", F.lit("")).alias("code"),
    )


def hit_text(rank: Column) -> Column:
    """One hit as a Markdown block."""
    label = F.when(F.col("line_range_kind") == "associated_symbol", "Lines of the documented symbol").otherwise("Lines")
    fence = F.when(F.col("language").isin(*_FENCES), F.col("language")).otherwise("text")
    title = F.coalesce(F.nullif("name", F.lit("")), F.col("file_path"))
    signature = F.when(F.length("signature") > 0, F.concat(F.lit("- Signature: `"), F.col("signature"), F.lit("`")))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("### "), rank.cast("string"), F.lit(". "), title),
        F.concat(F.lit("- File: `"), F.col("file_path"), F.lit("`")),
        F.concat(F.lit("- Type: "), F.col("type")),
        F.concat(F.lit("- Language: "), F.col("language")),
        F.concat(F.lit("- "), label, F.lit(": "), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string")),
        F.concat(F.lit("- Score: "), F.format_string("%.4f", F.greatest(F.lit(0.0), 1 - F.col("distance")))),
        signature,
        F.concat(F.lit("\n```"), fence, F.lit("\n"), F.coalesce("source_text", F.lit("")), F.lit("\n```\n")),
    )


def hits_as_text(hits: DataFrame, question: str) -> str:
    """The k hits of one question as a Markdown page."""
    ranked = hits.withColumn("rank", F.row_number().over(Window.orderBy("distance", "id")))  # k rows
    blocks = [r["block"] for r in ranked.select("rank", hit_text(F.col("rank")).alias("block")).orderBy("rank").collect()]
    if not blocks:
        return f"Nothing found for {question!r}."
    return "\n".join([f"## {len(blocks)} results for {question!r}\n", *blocks])


def hits_as_json(hits: DataFrame) -> str:
    """The k hits of one question as a JSON array, nearest first."""
    rows = [r.asDict() for r in hit_fields(hits.orderBy("distance", "id")).collect()]
    return json.dumps(rows, indent=2, ensure_ascii=False)
