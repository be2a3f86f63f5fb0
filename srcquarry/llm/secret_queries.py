"""Queries of problem 3: credentials in chunks and index rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import spread, table
from .secrets import find_credentials


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "chunk").select(
        F.lit("chunk").alias("record_kind"),
        F.col("chunk_id").cast("string").alias("record_id"),
        "language",
        F.col("body").alias("text"),
    )
    stored = table(spark, sf_dir, "stored_row").select(
        F.lit("stored_row").alias("record_kind"),
        F.col("id").alias("record_id"),
        F.col("metadata.language").alias("language"),
        F.col("metadata.source_text").alias("text"),
    )
    return find_credentials(spread(chunks.unionByName(stored)), key=["record_kind", "record_id"], text="text", language="language")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines on which a credential begins."""
    return (
        _found(spark, sf_dir)
        .select("record_kind", "record_id", F.explode("hits").alias("h"))
        .select("record_kind", "record_id", F.col("h.line_no").alias("line_no"))
        .distinct()
    )


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with their credentials redacted, and where these stood; a text delivered again counts once."""
    return _found(spark, sf_dir).dropDuplicates(["record_kind", "record_id"])


SQL: dict[str, str] = {}

QUERIES = {"p3_found": p3_found, "p3_redacted": p3_redacted}
