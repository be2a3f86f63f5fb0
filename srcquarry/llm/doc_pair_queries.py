"""Queries of problem 1: functions paired with their documentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import spread, table
from .doc_pairs import doc_pairs


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "chunk").where(F.col("type") != "other").select("chunk_id", "language", "body", "doc")
    return doc_pairs(spread(chunks), key="chunk_id", language="language", body="body", doc="doc")


def p1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and description pairs; a chunk delivered again gives its pairs once."""
    return _pairs(spark, sf_dir).dropDuplicates(["chunk_id", "fn_name", "signature"])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions with non-trivial documentation."""
    return _pairs(spark, sf_dir).select("chunk_id", "fn_name").distinct()


SQL: dict[str, str] = {}

QUERIES = {"p1_found": p1_found, "p1_pairs": p1_pairs}
