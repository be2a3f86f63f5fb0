"""Queries of problem 4: chunks larger than the piece limit of their language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import table
from .split import split_oversized


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all oversized chunks, with overlap and the lines of each piece."""
    chunks = table(spark, sf_dir, "chunk").where(F.char_length("body") > 0)
    limits = (
        table(spark, sf_dir, "size_limits")
        .where((F.col("limit_name") == "piece") & (F.col("unit") == "code points"))
        .withColumnRenamed("applies_to", "language")
        .dropDuplicates(["language"])
    )
    pieces = split_oversized(chunks, limits, key="chunk_id", text="body", first_line="start_line", on="language")
    return pieces.dropDuplicates(["chunk_id", "piece_no"])  # a chunk delivered again has the same text


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that had to be split."""
    return p4_pieces(spark, sf_dir).select("chunk_id").distinct()


def p4_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The new texts of the pieces of each oversized chunk, joined again,."""
    own = F.substr("piece", F.col("overlap_chars") + 1)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", own.alias("new")))), lambda p: p["new"]), "")
    return p4_pieces(spark, sf_dir).groupBy("chunk_id").agg(F.sha2(joined, 256).alias("digest"))


SQL = {
    "p4_found": """
SELECT DISTINCT c.chunk_id FROM chunk c JOIN size_limits s ON s.limit_name = 'piece' AND s.applies_to = c.language
WHERE length(c.body) > s.max_size""",
    "p4_rejoined": """
SELECT DISTINCT c.chunk_id, sha256(c.body) AS digest FROM chunk c JOIN size_limits s ON s.limit_name = 'piece' AND s.applies_to = c.language
WHERE length(c.body) > s.max_size""",
}

QUERIES = {"p4_found": p4_found, "p4_pieces": p4_pieces, "p4_rejoined": p4_rejoined}
