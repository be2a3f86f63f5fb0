"""Queries of problem 6: files that were not written by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import spread, table
from .origin import classify_origin


def p6_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The origin of every file; a file delivered again counts once."""
    known = table(spark, sf_dir, "upstream_files").select(F.concat_ws("/", "lib_name", "file_name").alias("name"), "content")
    path = F.coalesce("relative_path", "file_path").alias("path_in_repo")
    files = table(spark, sf_dir, "source_file").select("file_path", path, "language", "content")
    found = classify_origin(spread(files), known, key="file_path", path="path_in_repo", text="content", language="language")
    return found.dropDuplicates(["file_path"])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are generated, minified, third-party copies or data."""
    return p6_origins(spark, sf_dir).where(F.col("origin") != "hand-written").select("file_path")


def p6_handwritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that remain, with their repository."""
    kept = p6_origins(spark, sf_dir).where(F.col("origin") == "hand-written").select("file_path")
    files = table(spark, sf_dir, "source_file").select("file_path", "repo_dir", "language").dropDuplicates(["file_path"])
    return files.join(kept, "file_path", "left_semi")


SQL: dict[str, str] = {}

QUERIES = {"p6_found": p6_found, "p6_origins": p6_origins, "p6_handwritten": p6_handwritten}
