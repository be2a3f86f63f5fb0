"""Queries of problem 5: files that are not valid in their language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import spread, table
from .validity import invalid_rates, judge_files


def p5_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every file; a file delivered again counts once."""
    files = table(spark, sf_dir, "source_file").select("file_path", "repo_dir", "language", "content")
    judged = judge_files(spread(files), key=["file_path", "repo_dir", "language"], text="content", language="language")
    return judged.dropDuplicates(["file_path"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are not valid in the language they are given as."""
    return p5_files(spark, sf_dir).where(~F.col("valid")).select("file_path")


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of invalid files per repository and language."""
    return invalid_rates(p5_files(spark, sf_dir), ["repo_dir", "language"])


SQL: dict[str, str] = {}

QUERIES = {"p5_found": p5_found, "p5_files": p5_files, "p5_rates": p5_rates}
