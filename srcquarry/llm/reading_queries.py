"""Queries of problem 9: the reading level of each document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import spread, table
from .reading import grades_of, reading_levels


def p9_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reading level of every document."""
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return reading_levels(documents, table(spark, sf_dir, "reading_labels"), key="doc_id", text="text")


def p9_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, words and mean level per language and band."""
    return p9_levels(spark, sf_dir).groupBy("lang_used", "band").agg(
        F.count("*").alias("documents"), F.sum("n_words").alias("words"), F.avg("level").alias("mean_level")
    )


def p9_heldout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How levels agree with grades that the fit has not seen: a third of the graded documents, chosen by hash, is held out."""
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    labels = table(spark, sf_dir, "reading_labels").withColumn("held", F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0)
    levels = reading_levels(documents, labels.where(~F.col("held")), key="doc_id", text="text")
    seen = levels.join(grades_of(labels.where("held"), key="doc_id"), "doc_id")
    return seen.agg(
        F.count("*").alias("documents"), F.corr("level", "raw_grade").alias("correlation"), F.avg(F.abs(F.col("level") - F.col("raw_grade"))).alias("mean_error")
    )


SQL: dict[str, str] = {}

QUERIES = {"p9_levels": p9_levels, "p9_profile": p9_profile, "p9_heldout": p9_heldout}
