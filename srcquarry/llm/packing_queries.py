"""Queries of problem 7: documents in containers of fixed token capacity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import spread, table
from .packing import pack_documents


def _capacity(spark: SparkSession, sf_dir: str) -> int:
    limits = table(spark, sf_dir, "size_limits").where("limit_name = 'container' and applies_to = 'documents'")
    return limits.agg(F.min("max_size")).first()[0]


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in containers, with the content of each container."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_documents(spread(documents), key="doc_id", text="text", capacity=_capacity(spark, sf_dir))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are."""
    packed = p7_containers(spark, sf_dir).agg(
        F.count("*").alias("containers"), F.sum("n_items").alias("items"), F.sum("n_tokens").alias("tokens"), F.min("n_tokens").alias("least_tokens")
    )
    return packed.withColumn("fill", F.col("tokens") / (F.col("containers") * _capacity(spark, sf_dir)))


def p7_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text, joined again from its parts in all containers."""
    parts = p7_containers(spark, sf_dir).select(F.inline("items"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda p: p["text"]), "")
    return parts.groupBy("doc_id").agg(F.sha2(joined, 256).alias("digest"), F.count("*").cast("int").alias("n"), F.max("parts").alias("parts")).select(
        "doc_id", "digest", (F.col("n") == F.col("parts")).alias("whole")
    )


SQL = {"p7_rejoined": "SELECT doc_id, sha256(coalesce(text, '')) AS digest, true AS whole FROM documents"}

QUERIES = {"p7_containers": p7_containers, "p7_fill": p7_fill, "p7_rejoined": p7_rejoined}
