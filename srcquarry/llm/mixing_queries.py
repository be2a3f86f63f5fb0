"""Queries of problem 8: sources mixed to target shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import cut, spread, table
from .mixing import mix_blocks, mix_report, sized_records


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, sf_dir, "mix_targets")
    sized = cut(sized_records(spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text")), targets, key="doc_id", text="text", source="source"))
    return mix_blocks(sized, targets, key="doc_id")[0], targets


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen records, with how often each is used and how many of its tokens the mix holds."""
    mixed, _ = _mix(spark, sf_dir)
    uses = mixed.groupBy("source", "doc_id", "token_start", "token_end").agg(F.count("*").alias("uses"))
    return uses.groupBy("source", "doc_id").agg(
        F.max("uses").alias("uses"), F.sum(F.col("uses") * (F.col("token_end") - F.col("token_start"))).alias("tokens")
    )


def p8_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix in order: which part of which record stands in which slot of which output shard."""
    return _mix(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares actually reached."""
    mixed, targets = _mix(spark, sf_dir)
    return mix_report(mixed, targets, key="doc_id")


SQL: dict[str, str] = {}

QUERIES = {"p8_mix": p8_mix, "p8_slots": p8_slots, "p8_shares": p8_shares}
