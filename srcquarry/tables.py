"""Reading of the given tables, and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of the data directory (a file or a directory of part files)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last delivery of each key by ``order``; whole rows, one per key.

    The rank filter lets Spark keep only the best row of a key in each map task before
    the shuffle, so a key that is delivered very often does not gather in one task.
    Null keys form one group. With equal order values any of the tied rows stays.
    """
    rank = "__delivery_rank"
    while rank in df.columns:
        rank += "_"
    w = Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) == 1).drop(rank)


def spread(df: DataFrame) -> DataFrame:
    """The same rows in at least as many partitions as there are cores, for stages of heavy work per row.

    A table in a few files has few scan partitions, which would leave most cores idle. Only then rows are
    dealt out evenly, whatever their keys; a table of many partitions is left as it is and not shuffled.
    Select the needed columns first.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where the session names none, a temporary folder is used on one machine; on a cluster that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not path:
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def default_sf_dir() -> str:
    return os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
